"""Chat formatting by event sourcing, in DataFrame functions alone.

A log holds events (conv_id, seq, kind, message, role, text):

* ``message`` opens a message with a role and a text, which may be empty;
* ``delta`` adds text to the end of a message;
* ``edit`` replaces a message's text;
* ``regenerate`` clears a message's text, and removes all messages opened after it and before this event.

Folding goes in two steps.  Events of a message are folded by (conversation, message),
sorted by sequence, which spreads a long conversation over many tasks; then messages are
put in the order in which they opened and rendered.  A message opens at its first ``message``
event; deltas and edits before that, or after none, are of no effect.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each message.  Inside roles and
texts, the first character of every control string of CONTROLS becomes ESCAPE and a letter
(and a line's end in a role likewise), ESCAPE itself is doubled: no text can open or close
a turn, here or in other common templates, and the original comes back exactly.

Defined results: null texts and roles count as empty; events with a null conversation are
one conversation; equal sequences are taken in the order of kind, role and text; a null
sequence comes first; an unknown kind has no effect; an empty log gives no rows; columns
besides those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of common chat templates, none of which may stand in a text.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ESCAPE = "␛"
#: What stands for a character after ESCAPE.
_LETTERS = {"<": "l", "[": "b", "\n": "n"}


def _quoted(s: str) -> str:
    return "".join(f"\\{c}" if c in r"<>|[]/\.*+?(){}^$" else c for c in s)


def escape(text: Column, line_ends: bool = False) -> Column:
    """text without control strings; line_ends: also without line ends."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for first, letter in _LETTERS.items():
        rest = [c[1:] for c in CONTROLS if c[0] == first]
        if rest:
            out = F.regexp_replace(out, f"{_quoted(first)}(?={'|'.join(map(_quoted, rest))})", ESCAPE + letter)
        elif line_ends:
            out = F.replace(out, F.lit(first), F.lit(ESCAPE + letter))
    return out


def unescape(text: Column) -> Column:
    """What escape() was given: doubled escapes part the text, others are read between them."""

    def back(piece: Column) -> Column:
        for first, letter in _LETTERS.items():
            piece = F.replace(piece, F.lit(ESCAPE + letter), F.lit(first))
        return piece

    return F.array_join(F.transform(F.split(text, ESCAPE * 2, -1), back), ESCAPE)


def folded(events: DataFrame) -> DataFrame:
    """conv_id, message, opened (its place), role and text of every message that is left."""
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    state = F.struct(F.lit(None).cast("long").alias("opened"), F.lit(None).cast("string").alias("role"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, e: Column) -> Column:
        fresh = F.struct(F.coalesce(s["opened"], e["seq"], F.lit(-1)).alias("opened"), F.coalesce(s["role"], e["role"]).alias("role"), F.array(e["text"]).alias("parts"))
        added = F.struct(s["opened"].alias("opened"), s["role"].alias("role"), F.concat(s["parts"], F.array(e["text"])).alias("parts"))
        new = F.struct(s["opened"].alias("opened"), s["role"].alias("role"), F.array(e["text"]).alias("parts"))
        none = F.struct(s["opened"].alias("opened"), s["role"].alias("role"), F.array().cast("array<string>").alias("parts"))
        is_open = s["opened"].isNotNull()
        return F.when(e["kind"] == "message", fresh).when(is_open & (e["kind"] == "delta"), added).when(is_open & (e["kind"] == "edit"), new).when(is_open & (e["kind"] == "regenerate"), none).otherwise(s)

    events = events.where("kind IS NOT NULL")
    cut = F.max(F.when(F.col("kind") == "regenerate", F.col("seq")))
    each = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"), cut.alias("cut"))
    last = each.select("conv_id", "message", F.aggregate("log", state, step).alias("m"), "cut").where("m.opened IS NOT NULL")
    last = last.select("conv_id", "message", F.col("m.opened").alias("opened"), F.col("m.role").alias("role"), F.array_join("m.parts", "").alias("text"), "cut")
    # The latest regeneration of a message that opened before decides; a row for each message, not for each event.
    before = Window.partitionBy("conv_id").orderBy("opened").rangeBetween(Window.unboundedPreceding, -1)
    return last.withColumn("reach", F.max("cut").over(before)).where(F.coalesce(F.col("reach") <= F.col("opened"), F.lit(True))).drop("cut", "reach")


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss_spans: begin and length, in code points, of each assistant text in it."""
    body = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit("\n"))
    text = escape(F.col("text"))
    piece = F.struct("opened", "message", body.alias("head"), text.alias("body"), F.lit(CLOSE + "\n").alias("tail"), (F.col("role") == "assistant").alias("loss"))
    each = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], t["tail"])), "")
    # Begins of the texts, by a running sum that keeps one number and the spans so far.
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:long,length:long>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(t["head"])
        span = F.array(F.struct(begin.cast("long").alias("begin"), F.length(t["body"]).cast("long").alias("length")))
        return F.struct((begin + F.length(t["body"]) + F.length(t["tail"])).cast("long").alias("at"), F.when(t["loss"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return each.select("conv_id", formatted.alias("formatted"), F.aggregate("turns", state, step)["spans"].alias("loss_spans"))


def parsed(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text, as they were before rendering) and loss_text, read back from formatted and loss_spans."""
    parts = F.filter(F.split("formatted", _quoted(OPEN), -1), lambda _, i: i > 0)
    turn = lambda p: F.struct(
        unescape(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(CLOSE + "\n"))).alias("text"),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["begin"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.select("conv_id", F.transform(parts, turn).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


#: Events of a row of log_of().
EVENTS = 8


def log_of(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, message, role, text) as a streamed log: a first answer in a delta is regenerated, the next one's begin is edited, and three deltas bring the text."""
    text = F.coalesce("text", F.lit(""))
    third = F.floor(F.length(text) / 3).cast("int")
    part = lambda k: F.substr(text, third * k + 1, third) if k < 2 else F.substr(text, third * 2 + 1, F.length(text))
    steps = [("message", F.lit("")), ("delta", part(2)), ("regenerate", F.lit("")), ("delta", part(1)), ("edit", part(0)), ("delta", part(1)), ("delta", part(2))]
    row = lambda k, kind, text: F.struct((F.coalesce(F.col("turn"), F.lit(-1)) * EVENTS + k).cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    events = F.explode(F.array(*(row(k, kind, text) for k, (kind, text) in enumerate(steps))))
    return conversations.select(F.col("conv_id").cast("long"), F.col("message"), F.coalesce("role", F.lit("")).alias("role"), events.alias("e")).select("conv_id", "message", "role", "e.*")


def op4_event_chat(spark, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -1, read back from the formatted text."""
    extra = "SELECT -1L AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(spark.sql(extra))
    # A message's name must tell rows of one turn apart: its turn, role, text and which of equal rows it is.
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    rows = rows.withColumn("message", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "copy"))
    back = parsed(rendered(folded(log_of(rows))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


OP4_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
     e AS (SELECT *, length(replace(text, '␛', '␛␛')) + len(regexp_extract_all(text, '<(?:[|]im_start[|]>|[|]im_end[|]>|[|]endoftext[|]>|/?s>|<SYS>>|</SYS>>)|\\[/?INST\\]')) AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + body + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
