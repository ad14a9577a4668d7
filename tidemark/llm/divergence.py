"""How far the sources of a language are from each other in their words: a divergence for each pair, by group-block tiling.

A group is a language and a source.  Its count of each kept term is smoothed to a scaled
share p, and two groups differ by the sum over terms of floor((p - q)**2 / (p + q)).

The groups of a language are dealt into blocks, its terms into chunks; a panel has the
counts of one block for one chunk, packed.  Every pair of blocks is a tile; a tile's panels
go to as many tasks as its chunks fill stripes, and each task goes through its chunks one
after another, two panels at a time, adding up the submatrix of pairs.  Sums of stripes are
then added.  The vocabulary is never in one task, and neither are all groups.

All arithmetic is in integers.  Shares are divided in three steps of a thousand, so that
counts up to 9 * 10**15 hold.

Defined results: a null text, language or source counts as the empty one; a group without
terms and a language without kept terms have rows like others (of value 0 if nothing is
kept); repeated rows count each; a language of one source has no pairs; ties stand in the
order of items' UTF-8 bytes; columns besides text, lang and source are not read; an empty
table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.buffers import ascii_lower, blocks, distinct_spans, ragged, text_buffer
from tidemark.llm.shared import finished, map_arrow, map_batches, table, written

LEAST_DOCS, TOP_TERMS, SCALE, PRIOR = 10, 10, 10**9, 2
#: Groups of a block, terms of a chunk, chunks of a stripe, on average: both are dealt by hash.
BLOCK_GROUPS, CHUNK_TERMS, STRIPE_CHUNKS = 32, 16_384, 64
#: Bytes of text that are counted at once.
COUNT_BYTES = 1_000_000

_letter = np.zeros(256, bool)  # of a term: ASCII letters and all that is not ASCII
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _term_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each term."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _letter[raw]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    opens[inner] |= inside[1:-1][inner]
    closes[inner - 1] |= inside[1:-1][inner - 1]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(offsets, start, side="right") - 1


def _counted(batch: pa.RecordBatch):
    """A batch's terms by group, and a null term for each group."""
    lang, source = (batch.column(i).fill_null("") for i in (0, 1))
    code: dict[tuple[str, str], int] = {}
    group = np.array([code.setdefault(x, len(code)) for x in zip(lang.to_pylist(), source.to_pylist())], np.int64)
    names = pa.array([x for x, _ in code]), pa.array([x for _, x in code])
    zeros = np.zeros(len(code), np.int64)
    yield {"lang": names[0], "source": names[1], "term": pa.nulls(len(code), pa.string()), "n": zeros, "docs": zeros}
    raw, offsets = text_buffer(batch.column(2))
    for a, _, part, at in blocks(ascii_lower(raw), offsets, COUNT_BYTES):
        start, end, text = _term_spans(part, at)
        if not len(start):
            continue
        _, one, which = distinct_spans(part, start, end)
        # Documents first, then groups: what a document has often counts once among docs.
        pair, times = np.unique(text * len(one) + which, return_counts=True)
        text, which = np.divmod(pair, len(one))
        cell, where = np.unique(group[a + text] * len(one) + which, return_inverse=True)
        of, term = np.divmod(cell, len(one))
        data, edge = ragged(part, start[one], end[one] - start[one])
        terms = pa.Array.from_buffers(pa.large_string(), len(one), [None, pa.py_buffer(edge), pa.py_buffer(data)])
        yield {"lang": names[0].take(pa.array(of)), "source": names[1].take(pa.array(of)), "term": terms.take(pa.array(term)), "n": np.bincount(where, times, len(cell)).astype(np.int64), "docs": np.bincount(where, minlength=len(cell))}


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs: how often a group has a term, and in how many documents; a null term for each group."""
    seen = map_arrow(docs.select(F.col("lang").cast("string"), F.col("source").cast("string"), "text"), _counted, "lang string, source string, term string, n long, docs long")
    return seen.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), in decimals."""
    return F.expr(f"1 + cast(cast({count} + {PRIOR} as decimal(20, 0)) * {SCALE} as decimal(38, 0)) div cast({total} + {PRIOR} * {kept} as decimal(20, 0))")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / total) in steps of a thousand: exact while counts and totals are under 9 * 10**15."""
    whole, rest = np.divmod(counts, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sum over columns of floor((p - q)**2 / (p + q)) for each row of p and each of q; a row of p at a time."""
    out = np.zeros((len(p), len(q)), np.int64)
    for i in range(len(p)):
        apart, both = p[i] - q, (p[i] + q).astype(np.uint64)
        out[i] = ((apart * apart).astype(np.uint64) // both).sum(1)
    return out


def _packed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """A panel: places of groups, numbers of terms and counts, as bytes."""
    columns = [pa.array([rows[c].to_numpy().astype(kind).tobytes()], pa.binary()) for c, kind in (("pos", "<i4"), ("no", "<i4"), ("n", "<i8"))]
    return pa.table([*(pa.array([k.as_py()], k.type) for k in key), *columns], ["lang", "block", "chunk", "pos", "no", "n"])


def _dense(row: dict) -> np.ndarray:
    """Shares of a panel's groups, a row each, over all terms of its chunk."""
    counts = np.zeros((len(row["members"]), row["terms"]), np.int64)
    if row["n"]:
        counts[np.frombuffer(row["pos"], "<i4"), np.frombuffer(row["no"], "<i4")] = np.frombuffer(row["n"], "<i8")
    total = np.array([m["total"] for m in row["members"]], np.int64) + PRIOR * row["kept"]
    return shares(counts + PRIOR, np.maximum(total, 1)[:, None])


_TILE = "lang string, a string, b string, value long"


def _tiles(batches):
    """Goes through panels in the order of tiles and chunks, two panels at a time, and gives each tile's sums when it ends."""
    key, first, total, names = None, None, None, None

    def ended():
        if total is not None:
            a, b = np.nonzero(np.ones(total.shape, bool) if names[0] is not names[1] else np.triu(np.ones(total.shape, bool), 1))
            yield pa.record_batch({"lang": pa.array([key[0]] * len(a), pa.string()), "a": pa.array([names[0][i] for i in a], pa.string()), "b": pa.array([names[1][i] for i in b], pa.string()), "value": pa.array(total[a, b], pa.int64())})

    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            at = row["lang"], row["x"], row["y"], row["stripe"]
            if at != key:
                yield from ended()
                key, first, total = at, None, None
            mine = [m["source"] for m in row["members"]]
            if row["x"] != row["y"] and first is None:
                first = _dense(row), mine
                continue
            second = _dense(row)
            p, names = (second, (mine, mine)) if first is None else (first[0], (first[1], mine))
            more = differences(p, second)
            total, first = more if total is None else total + more, None
    yield from ended()


def audited(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, block_groups: int = BLOCK_GROUPS, chunk_terms: int = CHUNK_TERMS, stripe_chunks: int = STRIPE_CHUNKS) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank, from rows of (text, lang, source)."""
    counts = written(term_counts(docs), "counts")
    words = counts.where(F.col("term").isNotNull())
    kept = written(words.groupBy("lang", "term").agg(F.sum("n").alias("overall"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("overall").alias("lang_total"))
    chunks = F.greatest(F.lit(1), F.ceil(F.coalesce("kept", F.lit(0)) / chunk_terms)).cast("int")
    chunked = kept.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), chunks).cast("int"))
    # Dealt by chunk: a language's terms must not all be numbered in the task of its join.
    numbered = chunked.repartition("lang", "chunk").withColumn("no", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).select("lang", "term", "overall", "chunk", "no")
    mine = written(words.drop("docs").join(numbered, ["lang", "term"]), "kept-counts")

    groups = counts.where(F.col("term").isNull()).select("lang", "source")
    groups = groups.join(mine.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.join(groups.groupBy("lang").agg(F.ceil(F.count("*") / block_groups).cast("int").alias("blocks")), "lang").fillna(0, ["total", "kept", "lang_total"])
    groups = groups.withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    groups = written(groups.withColumn("pos", F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1), "groups")

    panels = mine.join(groups.select("lang", "source", "block", "pos"), ["lang", "source"]).select("lang", "block", "chunk", "pos", "no", "n")
    packed = panels.groupBy("lang", "block", "chunk").applyInArrow(_packed, "lang string, block int, chunk int, pos binary, no binary, n binary")
    blocks_ = groups.groupBy("lang", "block", "blocks", "kept").agg(F.sort_array(F.collect_list(F.struct("pos", "source", "total"))).alias("members"))
    cells = blocks_.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    sizes = numbered.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("terms"))
    cells = cells.join(packed, ["lang", "block", "chunk"], "left").join(sizes, ["lang", "chunk"], "left").fillna(0, ["terms"])
    # A panel goes to the tiles of its block with each block, itself included.
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("lang", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.floor(F.col("chunk") / stripe_chunks).cast("int").alias("stripe"), "chunk", "block", "members", "kept", "terms", "pos", "no", "n")
    tile = "lang", "x", "y", "stripe"
    sums = map_batches(cells.repartition(*tile).sortWithinPartitions(*tile, "chunk", "block"), _tiles, _TILE).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("of"), "value").select("lang", "of.source", "of.item", "value")

    told = mine.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share("n", "total", "kept").alias("p"), share("overall", "lang_total", "kept").alias("q"))
    told = told.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(both, "pair").union(ranked(told, "term").where(F.col("rank") <= top_terms))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Every group of documents: its divergence from each other source of its language, and its most telling terms."""
    return finished(spark, lambda: audited(table(spark, sf_dir, "documents").select("text", "lang", "source")), "op12")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents),
     t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
     k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
     l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
     g AS (SELECT DISTINCT lang, source FROM d),
     c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
     s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
     x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                  CAST(1 + CAST(coalesce(c.n, 0) + 2 AS HUGEINT) * 1000000000 // CAST(coalesce(s.total, 0) + 2 * l.v AS HUGEINT) AS HUGEINT) AS p,
                  CAST(1 + CAST(k.n + 2 AS HUGEINT) * 1000000000 // CAST(l.total + 2 * l.v AS HUGEINT) AS HUGEINT) AS q
           FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
     f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
     terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM x WHERE n > 0 AND p > q),
     u AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10
"""
