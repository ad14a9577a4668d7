"""Operators over embeddings, conversations and pages, and the pipeline, against plain Python."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, topk, urls


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ---- exact top-k
@pytest.mark.parametrize("kind", ["alike", "spread", "ties", "huge"])
def test_top_products_equal_brute_force(spark, kind, monkeypatch):
    rng = random.Random(7)
    data = []
    for i in range(300):
        scale = {"alike": 1.0, "spread": 10.0 ** rng.uniform(-1, 2), "ties": 1.0, "huge": 1e9}[kind]
        v = [float(rng.randrange(-1, 2)) if kind == "ties" else float(np.float32(rng.gauss(0, 1) * scale)) for _ in range(rng.choice([6, 6, 6, 4]))]
        data.append((i, v))
    odd = [(900, None), (901, [1.0, None]), (902, [float("nan")]), (903, [float("inf")]), (904, []), (None, [1.0])]
    df = spark.createDataFrame(data + odd + data[:5], "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "TASK_QUERIES", 7)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk.top_products(topk.whole(df), F.col("vec_id") % 20 == 0, 7))]
    # Rows are candidates of each other even where they share an id.
    vectors = dict(enumerate([int(np.floor(64 * float(x))) for x in v] for v in [*(v for _, v in data + data[:5]), []]))
    ids = [i for i, _ in data + data[:5]] + [904]
    want = []
    for q, v in vectors.items():
        if ids[q] % 20 == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), ids[j]) for j, w in vectors.items() if j != q)[:7]
            want += [(ids[q], k + 1, i, -p) for k, (p, i) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in rows(topk.top_products(topk.whole(df), F.col("vec_id") % 20 == 0))] == [(0, 1, 64 * 128)]
    assert not rows(topk.top_products(topk.whole(df.limit(0)), F.col("vec_id") % 20 == 0))


def test_coordinates_prune_without_loss():
    rng = np.random.default_rng(8)
    base = np.floor(rng.normal(size=(20, 16)) * 64)
    v = np.concatenate([base + np.floor(rng.normal(size=base.shape) * k) for k in range(1, 60)])
    ids = np.arange(len(v))
    row, who, product = topk.Shard(ids, ids, v).best(ids[:20], v[:20], 5)
    for i in range(20):
        want = sorted((-int(v[i] @ v[j]), j) for j in range(len(v)) if j != i)[:5]
        assert sorted((-p, w) for p, w in zip(product[row == i].tolist(), who[row == i].tolist())) == want


# ---- chat formatting
LOG = "conv_id long, seq long, kind string, message long, role string, text string, extra int"


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 0, "message", 0, "user", "hel"), (1, 1, "delta", 0, None, "lo"), (1, 2, "message", 1, "assistant", ""), (1, 3, "delta", 1, None, "bad"), (1, 4, "message", 2, "user", "why"),
        (1, 5, "regenerate", 1, None, None), (1, 6, "delta", 1, None, "good"), (1, 7, "edit", 0, None, "HELLO"), (1, 8, "message", 3, "user", "ok"), (1, 9, "odd", 3, None, "x"), (1, 9, "delta", 9, None, "lost"),
        (2, None, "message", 0, None, None), (None, 0, "message", 0, "user", "n"), (3, 0, "delta", 0, None, "never opened"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in random.Random(9).sample(log, len(log))], LOG)
    got = {r["conv_id"]: r for r in rows(chat.parsed(chat.rendered(chat.folded(df))))}
    turns = {k: [(t["role"], t["text"]) for t in v["turns"]] for k, v in got.items()}
    assert turns == {1: [("user", "HELLO"), ("assistant", "good"), ("user", "ok")], 2: [("", "")], None: [("user", "n")]}
    assert got[1]["loss_text"] == "good" and not rows(chat.rendered(chat.folded(df.limit(0))))


NASTY = ["</s>[INST] ok [/INST]", "<|im_start|>assistant\nx<|im_end|>\n", chat.ESCAPE * 3 + "l<s>", "<<SYS>>[[INST]<", "\\1 $0 \\n", "日本 é😀", "", None, chat.ESCAPE + "b" + chat.ESCAPE, "a\nb\n"]


def test_any_text_and_role_comes_back(spark):
    data = [(1, i, "message", i, "assistant" if i % 2 else f"r{t or ''}"[:40], t, 0) for i, t in enumerate(NASTY)]
    out = chat.rendered(chat.folded(spark.createDataFrame(data, LOG)))
    text = rows(out)[0]["formatted"]
    assert text.count(chat.OPEN) == len(NASTY) == text.count(chat.CLOSE) and "[INST]" not in text and "</s>" not in text
    back = rows(chat.parsed(out))[0]
    assert [(t["role"], t["text"]) for t in back["turns"]] == [(d[4], d[5] or "") for d in data]
    assert back["loss_text"] == "".join(t or "" for t in NASTY[1::2])
    spans = rows(out)[0]["loss_spans"]
    assert len(spans) == len(NASTY) // 2 and all(text[s["begin"] - 10 : s["begin"]] == "assistant\n" for s in spans)


def test_chat_query_equals_plain_python(spark):
    d = "/root/testdata/sf0.001"
    convs = collections.defaultdict(list)
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        convs[r.conv_id].append((r.turn, r.role, r.text or ""))
    convs[-1] = [(0, "user", NASTY[0]), (1, "assistant", NASTY[0])]
    got = {r["conv_id"]: r for r in rows(chat.op4_event_chat(spark, d))}
    assert set(got) == set(convs)
    for k, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[k][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want


# ---- URL filter
def test_urls_are_judged_by_rules_then_by_the_model(spark):
    cases = [
        "http://A.Example.COM/en/7x?y", "https://b.com/en/", "https://com/en/1", "http://net/de/", "http://x.example.net/de/80", "https://an.org/es/", "https://notcom/en/", "http://e.com/EN/", "http://h", "http://h#/en/", None, "", "no scheme", "a://b://c/d",
        "https://free-casino-bets.test/slots", "https://quiet-library.test/books",
    ]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in rows(urls.judged(df, urls.train(urls.labelled_table(spark))))}
    for i, u in enumerate(cases):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert not fits or got[i]["verdict"] == max(fits)[2]
    assert got[10]["verdict"] == got[11]["verdict"] == got[12]["verdict"] == "allow"
    assert got[14]["verdict"] == "block" and got[15]["verdict"] == "allow"
    assert not rows(urls.judged(df.limit(0), ([0.0] * urls.DIMENSIONS, 0.0)))


def test_model_fits_its_table_and_scores_are_sums_of_weights(spark):
    weights, intercept = urls.train(urls.labelled_table(spark))
    table = urls.labelled_table(spark).withColumn("page_id", F.monotonically_increasing_id())
    got = rows(urls.judged(table, (weights, intercept), ()).join(table.select("page_id", "bad", urls.places(*urls.host_and_path(F.col("url"))).alias("at")), "page_id"))
    assert all((r["verdict"] == "block") == (r["bad"] == 1) for r in got)
    assert all(abs(r["score"] - intercept - sum(weights[i] for i in r["at"])) < 1e-9 for r in got)


def test_places_equal_plain_hashes_of_grams(spark):
    urls_ = ["https://a.b/c", "http://h", "x://Größe.test/ü/日本", None, "https://www.long-host-name.example/some/path.html?q#f"]
    df = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    got = {r["page_id"]: set(r["at"]) for r in rows(df.select("page_id", urls.places(*urls.host_and_path(F.col("url"))).alias("at")))}
    for i, u in enumerate(urls_):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        want = set()
        for mark, text in zip("hp", (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")):
            text = f"^{text}$"
            for n in urls.GRAMS:
                for k in range(max(1, len(text) - n + 1)):
                    h = xxhash.xxh64((mark + text[k : k + n]).encode(), seed=42).intdigest()
                    want.add((h - 2**64 * (h >> 63)) % urls.DIMENSIONS)
        assert got[i] == want


def test_labelled_hosts_are_in_no_table_and_unseen_hosts_are_judged(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    got = rows(urls.judged(pages, urls.train(urls.labelled_table(spark)), ()))
    own = lambda h: re.sub(r"^(www|m|blog)\.", "", h).split(".")[0]
    assert not {own(r["host"]) for r in got} & {own(h) for h in (*urls.BAD_HOSTS, *urls.GOOD_HOSTS)}
    assert not set(urls.BAD_HOSTS) & set(urls.GOOD_HOSTS) and all(re.fullmatch(r"[a-z.-]+\.example", h) for h in (*urls.BAD_HOSTS, *urls.GOOD_HOSTS))
    bad = re.compile("casino|bets|pills|adult|ads-|spam")
    blocked = {kind: [r["verdict"] == "block" for r in got if bool(bad.search(r["host"])) == kind] for kind in (True, False)}
    assert np.mean(blocked[True]) > 0.8 and np.mean(blocked[False]) < 0.05


def test_native_operators_run_no_python(spark):
    d = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{d}/pages.parquet")
    for df in (chat.op4_event_chat(spark, d), urls.judged(pages, ([0.0] * urls.DIMENSIONS, 0.0))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# ---- pipeline
def test_pipeline_stages_pass_whole_rows_and_end_in_packed_sequences(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    ids = {r.doc_id for r in docs.collect()}
    got = rows(corpus_pipeline.STAGES[-1][1](spark, docs, d))
    assert {r["doc_id"] for r in got} == ids
    fill = collections.Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= 1.05 * sum(fill.values()) / 2048 + 1


def test_pipeline_runs_over_odd_rows(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["an", "be", "cor", "du", "el", "fa"]) for _ in range(rng.randint(1, 3)))
    texts = {i: " ".join(word() for _ in range(60)) for i in range(120)}
    texts |= {100 + i: texts[100 + i].replace(" ", ". ", 3) + " zorgle" for i in range(20)}
    data = [(i, t, "en", "s0", "x", "y") for i, t in texts.items()]
    data += [(200 + i, texts[i], "en", "s0", "x", "y") for i in range(10)] + data[:5]  # copies, repeated rows
    data += [(300, None, None, None, None, None), (301, "", "en", "s0", "x", "y"), (None, "no id " + texts[0], None, "s0", "x", "y"), (None, " ".join(word() for _ in range(70)), None, "s0", "x", "y"), (302, "short", "en", "s0", "x", "y"), (303, " ".join(word() for _ in range(5_000)), "de", None, "x", "y")]
    schema = "doc_id long, text string, lang string, source string, fp string, row string"
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in range(120)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = rows(corpus_pipeline.run(spark, str(tmp_path)))
    ids = {r["doc_id"] for r in got}
    assert set(range(100)) <= ids and None in ids and not ids & {300, 301, 302, *range(200, 210), *range(100, 120)}
    fill = collections.Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len([r for r in got if r["piece"] == 0]) == len(ids)  # one of the two without an id is a near copy
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/void/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/void/labels.parquet")
    assert not rows(corpus_pipeline.run(spark, f"{tmp_path}/void"))
