"""Hard negatives, source divergence and language identification, against plain Python."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, hard_negatives, language, simhash_wide, toxicity


def tuples(df):
    return [tuple(r) for r in df.collect()]


# ---- hard negatives
def brute_negatives(data, scale=256):
    good = [(i, label, [max(-(2**24), min(2**24, int(np.floor(scale * float(np.float32(x)))))) for x in v]) for i, label, v in data]
    out = []
    for a, (ident, label, v) in enumerate(good):
        if ident % 100:
            continue
        score = [sum(x * y for x, y in zip(v, w)) for _, _, w in good]
        by = lambda j: (-score[j], good[j][0])
        for p in sorted((j for j in range(len(good)) if j != a and good[j][1] == label), key=by)[:5]:
            fits = sorted((j for j in range(len(good)) if good[j][1] != label and 80 * score[p] <= 100 * score[j] <= 100 * score[p]), key=by)[:5]
            out += [(ident, good[p][0], k + 1, good[j][0], score[p], score[j]) for k, j in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["plain", "ties", "huge", "one label", "hot label"])
def test_negatives_equal_brute_force(spark, kind, monkeypatch):
    rng = random.Random(kind)
    data = []
    for n in range(260):
        i = n * 10 if kind != "ties" else n % 130 * 10
        v = [float(rng.randrange(-1, 3)) if kind == "ties" else rng.gauss(0.3, 1) * (3e4 if kind == "huge" else 1) for _ in range(rng.choice([7, 7, 7, 4, 0]))]
        label = {"one label": 3, "hot label": 1 if rng.random() < 0.6 else rng.randrange(40)}.get(kind, rng.randrange(4))
        data.append((i, label, v))
    odd = [(100, None, [1.0]), (None, 1, [1.0]), (200, 1, None), (300, 1, [None]), (400, 1, [float("nan")]), (500, 1, [float("-inf")])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in data + odd], "vec_id long, label int, embedding array<float>, row int, v int, rank int")
    for name, value in (("TILE_ANCHORS", 7), ("TILE_ROWS", 19), ("RANGE_ROWS", 100), ("LEAST_CHUNK", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    got = hard_negatives.mined(hard_negatives.in_order(df), F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuples(got)) == brute_negatives(data)


def test_no_rows_no_negatives(spark):
    df = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    for some in (df, df.limit(0)):
        assert not tuples(hard_negatives.mined(hard_negatives.in_order(some), F.col("vec_id") % 100 == 0))


def test_least_scores_dont_overflow():
    for x in [0, 1, 4, 5, 99, 100, 101, 2**62, 2**63 - 1]:
        assert int(hard_negatives.least_score(np.array([x]))[0]) == -(-80 * x // 100)


# ---- divergence of sources
def brute_divergence(data, least_docs, top=10):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in data]
    seen, counts, overall = collections.Counter(), collections.Counter(), collections.Counter()
    for lang, source, terms in docs:
        seen.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
        overall.update((lang, t) for t in terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for (of, t), n in seen.items() if of == lang and n >= least_docs)
        share = lambda c: [1 + (x + 2) * 10**9 // (sum(c) + 2 * len(kept)) for x in c]
        sources = sorted({d[1] for d in docs if d[0] == lang})
        n = {s: [counts[lang, s, t] for t in kept] for s in sources}
        p, q = {s: share(n[s]) for s in sources}, share([overall[lang, t] for t in kept])
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(-sum(map(f, p[s], p[o])), o) for o in sources if o != s]
            terms = [(-f(x, y), t) for x, y, c, t in zip(p[s], q, n[s], kept) if c and x > y]
            for part, found in (("pair", pairs), ("term", terms)):
                order = sorted(found, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(order) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(32, 16384, 64), (2, 3, 2), (1, 1, 1)])
def test_divergence_equals_brute_force(spark, sizes):
    rng = random.Random(3)
    words = ["Alpha", "béta", "gamma2x", "DELTA", "日本", "Éclair", "zz", "q"]
    data = [(" ".join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", "en", "en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", "ü", None])) for _ in range(150)]
    data += [(None, "en", "empty"), ("", "xx", "one"), ("123 _", "xx", "two"), (None, None, None), ("hot " * 50_000, "en", "a")] + data[:10]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in data], "text string, lang string, source string, n int, term string, block int")
    got = divergence.audited(df, 10, 10, *sizes)
    assert sorted(tuples(got)) == brute_divergence(data, 10)


def test_divergence_of_nothing(spark):
    assert not tuples(divergence.audited(spark.createDataFrame([], "text string, lang string, source string")))


def test_large_counts_are_exact(spark):
    cases = [(0, 1), (5, 7), (9 * 10**12, 9 * 10**12 + 3), (10**12 + 7, 3 * 10**15)]
    c, t = (np.array(x, np.int64) for x in zip(*cases))
    assert divergence.shares(c + 2, t).tolist() == [1 + (a + 2) * 10**9 // b for a, b in cases]
    df = spark.createDataFrame([(a, b - 2, 1) for a, b in cases], "n long, total long, kept long")
    assert [r[0] for r in df.select(divergence.share("n", "total", "kept")).collect()] == [1 + (a + 2) * 10**9 // b for a, b in cases]


# ---- languages
SAMPLES = {"xx": ["kala", "mato", "rupi", "senta", "holu"], "yy": ["schrint", "gluck", "zwerg", "knopfe", "strahl"], "zz": ["øre", "ærlig", "blå", "gått", "språk"]}


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(SAMPLES[lang]) for _ in range(rng.choice([1, 3, 40, 400]))), lang) for i, lang in enumerate(rng.choice(list(SAMPLES)) for _ in range(n))]


def test_windows_cover_every_run_of_bytes():
    rng = np.random.default_rng(1)
    for lengths in ([0, 1, 256, 257, 252, 0, 1000], [5], [0], []):
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        raw = rng.integers(1, 255, int(offsets[-1])).astype(np.uint8)
        some, text, size = language.windows(raw, offsets)
        for i, n in enumerate(lengths):
            mine = [some[k, : size[k]].tobytes() for k in np.flatnonzero(text == i)]
            whole = raw[offsets[i] : offsets[i + 1]].tobytes()
            assert bool(mine) == bool(n)
            for k in range(max(0, n - 4)):
                assert any(whole[k : k + 5] in w for w in mine)


def test_gradient_steps_learn_and_responses_equal_plain_sums():
    docs = corpus(200, 1)
    raw = np.frombuffer("".join(t for _, t, _ in docs).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for _, t, _ in docs)])
    some, text, size = language.windows(raw, offsets)
    langs = sorted(SAMPLES)
    model = language.fit(some, size, np.array([langs.index(docs[i][2]) for i in text]), langs, 150)
    response = model.responses(some[:2])
    for place in (0, 7):
        for filt in (0, 20, 63):
            width = language.WIDTHS[filt // language.FILTERS]
            want = sum(float(model.embed[some[1, place * language.STRIDE + k]] @ model.filters[k * language.EMBED : (k + 1) * language.EMBED, filt]) for k in range(width))
            assert abs(want - response[1, place, filt]) < 1e-3
    best, score = language.judged(model, raw, offsets)
    assert np.mean([langs[b] == lang for b, (_, _, lang) in zip(best, docs)]) > 0.95 and ((score >= 0) & (score <= 1)).all()


def test_held_out_languages_and_odd_texts(spark):
    docs = corpus(400, 2)
    odd = [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 !? ١", "yy"), (1003, "日本", None), (None, "kala mato", None), (1004, "kala " * 200_000, "xx"), (0, docs[0][1], docs[0][2])]
    df = spark.createDataFrame([(*r, 0.5) for r in docs + odd], "doc_id long, text string, lang string, score double")
    model = language.train(df.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    got = collections.defaultdict(list)
    for i, lang, score in tuples(language.identified(df, model)):
        assert 0 <= score <= 1
        got[i].append(lang)
    held = [(i, lang) for i, _, lang in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i][0] == lang for i, lang in held]) > 0.9
    assert [got[i] for i in (1000, 1001, 1002)] == [["und"]] * 3
    assert got[1003][0] in SAMPLES and got[None] == ["xx"] and got[1004] == ["xx"] and len(got[0]) == 2


def test_languages_without_anything_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, "more", None)], "doc_id long, text string, lang string")
    model = language.train(df)
    assert sorted(tuples(language.identified(df, model))) == [(1, "und", 0.0), (2, "und", 0.0)]
    one = language.train(df.withColumn("lang", F.lit("qq")))
    assert {r[1] for r in tuples(language.identified(df, one))} == {"qq"}
    assert not tuples(language.identified(df.limit(0), one))


# ---- toxicity: the fit against plain loops
def test_noisy_or_fit_equals_plain_loops(monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    docs = [(d, [[rng.randrange(12) for _ in range(rng.randrange(4))] for _ in range(rng.randrange(1, 5))]) for d in range(40)]
    y = np.array([float(any(0 in s for s in sentences) or rng.random() < 0.1) for _, sentences in docs])
    weights = np.array([rng.choice([0.5, 1.0, 2.0]) for _ in docs])
    rows = [(d, s) for d, sentences in docs for s in sentences]
    monkeypatch.setattr(toxicity, "STEPS", 40)
    model = toxicity.fit(y, weights, np.arange(12).astype(np.uint64), np.array([d for d, _ in rows]), np.ones(len(rows)), np.repeat(np.arange(len(rows)), [len(s) for _, s in rows]), np.array([w for _, s in rows for w in s], np.int64))
    theta, mean, square = [0.0] * 12 + [toxicity.FIRST_BIAS], [0.0] * 13, [0.0] * 13
    for step in range(1, 41):
        grad = [toxicity.RIDGE * t for t in theta[:-1]] + [0.0]
        for (d, sentences), label, weight in zip(docs, y, weights):
            odds = [theta[-1] + sum(theta[w] for w in s) for s in sentences]
            # 1 - prod(1 - p) is the chance of a toxic document.
            clean = np.prod([1 / (1 + np.exp(z)) for z in odds])
            slope = weight * (1.0 if not label else 1 - 1 / (1 - clean))
            for s, z in zip(sentences, odds):
                g = slope / (1 + np.exp(-z))
                grad[-1] += g
                for w in s:
                    grad[w] += g
        for i, g in enumerate(grad):
            mean[i], square[i] = 0.9 * mean[i] + 0.1 * g, 0.99 * square[i] + 0.01 * g * g
            theta[i] -= toxicity.RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    assert np.allclose(np.append(model.weights, model.bias), theta, atol=1e-8) and model.weights.argmax() == 0 and len(words) == len(model.words)


# ---- near-duplicates without an id
def test_repeated_rows_without_an_id_leave_one_whatever_else_repeats(spark):
    text, other = "one two three four five six seven eight nine ten", "some quite different words stand here in this longer text"
    base = [(None, text), (None, text), (5, other)]
    for more in ([], [(5, other)], [(7, other + " again and again")] * 2):
        got = simhash_wide.deduplicated(spark.createDataFrame(base + more, "doc_id long, text string"))
        assert [r["text"] for r in got.collect() if r["doc_id"] is None] == [text]
