"""Operators over documents, against plain Python on small fixtures."""

import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe_codec, bytebpe, id_files, packing, quality, sequences, simhash, simhash_wide, suffix_tree, textstats, toxicity
from tidemark.llm import buffers
from tidemark.llm.buffers import packed, text_buffer, unpacked, word_spans
from tidemark.llm.xxh import xxh64

SYLLABLES = ["an", "be", "cor", "du", "el", "fa", "gi", "ho", "ka", "li"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp string, row string"


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(15, 80)) for _ in range(n)]
    texts += [texts[0], texts[1] + " x", "", None, "one", " \n\t ", "Ünï cödé 日本語 's don't\r\n", "a" * 5000, "A. a! a?"]
    return [(i, t, "en", "s0", 0, "x", "y", "z") for i, t in enumerate(texts)] + [(0, texts[0], None, None, 0, "x", "y", "z"), (None, "no id", "de", "", 0, "x", "y", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


def twins(n=2048):
    """Two words over a and b that hashes by polynomials modulo a power of two don't tell apart."""
    x, y = "a", "b"
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("keys", ["ours", "one"])
@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=12), min_size=1, max_size=12))
def test_spans_are_told_apart_by_their_bytes(keys, words):
    words = [*words, *twins(), "x" * 3000, "x" * 2999 + "y", *twins(64)]
    raw, offsets = text_buffer(pa.array(words + words))
    with pytest.MonkeyPatch.context() as patch:
        if keys == "one":  # all longer spans have one key
            patch.setattr(buffers, "xxh64", lambda raw, start, length, seed: np.zeros(len(start), np.uint64))
            patch.setattr(buffers, "_LONG", 10_000)
        _, one, which = buffers.distinct_spans(raw, offsets[:-1], offsets[1:])
    data = [w.encode() for w in words + words]
    assert len(one) == len(set(data)) and all(data[one[w]] == d for w, d in zip(which, data))


def test_twins_have_their_own_counts_and_ids():
    texts = [x for n in (1024, 2048, 4096) for x in twins(n)]
    lines = "\n".join(texts)
    raw, offsets = text_buffer(pa.array([lines, lines + "\n" + texts[1], " ".join(texts * 2)]))
    got = textstats.counts(raw, offsets)
    assert got["n_dup_lines"].tolist() == [0, 1, 0] and got["n_repeat_words"].tolist() == [0, 0, 12]
    path = public_tokenizers.path(bpe_codec.RANKS)
    merges = bytebpe.from_ranks(path)
    strings = bytebpe.ByteTable(merges.strings)
    for t in texts:  # the cache is kept from text to text
        raw, offsets = text_buffer(pa.array([t]))
        ids, at = merges.encode(raw, offsets)
        assert strings.join(ids, at)[0].tobytes().decode() == t
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        merges, library = bytebpe.from_json(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        for t in texts:
            assert merges.encode(*text_buffer(pa.array([t])))[0].tolist() == library.encode(t, add_special_tokens=False).ids


# ---- buffers
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\r\x0b\x0c\xa0é日'", max_size=30), max_size=8))
def test_words_are_those_between_ascii_blanks(texts):
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    start, end, by_text = word_spans(raw, offsets)
    words = [raw[a:b].tobytes() for a, b in zip(start, end)]
    assert [words[a:b] for a, b in zip(by_text, by_text[1:])] == [t.encode().split() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=90), max_size=8), st.integers(0, 2**32))
def test_hashes_equal_the_library(parts, seed):
    raw = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    assert xxh64(raw, np.cumsum(size) - size, size, seed).tolist() == [xxhash.xxh64_intdigest(p, seed) for p in parts]


def test_packed_arrays_come_back():
    for kind in ("<u8", "<i8", "<i4"):
        x = np.arange(-3, 100).astype(kind)
        assert (unpacked(packed(x), kind) == x).all() and not len(unpacked(packed(x[:0]), kind))


# ---- byte-level BPE
def reference(path):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = "abst'dmrevlLS  \n\t 　  12٣²,.!?-’日本😀́\r\x85é"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=6))
def test_rank_files_encode_as_the_library(texts):
    path = public_tokenizers.path(bpe_codec.RANKS)
    merges, library = _cached(bytebpe.from_ranks, path), _cached(reference, path)
    raw, offsets = text_buffer(pa.array(texts))
    got = [ids[a:b].tolist() for _, _, ids, at in bytebpe.encode_texts(merges, raw, offsets, 20) for a, b in zip(at, at[1:])]
    assert got == [library.encode_ordinary(t) for t in texts]


_made = {}


def _cached(fn, path):
    return _made.setdefault((fn, path), fn(path)) if (fn, path) in _made else _made.setdefault((fn, path), fn(path))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET + "ΣÄİ<|>", max_size=40), min_size=1, max_size=6))
def test_tokenizer_files_encode_as_the_library(name, texts):
    path = public_tokenizers.path(name)
    merges = _cached(bytebpe.from_json, path)
    library = _cached(Tokenizer.from_file, path)
    library.encode_special_tokens = True
    texts = [*texts, "<|endoftext|> <|startoftext|>", "a" * 300, "it's" * 40]
    raw, offsets = text_buffer(pa.array(texts))
    got = [ids[a:b].tolist() for _, _, ids, at in sequences.with_end(merges, raw, offsets, 7) for a, b in zip(at, at[1:])]
    assert got == [library.encode(t, add_special_tokens=False).ids + [7] for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab \n'sÄİ1<|>", "e\u0301", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext"]), max_size=9), max_size=6))
def test_added_tokens_encode_as_the_library_as_loaded(name, texts):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    texts = ["".join(t) for t in texts] + ["a <|endoftext|> b", "<|endoftext|>", "", "<|endo", "ftext|>"]
    raw, offsets = text_buffer(pa.array(texts))
    got = [ids[a:b].tolist() for _, _, ids, at in sequences.with_end(_cached(bytebpe.from_json, path), raw, offsets, 7, sequences.added_tokens(path)) for a, b in zip(at, at[1:])]
    assert got == [library.encode(t, add_special_tokens=False).ids + [7] for t in texts]


def test_pieces_and_files_hold_added_tokens(spark):
    texts = ["a <|endoftext|> b", "x<|startoftext|><|endoftext|>", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path(packing.VOCABULARY)
    crc = lambda p, t, end, kind: zlib.crc32(np.array([*Tokenizer.from_file(p).encode(t or "", add_special_tokens=False).ids, end], kind).tobytes())
    assert {r["doc_id"]: r["ids_crc32"] for r in rows(packing.pieces(df, path))} == {i: crc(path, t, packing.END_ID, "<u4") for i, t in enumerate(texts)}
    path = public_tokenizers.path(id_files.VOCABULARY)
    assert {r["doc_id"]: zlib.crc32(bytes(r["ids"])) for r in rows(id_files.encoded(df, path))} == {i: crc(path, t, id_files.END_ID, "<u2") for i, t in enumerate(texts)}


def test_codec_round_trip_and_offsets(docs, empty):
    path = public_tokenizers.path(bpe_codec.RANKS)
    coded = bpe_codec.encode(docs, path, keep=["doc_id", "text"])
    for r in rows(bpe_codec.decode(coded, path, keep=["doc_id", "text", "byte_offsets"])):
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["byte_offsets"] == sorted(r["byte_offsets"]) and r["byte_offsets"][:1] in ([], [0])
    library = reference(path)
    for r in rows(bpe_codec.digests(docs, path)):
        texts = {t or "" for i, t, *_ in corpus() if i == r["doc_id"]}
        assert r["decoded_sha256"] in {hashlib.sha256(t.encode()).hexdigest() for t in texts}
        assert r["n_tokens"] in {len(library.encode_ordinary(t)) for t in texts}
    assert not rows(bpe_codec.digests(empty, path))


# ---- packing
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_never_overfills_and_leaves_no_gap(lengths):
    bins, at, fill = packing.best_fit(np.array(lengths, np.int64), 50)
    got = collections.defaultdict(list)
    for n, b, a in zip(lengths, bins, at):
        got[b].append((a, n))
    for b, items in got.items():
        end = 0
        for a, n in sorted(items):
            assert a == end
            end += n
        assert end == fill[b] <= 50
    if lengths:
        assert len(fill) <= -(-sum(lengths) * 2 // 50) + 1


def test_packing_covers_every_id_once(docs, empty):
    path = public_tokenizers.path(packing.VOCABULARY)
    got = rows(packing.pack(packing.pieces(docs.select("doc_id", "text"), path, capacity=64), packing.PIECES, capacity=64, slack=2))
    library = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, t, *_ in corpus():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) - (-(-len(ids) // 64) - 1) * 64
        cuts = [0, *range(head, len(ids), 64), len(ids)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        end = 0
        for a, n in sorted(items):
            assert a == end
            end += n
        assert end <= 64
    assert len(bins) <= 1.1 * sum(r["length"] for r in got) / 64 + 1
    assert not rows(packing.pack(packing.pieces(empty.select("doc_id", "text"), path), packing.PIECES))


# ---- files of ids
@pytest.mark.parametrize("file_docs", [1_000, 20])
def test_id_files_give_documents_back(docs, empty, file_docs):
    path = public_tokenizers.path(id_files.VOCABULARY)
    kind = id_files.id_type(bytebpe.from_json(path))
    library = Tokenizer.from_file(path)
    part = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL")
    cuts = id_files.ranges(part.select("doc_id"), file_docs)
    manifest = id_files.write(id_files.encoded(part.select("doc_id", "text"), path, cuts=cuts), len(cuts) + 1, kind, length=16)
    assert (manifest.count() > 1) == (file_docs == 20)
    got = {r["doc_id"]: r for r in rows(id_files.read_documents(manifest))}
    start = 0
    for i, t, lang, *_ in sorted((r for r in corpus() if r[0] is not None and r[2]), key=lambda r: r[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for m in rows(manifest):
        batch = id_files.opened(m["file"]).get_batch(0)
        assert batch.column(0).type.list_size == 16 and len(batch.column(0)[0]) == len(batch.column(1)[0]) == 16
    void = empty.select("doc_id", "text")
    assert not rows(id_files.read_documents(id_files.write(id_files.encoded(void, path, cuts=id_files.ranges(void.select("doc_id"))), 1, kind)))


def test_repeated_ids_stand_in_the_order_of_their_tokens(spark):
    path = public_tokenizers.path(id_files.VOCABULARY)
    df = spark.createDataFrame([(1, "b c"), (1, "a"), (1, "a"), (0, "z"), (None, "n")], "doc_id long, text string")
    runs = [[(r["doc_id"], r["start"], r["ids_crc32"]) for r in sorted(rows(id_files.read_documents(id_files.write(id_files.encoded(part, path), 1, "<u2"))), key=lambda r: r["start"])] for part in (df, df.repartition(3))]
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == [None, 0, 1, 1, 1]


# ---- statistics and quality
@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#|é", max_size=60), min_size=1, max_size=5))
def test_counts_equal_plain_python(texts):
    raw, offsets = text_buffer(pa.array(texts))
    got = textstats.counts(raw, offsets)
    for i, t in enumerate(texts):
        words = [w.decode() for w in t.encode().split()]
        grams = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert tuple(int(got[c][i]) for c in quality.COUNTS) == want


def test_outliers_go_and_the_rest_stays(spark, empty):
    rng = random.Random(2)
    data = [(i, prose(rng, rng.randint(40, 80)), "en", "s0", 0, "", "", "") for i in range(150)]
    data += [(1000 + i, " ".join(w + "###" for w in prose(rng, 60).split()), "en", "s0", 0, "", "", "") for i in range(10)]
    data += [(2000, None, None, None, 0, "", "", ""), (2001, "short", "en", "s1", 0, "", "", "")]
    df = spark.createDataFrame(data, DOCS)
    verdict = {r["doc_id"]: r for r in rows(quality.judged(df))}
    assert len(verdict) == len(data)
    assert all(verdict[i]["kept"] for i in range(150)) and not any(verdict[1000 + i]["kept"] for i in range(10))
    assert verdict[2000]["base_failed"] and verdict[2001]["base_failed"] and not verdict[2000]["kept"]
    kept = quality.kept_rows(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in rows(kept)} == set(range(150))
    assert not rows(quality.judged(empty))


def test_least_determinant_and_verdicts_equal_many_random_starts(spark):
    rng = np.random.default_rng(4)
    floors = [0.05, 0.05, 0.05]
    groups = {}
    for g in range(4):
        mix = rng.normal(size=(3, 3)) + 2 * np.eye(3)
        x = rng.normal(size=(60 + 20 * g, 3)) @ mix
        far = rng.normal(size=(6 + g, 3)) * 0.1 + 40
        groups[f"g{g}"] = np.concatenate([x, far])
    df = spark.createDataFrame([(g, *map(float, v)) for g, x in groups.items() for v in x], "g string, x0 double, x1 double, x2 double")
    got = {r["g"]: r for r in rows(quality.robust_estimates(df, floors))}
    factor = quality.consistency(3, quality.SHARE)

    def estimate(x):
        return x.mean(0), factor * np.cov(x.T, bias=True) + np.diag(np.square(floors))

    for g, x in groups.items():
        h, best = int(np.ceil(quality.SHARE * len(x))), np.inf
        for _ in range(200):
            mean, cov = estimate(x[rng.choice(len(x), 4, replace=False)])
            for _ in range(30):
                d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
                mean, cov = estimate(x[np.argsort(d, kind="stable")[:h]])
            if np.linalg.slogdet(cov)[1] < best:
                best, found = np.linalg.slogdet(cov)[1], (mean, cov)
        assert got[g]["n"] == len(x) and got[g]["determinant"] < best + 0.35  # bins of distance hold some more rows than h
        ours = np.einsum("ij,jk,ik->i", x - got[g]["mean"], np.array(got[g]["inverse"]).reshape(3, 3), x - got[g]["mean"])
        theirs = np.einsum("ij,jk,ik->i", x - found[0], np.linalg.inv(found[1]), x - found[0])
        clear = (theirs < 25) | (theirs > 50)
        assert ((ours > 36) == (theirs > 36))[clear].all() and (ours[-6:] > 36).all()


def test_consistency_factor():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200_000, 3))
    near = x[np.argsort((x**2).sum(1))[: int(0.75 * len(x))]]
    assert abs(quality.consistency(3, 0.75) * near.var() - 1) < 0.02


# ---- toxicity
def test_toxicity_learns_words_from_documents_and_finds_sentences(spark, empty):
    rng = random.Random(3)
    data, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        s = [prose(rng, 8) for _ in range(4)]
        if bad:
            s[rng.randrange(4)] += f" {rng.choice(['zorgle', 'blatz'])} x"
        data.append((i, ". ".join(s), "en", "s", 0, "", "", ""))
        labels.append((i, 1, int(bad)))
    df, lab = spark.createDataFrame(data, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, toxicity.learning_rows(lab))
    score = {r["doc_id"]: r["score"] for r in rows(toxicity.score(df, model))}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((score[i] >= 0.5) == (i % 5 == 0) for i in held)
    found = rows(toxicity.offending(df, model))
    assert found and all("zorgle" in r["sentence"] or "blatz" in r["sentence"] for r in found)
    text = {d[0]: d[1].encode() for d in data}
    assert all(text[r["doc_id"]][r["start"] : r["end"]].decode().strip() == r["sentence"] for r in found)
    odd = spark.createDataFrame([(1, None, None, None, 0, "", "", ""), (2, "", "", "", 0, "", "", ""), (None, "zorgle", "", "", 0, "", "", "")], DOCS)
    assert sorted(r["score"] < 0.5 for r in rows(toxicity.score(odd, model))) == [False, True, True]
    assert toxicity.clean_rows(odd, model).columns == odd.columns
    assert not rows(toxicity.score(empty, toxicity.train(empty, lab)))


# ---- suffix tree
def test_scores_equal_a_tree_of_plain_dictionaries(docs, empty):
    got = rows(suffix_tree.score(docs.select("doc_id", "text"), least=2, depth=3))
    data = [(i, t) for i, t, *_ in corpus()]
    words = [[*(t or "").encode().lower().split(), None] for _, t in data]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in data]
    counts = collections.Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    grams = [collections.Counter() for _ in range(4)]
    for ws, h in zip(words, held):
        if not h:
            seq = ["^", *ws]
            for k in (1, 2, 3):
                grams[k].update(tuple(seq[i - k : i + 1]) for i in range(k, len(seq)))
    for k in (1, 2, 3):  # a longer sequence needs all its parts
        kept = {g: c for g, c in grams[k].items() if c >= 2 and all(counts[w] >= 2 or w == "^" for w in g) and (k == 1 or (g[:-1] in grams[k - 1] and g[1:] in grams[k - 1]))}
        grams[k] = kept
    root = lambda w: (counts[w] + 1) / (n + v + 1)
    train_docs = held.count(False)
    states = {}

    def prob(context, w):
        for k in range(len(context), 0, -1):
            c = tuple(context[-k:])
            if c in states:
                listed, rest = states[c]
                return listed[w] if w in listed else rest * prob(c[1:], w)
        return root(w)

    for k in (1, 2, 3):
        by = collections.defaultdict(dict)
        for g, c in grams[k].items():
            by[g[:-1]][g[-1]] = c
        for context, nxt in by.items():
            times = (train_docs if context == ("^",) else counts[context[0]]) if k == 1 else grams[k - 1][context]
            p = {w: (c - suffix_tree.DISCOUNT) / times for w, c in nxt.items()}
            low = {w: prob(context[1:], w) for w in nxt}
            gain = sum(c * math.log(p[w] / low[w]) for w, c in nxt.items())
            if gain > suffix_tree.GAIN * len(nxt):
                states[context] = (p, (1 - sum(p.values())) / (1 - sum(low.values())))
    assert states
    want = []
    for (i, _), ws, h in zip(data, words, held):
        seq, total = ["^", *ws], 0.0
        for j in range(1, len(seq)):
            total += math.log10(prob(seq[max(0, j - 3) : j], seq[j]))
        base = sum(math.log10(root(w)) for w in ws)
        want.append((-1 if i is None else i, h, len(ws), sum(counts[w] > 0 for w in ws), n, base, total))
    have = [(-1 if r["doc_id"] is None else r["doc_id"], *(r[c] for c in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))) for r in got]
    assert len(have) == len(want)
    for x, y in zip(sorted(have), sorted(want)):
        assert x[:5] == y[:5] and abs(x[5] - y[5]) < 1e-9 and abs(x[6] - y[6]) < suffix_tree.STEP * x[2] + 1e-9
    for context in list(states)[:20]:  # what is known and one unknown word add up to one
        assert abs(sum(prob(list(context), w) for w in counts) + prob(list(context), b"\0unknown") - 1) < 1e-9
    assert not rows(suffix_tree.score(empty.select("doc_id", "text")))


# ---- near-duplicates
def test_fingerprints_and_components_equal_brute_force(docs, empty):
    got = rows(simhash.near_duplicates(docs.select("doc_id", "text")))
    prints = {}
    for i, t, *_ in corpus():
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[(i, t)] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {r["fp"] % 2**64 for r in got} == set(prints.values())
    label = {p: p for p in prints.values()}
    for _ in label:
        for p in label:
            label[p] = min(label[q] for q in label if (p ^ q).bit_count() <= 2)
    least = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    for r in got:
        assert r["component_id"] == least.get(label[r["fp"] % 2**64])
    assert len(got) == len(corpus()) and not rows(simhash.near_duplicates(empty.select("doc_id", "text")))


def test_links_lose_no_pair_within_the_threshold(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << bit
            fps.add(x)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    got = {tuple(sorted((a % 2**64, b % 2**64))) for a, b in simhash.links(df, 2).collect()}
    assert got == {tuple(sorted((a, b))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}


def test_golay_code_covers_within_three():
    patterns, starts = simhash.cosets(2)
    assert len(patterns[0]) == 2048 and (np.diff(starts[0]) == 1).all()
    assert [len(p) for p in patterns] == [2048, math.comb(23, 4), math.comb(23, 5)]


def test_components_of_a_long_chain(spark):
    n = 60
    order = random.Random(5).sample(range(n), n)
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in rows(simhash.components(edges))}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


def test_wide_stage_keeps_one_of_each_group(spark, empty):
    rng = random.Random(6)
    data = [(i, prose(rng, 120), "en", "s", 0, "", "", "") for i in range(60)]
    for i in range(20):
        words = data[i][1].split()
        words[rng.randrange(5, 115)] = "changed"
        data.append((100 + i, " ".join(words), "en", "s", 0, "", "", ""))
        data.append((200 + i, data[i][1], "en", "s", 0, "", "", ""))
    data.append(data[40])  # a repeated row
    df = spark.createDataFrame(data, DOCS)
    kept = simhash_wide.deduplicated(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in rows(kept)) == list(range(60))
    assert not rows(simhash_wide.deduplicated(empty))


def wide_keys(rng, distances):
    keys = []
    for _ in range(60):
        base = rng.getrandbits(253)
        for bits in (0, *distances):
            x = base ^ sum(1 << b for b in rng.sample(range(253), bits))
            keys.append([*((x >> 64 * k) & (2**64 - 1) for k in range(4)), rng.getrandbits(64), 0, rng.randint(80, 130)])
    return np.array(keys, np.uint64)


def test_compared_fingerprints_are_those_within_bits_and_sizes():
    keys = wide_keys(random.Random(8), (*range(30, 57), 60))
    b = keys[1::2][np.argsort(keys[1::2][:, -1], kind="stable")]
    a = keys[::2]
    rest = np.bitwise_count(a[:, None, :4] ^ b[None, :, :4]).sum(2)
    x, y = a[:, None, -1].astype(int), b[None, :, -1].astype(int)
    want = (rest <= simhash_wide.MOST_BITS) & (10 * np.minimum(x, y) >= 8 * np.maximum(x, y))
    assert {(i, j) for p, q, _ in simhash_wide._near(np.ascontiguousarray(a[:, :4]), a[:, -1], np.ascontiguousarray(b[:, :4]), b[:, -1]) for i, j in zip(p, q)} == set(zip(*np.nonzero(want)))


def test_anchors_bring_close_fingerprints_together():
    distances = (*range(0, 22), *[38] * 40)
    keys = wide_keys(random.Random(11), distances)
    homes = [set() for _ in keys]
    reach = [set() for _ in keys]
    for out, excess in ((homes, None), (reach, simhash_wide.EXCESS)):
        for r, slot in zip(*simhash_wide.slots(keys, excess)):
            out[r].add(int(slot))
    assert all(len(h) == simhash_wide.BLOCKS and h <= r for h, r in zip(homes, reach))
    step, met = len(distances) + 1, {True: [], False: []}
    for base in range(0, len(keys), step):
        for k, bits in enumerate(distances):
            other = base + 1 + k
            met[bits <= 21].append(bool(homes[base] & reach[other] or homes[other] & reach[base]))
    assert all(met[True]) and np.mean(met[False]) > 0.99


def test_wide_stage_keeps_texts_below_the_similarity(spark, monkeypatch):
    rng = random.Random(9)
    for name, size in (("PART_ROWS", 7), ("TASK_ROWS", 50), ("MANY", 2), ("PARTNERS", 2), ("CLUSTER_ROWS", 4)):  # anchors and clusters are split, components skipped
        monkeypatch.setattr(simhash_wide, name, size)
    texts = []
    for _ in range(30):
        words = prose(rng, 200).split()
        for tail in (0, 2, 14, 26, 40, 60):  # new words at the end, so many shingles
            texts.append(" ".join(words[: 200 - tail] + prose(rng, tail).split()))
    texts += [" ".join(["same"] * 300 + prose(rng, n).split()) for n in (90, 91, 92)]  # one fingerprint, other shingles
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    fps = [np.frombuffer(simhash_wide.wide_fingerprints(*text_buffer(pa.array([t])))["fp"][0], "<u8") for t in texts]
    root = list(range(len(texts)))
    linked = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and np.bitwise_count(fps[i][:4] ^ fps[j][:4]).sum() <= simhash_wide.MOST_BITS]
    for _ in texts:
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    want = [i for i in range(len(texts)) if root[i] == i]
    loose = sum(np.bitwise_count(fps[i][:4] ^ fps[j][:4]).sum() <= simhash_wide.MOST_BITS for j in range(len(texts)) for i in range(j))
    assert loose > len(linked) > 30
    df = spark.createDataFrame([(i, t, "en", "s", 0, "", "", "") for i, t in enumerate(texts)], DOCS)
    assert sorted(r["doc_id"] for r in rows(simhash_wide.deduplicated(df))) == want


@pytest.mark.parametrize("partners", [1, 8])
def test_wide_stage_joins_chains_whatever_is_tried_first(spark, monkeypatch, partners):
    """Chains of shifted texts, each alike its neighbours only: what a text leaves untried is found later."""
    monkeypatch.setattr(simhash_wide, "PARTNERS", partners)
    rng, texts = random.Random(4), []
    for _ in range(6):
        words = [f"w{rng.randrange(10**9)}" for _ in range(400)]
        texts += [" ".join(words[8 * k : 8 * k + 200]) for k in range(20)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "", "", "") for i, t in enumerate(texts)], DOCS)
    assert sorted(r["doc_id"] for r in rows(simhash_wide.deduplicated(df))) == [20 * k for k in range(6)]


def test_choices_tell_who_left_partners_untried(monkeypatch):
    """A text that isn't marked has all its partners among its choices, in one task and however often choices are merged."""
    monkeypatch.setattr(simhash_wide, "PARTNERS", 3)
    rng = np.random.default_rng(2)
    seen, held, cut = {}, [], set()
    for _ in range(40):
        a, b = rng.integers(0, 12, 15), rng.integers(100, 108, 15)
        for x, y in zip(a.tolist(), b.tolist()):
            seen.setdefault(x, set()).add(y)
        held = [simhash_wide._least([*held, (a, b, b % 5, np.zeros(15, bool))])]
        a, b, _, more = held[0]
        for x in seen:
            mine = set(b[a == x].tolist())
            assert len(mine) <= 3 and mine <= seen[x]
            assert mine == seen[x] or more[a == x].all()
            cut |= {x} if more[a == x].all() else set()
    assert len(cut) == 12


def test_suffix_tree_holds_a_large_group_once():
    rng = np.random.default_rng(3)
    n, parts = 30_000, 8
    blobs, want = [], []
    for _ in range(parts):
        near = np.sort(rng.integers(1, 4, n))
        far = rng.integers(0, 5_000, n)
        far = far[np.lexsort((far, near))]
        symbol = rng.integers(0, 3_000, n)
        w = suffix_tree.Windows.__new__(suffix_tree.Windows)
        w.columns, w.counts = [near, far, far % 7, symbol], rng.integers(0, 9, n).astype("<i4")
        w.numbers, w.times = np.arange(3_000), np.arange(3_000) * 2
        blob, symbols = w.blob(np.arange(n))
        blobs.append((blob, n, symbols))
        want.append([near, far, far % 7, symbol, symbol * 2, w.counts])
    rows = pa.table({"windows": pa.array([b for b, _, _ in blobs], pa.binary()), "rows": [m for _, m, _ in blobs], "symbols": [k for _, _, k in blobs]})
    tracemalloc.start()
    columns = suffix_tree._group(rows, np.arange(parts + 1) * n, 3)
    _, peak = tracemalloc.get_traced_memory()
    assert all((a == np.concatenate(b)).all() for a, b in zip(columns, zip(*want)))
    assert peak < 1.5 * sum(c.nbytes for c in columns)
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    first, which = suffix_tree.paired(columns[0], columns[1])
    assert tracemalloc.get_traced_memory()[1] - held < 36 * n * parts
    tracemalloc.stop()
    _, index, inverse = np.unique(columns[0] * 10_000 + columns[1], return_index=True, return_inverse=True)
    assert (first == index).all() and (which == inverse).all()


def test_rounds_of_components_broadcast_nothing(spark):
    links = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (5, 6)], "a long, b long")
    least = simhash._with_least(links)
    assert {tuple(r) for r in least.collect()} == {(1, 2, 2), (1, 3, 2), (1, 4, 2), (5, 6, 6)}
    assert "Broadcast" not in least._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in simhash.components(links).collect()} == {(2, 1), (3, 1), (4, 1), (1, 1), (6, 5), (5, 5)}


def test_components_of_few_links_take_no_rounds(spark, monkeypatch):
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in rng.sample(range(400, 500), 100)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    above = {x: x for p in pairs for x in p}
    for _ in above:
        for a, b in pairs:
            above[a] = above[b] = min(above[a], above[b])
    links = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    made, round_ = [], simhash._round
    monkeypatch.setattr(simhash, "_round", lambda edges: made.append(1) or round_(edges))
    assert {tuple(r) for r in simhash.components(links).collect()} == set(above.items()) and not made
    monkeypatch.setattr(simhash, "TASK_LINKS", 20)  # many tasks, and more stars in a task than it may hold
    got = [tuple(r) for r in simhash.components(links).collect()]
    assert set(got) == set(above.items()) and len(got) == len(above) and made
    assert not simhash.components(links.limit(0)).collect()
