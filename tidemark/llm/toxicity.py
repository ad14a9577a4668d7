"""Toxicity by multiple-instance learning: sentences are the instances, documents have the labels.

A sentence's probability is logistic in its words; a document's is the noisy-or of its
sentences, 1 - prod(1 - p).  Weights are learnt from document labels alone by the gradient
of the documents' likelihood, so that sentences that explain a toxic label rise and the
rest stay low; afterwards the same weights locate the offending sentences.

Features are words (runs of letters and digits, in lower case) and their first STEMS bytes,
known by 64-bit hashes; sentences end at ``.``, ``!``, ``?`` or a line's end.  A feature
enters the model if toxic documents have it more often by a likelihood-ratio test.  The
classifier is fitted on at most MOST_TOXIC and MOST_CLEAN labelled documents, those first
in an order by hash, weighted to all labelled ones' shares; everything else reads all
documents, whole.  Texts stay on the executors: what the driver fits are numbers of chosen
features by sentence, each different sentence of a document once with its count.

Defined results: a null or empty text has no sentence and score 0; repeated rows are
scored each, and of rows with one doc_id the first text in order is learnt from; a document
with several labels is toxic if one says so, null labels do not
count; with only one kind of label, or none, every score is that share (0 if none);
columns besides id, text and label are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.buffers import ascii_lower, blocks, span_keys, text_buffer
from tidemark.llm.shared import crc32_mod, map_arrow, map_batches, written

MOST_TOXIC, MOST_CLEAN = 3_000, 3_000
STEPS, RATE, RIDGE, FIRST_BIAS = 300, 0.1, 0.05, -6.0
#: A feature needs so many documents and such a likelihood ratio; lengths of stems.
LEAST_DOCS, LEAST_RATIO, STEMS = 3, 12.0, (4, 6)
TOXIC_AT = 0.5
HELD_MOD, HELD_REST = 5, 0

_inner = np.zeros(256, bool)  # of a word
_inner[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_stop = np.zeros(256, bool)
_stop[list(b".!?\n")] = True


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    share: float | None = None  # the score of every text, where labels are of one kind

    def sentences(self, words: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of each of n sentences."""
        if not len(self.words):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        w = np.where(self.words[at] == words, self.weights[at], 0.0)
        return self.bias + np.bincount(sentence, w, n)


def instances(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of features, each one's sentence; the sentences' text, start and end.  A sentence has at least a word."""
    low = ascii_lower(raw)
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = _inner[low]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(low))]
    opens[inner] |= inside[1:-1][inner]
    closes[inner - 1] |= inside[1:-1][inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    edge = np.unique(np.concatenate([np.flatnonzero(_stop[low]) + 1, offsets]))
    mark = np.searchsorted(edge, start, side="right")
    first = np.flatnonzero(np.append(True, mark[1:] != mark[:-1])) if len(mark) else np.zeros(0, np.int64)
    sentence = np.cumsum(np.append(False, mark[1:] != mark[:-1])) if len(mark) else np.zeros(0, np.int64)
    begin = edge[mark[first] - 1]
    text = np.searchsorted(offsets, start[first], side="right") - 1
    features, at = [span_keys(low, start, end)], [sentence]
    for i, n in enumerate(STEMS):
        longer = end - start > n
        features.append(span_keys(low, start[longer], start[longer] + n) ^ np.uint64(i + 1))
        at.append(sentence[longer])
    return np.concatenate(features), np.concatenate(at), text, begin, edge[mark[first]] if len(first) else begin


def _ratios(toxic: np.ndarray, docs: np.ndarray, n_toxic: int, n: int) -> np.ndarray:
    """Twice the log-likelihood ratio of each feature's share of toxic documents, positive where it is over theirs of all."""

    def part(seen, row, column):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen * n / (row * column)), 0.0)

    clean = docs - toxic
    total = part(toxic, docs, n_toxic) + part(clean, docs, n - n_toxic) + part(n_toxic - toxic, n - docs, n_toxic) + part(n - n_toxic - clean, n - docs, n - n_toxic)
    return np.where(toxic * n > docs * n_toxic, 2 * total, 0.0)


def fit(y: np.ndarray, weights: np.ndarray, words: np.ndarray, text: np.ndarray, times: np.ndarray, place: np.ndarray, index: np.ndarray) -> Model:
    """A model from documents' labels (0 or 1) and weights, sentences' documents and counts, and features' sentences and numbers among words."""
    n, k, m = len(y), len(words), len(text)
    theta = np.zeros(k + 1)
    theta[-1] = FIRST_BIAS
    mean, square = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(place, theta[index], m)
        total = np.bincount(text, times * np.logaddexp(0, z), n)
        slope = weights * np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0)
        g_z = times * slope[text] / (1 + np.exp(-np.clip(z, -500, 500)))
        grad = np.append(np.bincount(index, g_z[place], k) + RIDGE * theta[:-1], g_z.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(words, theta[:-1], float(theta[-1]))


def _chosen(sample: DataFrame, n_toxic: int, n: int) -> np.ndarray:
    """Sorted hashes of the features that the sample's toxic documents have more often."""

    def once(batch):
        toxic = batch.column(1).to_numpy()
        raw, offsets = text_buffer(batch.column(2))
        for a, _, part, at in blocks(raw, offsets):
            h, s, t, _, _ = instances(part, at)
            order = np.lexsort((t[s], h))
            h, t = h[order], t[s][order]
            new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[: len(h)]
            words, which = np.unique(h[new], return_inverse=True)
            yield {"h": words.view(np.int64), "docs": np.bincount(which, minlength=len(words)), "toxic": np.bincount(which, toxic[a + t[new]], len(words)).astype(np.int64)}

    def telling(batch):
        docs, toxic = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        yield {"h": batch.column(0).filter(pa.array(_ratios(toxic, docs, n_toxic, n) >= LEAST_RATIO))}

    seen = map_arrow(sample, once, "h long, docs long, toxic long").groupBy("h").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic")).where(F.col("docs") >= LEAST_DOCS)
    return np.sort(np.array([r[0] for r in map_arrow(seen, telling, "h long").collect()], np.int64).view(np.uint64))


def _known(sample: DataFrame, words: np.ndarray) -> pa.Table:
    """toxic, times and features of every different sentence of the sample: the numbers of its words, joined; by document."""

    def make(batch):
        ids, labels = batch.column(0), batch.column(1)
        raw, offsets = text_buffer(batch.column(2))
        for a, b, part, at in blocks(raw, offsets):
            h, s, t, _, _ = instances(part, at)
            spot = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
            hit = np.flatnonzero(words[spot] == h) if len(words) else np.zeros(0, np.int64)
            hit = hit[np.lexsort((spot[hit], s[hit]))]
            cut = np.searchsorted(s[hit], np.arange(len(t) + 1))
            spots = spot[hit].astype("<i4").tobytes()
            docs = t.tolist()
            found: dict[tuple[int, bytes], int] = {(d, b""): 0 for d in range(b - a)}  # a document without a sentence stands too
            for i, (p, q) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
                key = docs[i], spots[4 * p : 4 * q]
                found[key] = found.get(key, 0) + 1
            row = pa.array([d + a for d, _ in found])
            yield {"doc_id": ids.take(row), "toxic": labels.take(row), "times": list(found.values()), "features": [f for _, f in found]}

    return map_arrow(sample, make, "doc_id long, toxic long, times long, features binary").toArrow().sort_by([("doc_id", "ascending"), ("features", "ascending")])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic), fitted by the driver on numbers of a bounded sample's features."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    totals = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), FIRST_BIAS, float(next(iter(totals), 0)))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    some = known.where("toxic = 1").orderBy(*order).limit(MOST_TOXIC).union(known.where("toxic = 0").orderBy(*order).limit(MOST_CLEAN))
    # At most MOST_TOXIC + MOST_CLEAN rows of two numbers: a proven bound for the broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = written(sample.select("doc_id", F.col("toxic").cast("long"), "text"), "sample")
    taken = {c: min(totals[c], most) for c, most in ((0, MOST_CLEAN), (1, MOST_TOXIC))}
    n = sum(taken.values())
    words = _chosen(sample, taken[1], n)
    rows = _known(sample, words)
    ids, sizes = rows["doc_id"].to_numpy(), np.array([len(x) // 4 for x in rows["features"].to_pylist()], np.int64)
    first = np.append(True, ids[1:] != ids[:-1])
    y = rows["toxic"].to_numpy()[first]
    weights = np.where(y == 1, totals[1] / taken[1], totals[0] / taken[0]) * n / sum(totals.values())
    index = np.frombuffer(b"".join(rows["features"].to_pylist()), "<i4").astype(np.int64)
    return fit(y, weights, words, np.cumsum(first) - 1, rows["times"].to_numpy(), np.repeat(np.arange(len(ids)), sizes), index)


def _scored(model: Model, raw: np.ndarray, offsets: np.ndarray):
    words, sentence, text, begin, end = instances(raw, offsets)
    z = model.sentences(words, sentence, len(text))
    if model.share is not None:
        return np.full(len(offsets) - 1, model.share), z, text, begin, end
    return -np.expm1(-np.bincount(text, np.logaddexp(0, z), len(offsets) - 1)), z, text, begin, end


def score(df: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of (doc_id, text)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        raw, offsets = text_buffer(batch.column(1))
        for a, b, part, at in blocks(raw, offsets):
            yield {"doc_id": batch.column(0).slice(a, b - a), "score": _scored(shared.value, part, at)[0]}

    return map_arrow(df.select("doc_id", "text"), make, "doc_id long, score double")


def clean_rows(df: DataFrame, model: Model, below: float = TOXIC_AT) -> DataFrame:
    """The rows of df, with all their columns, whose text scores under below."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                raw, offsets = text_buffer(batch.column(at))
                good = np.concatenate([_scored(shared.value, part, o)[0] for _, _, part, o in blocks(raw, offsets)]) < below
                yield batch.filter(pa.array(good))

    return map_batches(df, run, df.schema)


def offending(df: DataFrame, model: Model, at_least: float = TOXIC_AT) -> DataFrame:
    """doc_id, sentence, p: the sentences whose own probability reaches at_least, with byte start and end in the text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        raw, offsets = text_buffer(batch.column(1))
        for a, b, part, at in blocks(raw, offsets):
            _, z, text, begin, end = _scored(shared.value, part, at)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            hit = np.flatnonzero(p >= at_least)
            yield {"doc_id": batch.column(0).slice(a, b - a).take(pa.array(text[hit])), "start": begin[hit] - at[text[hit]], "end": end[hit] - at[text[hit]], "sentence": [part[x:y].tobytes().decode().strip() for x, y in zip(begin[hit], end[hit])], "p": p[hit]}

    return map_arrow(df.select("doc_id", "text"), make, "doc_id long, start long, end long, sentence string, p double")


def learning_rows(labels: DataFrame) -> DataFrame:
    """Labels that may be learnt from: crc32 of doc_id as text, modulo 5, isn't 0."""
    return labels.select(F.col("doc_id").cast("long"), "toxic").where(crc32_mod("doc_id", HELD_MOD) != HELD_REST)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    model = train(docs, learning_rows(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(crc32_mod("doc_id", HELD_MOD) == HELD_REST, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))
