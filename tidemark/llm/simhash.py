"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has, for each of 64 bits, the majority over the XXH64 values of its
word shingles.  The anchors are a covering code of two blocks of 23 bits: in each, the
binary Golay code, whose words cover all 2**23 points within radius 3.  A fingerprint's
home is the anchor that its two blocks decode to; if two fingerprints differ in at most
``max_bits`` bits, the home of one is within the covering radius plus that threshold of
the other (block by block: the excess over the radius, summed, is at most the threshold).
So each distinct fingerprint goes to its home, a copy to every anchor within that reach,
and copies meet homes only at equal anchors, where all 64 bits are compared.  No pair
within the threshold is missed, and none is found by chance.

Only distinct fingerprints are compared: exact copies, however many, are one row.  Links
become components in the tasks that have them, then across tasks by alternating large and
small stars, every round written to the shared folder.

Defined results: texts without a word have fingerprint 0 and are linked like any other;
fewer words than a shingle make one shingle; repeated rows keep their rows; null doc_ids
keep their rows and never name a component (one of nulls alone has a null name); an empty
table gives no rows; columns besides id and text are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.buffers import ascii_lower, blocks, ragged, text_buffer, word_spans
from tidemark.llm.shared import map_arrow, map_batches, written
from tidemark.llm.xxh import xxh64

SEED, SHINGLE, MAX_BITS = 42, 3, 2
#: Length and generator polynomial of the binary Golay code, and its covering radius.
BLOCK, GENERATOR, RADIUS = 23, 0b110001110101, 3


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, words: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, repeats included, and n + 1 offsets by text."""
    low = ascii_lower(raw)
    start, end, by_text = word_spans(low, offsets)
    joined, at = ragged(np.append(low, np.uint8(32)), start, end - start + 1)
    joined[at[1:] - 1] = 32
    n = np.diff(by_text)
    many = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    out = np.append(0, np.cumsum(many))
    first = np.repeat(by_text[:-1] - out[:-1], many) + np.arange(out[-1])
    last = first + np.repeat(np.minimum(n, words), many) - 1
    return xxh64(joined, at[first], at[last + 1] - 1 - at[first], seed), out


_spread = np.array([sum(1 << (8 * j) for j in range(8) if b >> j & 1) for b in range(256)], np.uint64)


def majorities(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits set in over half of them; zero for an empty run.

    Eight bits' counters share one integer, so that runs of up to 255 hashes are summed
    with one addition for a byte of a hash.
    """
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    parts = -(-n[full] // 255)
    run = np.append(0, np.cumsum(parts))
    cut = np.repeat(offsets[:-1][full] - run[:-1] * 255, parts) + np.arange(run[-1]) * 255
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        sums = np.add.reduceat(_spread[lanes[:, byte]], cut).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(sums.astype(np.int64), run[:-1], axis=0)
        bits = (2 * counts > n[full][:, None]) @ (1 << np.arange(8))
        out[full] |= bits.astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(df: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row of (doc_id, text)."""

    def make(batch):
        raw, offsets = text_buffer(batch.column(1))
        for a, b, part, at in blocks(raw, offsets):
            yield {"doc_id": batch.column(0).slice(a, b - a), "fp": majorities(*shingle_hashes(part, at, words, seed)).view(np.int64)}

    return map_arrow(df, make, "doc_id long, fp long")


@lru_cache(1)
def _byte_remainders() -> np.ndarray:
    def remainder(x: int) -> int:
        for bit in range(BLOCK, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    return np.array([[remainder(b << s) for b in range(256)] for s in (0, 8, 16)], np.uint16)


def syndromes(block: np.ndarray) -> np.ndarray:
    r = _byte_remainders()
    return r[0][block & 255] ^ r[1][(block >> 8) & 255] ^ r[2][block >> 16]


@lru_cache(4)
def cosets(max_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By excess over the covering radius: patterns sorted by syndrome, and each syndrome's first place."""
    patterns, starts = [], []
    for excess in range(max_bits + 1):
        sizes = range(RADIUS + 1) if excess == 0 else [RADIUS + excess]
        p = np.array([sum(1 << i for i in c) for k in sizes for c in combinations(range(BLOCK), k)], np.int64)
        s = syndromes(p)
        order = np.argsort(s, kind="stable")
        patterns.append(p[order])
        starts.append(np.searchsorted(s[order], np.arange(2049)))
    return patterns, starts


def anchors(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home of every fingerprint; and (row, anchor) of every anchor within reach."""
    u = fp.view(np.uint64)
    blocks_ = [(u & np.uint64((1 << BLOCK) - 1)).astype(np.int64), (u >> np.uint64(BLOCK) & np.uint64((1 << BLOCK) - 1)).astype(np.int64)]
    patterns, starts = cosets(max_bits)
    syn = [syndromes(b).astype(np.int64) for b in blocks_]
    near = [[ragged(patterns[e], starts[e][s], starts[e][s + 1] - starts[e][s]) for e in range(max_bits + 1)] for s in syn]
    home = (blocks_[0] ^ near[0][0][0]) | (blocks_[1] ^ near[1][0][0]) << BLOCK
    rows, found = [], []
    for e in range(max_bits + 1):
        for f in range(max_bits + 1 - e):
            (p, at), (q, bt) = near[0][e], near[1][f]
            n, m = np.diff(at), np.diff(bt)
            row = np.repeat(np.arange(len(fp)), n * m)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            found.append((blocks_[0][row] ^ p[at[row] + k // m[row]]) | (blocks_[1][row] ^ q[bt[row] + k % m[row]]) << BLOCK)
            rows.append(row)
    return home, np.concatenate(rows), np.concatenate(found)


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column fp, each once) that differ in at most max_bits bits."""

    def at_home(batch):
        fp = batch.column(0).to_numpy()
        yield {"anchor": anchors(fp, 0)[0], "a": fp}

    def reached(batch):
        fp = batch.column(0).to_numpy()
        for i in range(0, len(fp), 2_000):
            part = fp[i : i + 2_000]
            _, row, anchor = anchors(part, max_bits)
            yield {"anchor": anchor, "b": part[row]}

    homes = map_arrow(prints.select("fp"), at_home, "anchor long, a long")
    copies = map_arrow(prints.select("fp"), reached, "anchor long, b long")
    close = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    met = copies.join(homes, "anchor").where(close)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


#: Parts that a node's links are dealt into.
SALTS = 64


def _with_least(links_: DataFrame) -> DataFrame:
    """Links (a, b) with m, the least b of each a; a hub's links are never in one task: minima go by part, then by node, and come back by part.

    Both joins are merged where their rows lie: the rounds of small links would else broadcast one
    table after another, each with a thread and blocks of the driver.
    """
    salted = links_.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("a", "part").agg(F.min("b").alias("m"))
    low = parts.join(parts.groupBy("a").agg(F.min("m").alias("least")).hint("merge"), "a").select("a", "part", F.col("least").alias("m"))
    return salted.join(low.hint("merge"), ["a", "part"]).select("a", "b", "m")


#: Links that a task joins by itself.
TASK_LINKS = 500_000


def least_joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, in order, and of each the smallest node that it is joined to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    above = np.arange(len(nodes))
    while True:
        x, y = above[x], above[y]
        on = x != y
        x, y = x[on], y[on]
        if not len(x):
            return nodes, nodes[above]
        np.minimum.at(above, np.maximum(x, y), np.minimum(x, y))
        while (above != above[above]).any():
            above = above[above]


def _joined(links_: DataFrame, tasks: int) -> DataFrame:
    """Links (a, b), a > b, that join the same nodes: each task's own become stars, of some TASK_LINKS links at once."""

    def run(batches):
        held, size = [np.zeros((2, 0), np.int64)], 0

        def stars():
            node, root = least_joined(*np.concatenate(held, 1))
            return np.stack([node, root])[:, node != root]

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in (0, 1)]))
            size += batch.num_rows
            if size > 2 * TASK_LINKS:
                held = [stars()]
                size = held[0].shape[1]
                if size > TASK_LINKS:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["a", "b"])
                    held, size = [held[0][:, :0]], 0
        yield pa.RecordBatch.from_arrays([*map(pa.array, stars())], ["a", "b"])

    return map_batches(links_.coalesce(tasks), run, "a long, b long")


def _round(edges: DataFrame) -> DataFrame:
    """A large and a small star of the links (a, b)."""
    both = _with_least(edges.union(edges.select("b", "a"))).withColumn("m", F.least("m", "a"))
    large = both.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    small = _with_least(down)
    return small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(small.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node below a root has one link, and no root is below another."""
    ends = edges.select("a", F.lit(1).alias("below"), F.lit(0).alias("root")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("a").agg(F.sum("below").alias("below"), F.max("root").alias("root")).where("below > 1 OR (below > 0 AND root > 0)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Each task makes stars of the links that it has, then a large and a small star join those of
    different tasks, each time a table, until all are stars.  As many links as one task joins
    take no round.  No step makes an end of a link larger or adds links, so the rounds end.
    """
    edges = written(edges.select("a", "b"), "links")
    while True:
        tasks = max(1, -(-edges.count() // TASK_LINKS))
        edges = written(_joined(edges, tasks), "joined")
        if tasks > 1:
            edges = written(_round(edges), "star")
        if tasks == 1 or _are_stars(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(df: DataFrame, words: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id linked to it, of every row of (doc_id, text)."""
    marked = written(fingerprints(df, words, seed), "fingerprints")
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(prints, max_bits))
    named = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.select("fp", "root").join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
