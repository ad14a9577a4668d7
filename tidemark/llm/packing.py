"""Best-fit packing by a hierarchy: tasks pack their own pieces, underfull bins rise and are packed as items.

Level 0: each task packs windows of its pieces by best fit in decreasing order.  Bins
with at most ``slack`` free places are emitted.  The others rise as items of their fill,
are dealt to fewer tasks and packed by best fit again, until one task has them all or a
level saves none.  Only (bin, fill) pairs of underfull bins move; a piece learns
its place at last by one join.

Every level is written to the shared folder before the next reads it, so that a lost
task is made again from the same rows.

Defined results: a null or empty text is the end id alone; repeated rows are packed each,
under their own doc_id; a null doc_id is packed like any other; an empty table gives no
rows; only texts of more than ``capacity`` ids are cut, the first piece taking the rest
that is left over, all others ``capacity``; columns besides id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe_codec import load
from tidemark.llm.buffers import text_buffer
from tidemark.llm.sequences import added_tokens, with_end
from tidemark.llm.shared import map_arrow, written

#: Tokens of a sequence; free places with which a bin is as good as full; bins of one task from level 1 on; pieces packed together on level 0.
CAPACITY, SLACK, TASK_BINS, WINDOW = 2048, 8, 65_536, 500_000
VOCABULARY, END_ID = "byte_bpe_50k.json", 0
#: Columns of pieces().
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit in decreasing order: each item's bin and offset, and each bin's fill.

    A bit set of the free spaces that occur gives the tightest bin in one shift.
    """
    n = len(lengths)
    bins, at, fill = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    have = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = have >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                have ^= 1 << space
        else:
            space, b = capacity, len(fill)
            fill.append(0)
        bins[i], at[i] = b, capacity - space
        space -= size
        fill[b] = capacity - space
        if space:
            if not free[space]:
                have |= 1 << space
            free[space].append(b)
    return bins, at, np.array(fill, np.int64)


def pieces(df: DataFrame, path: str, end: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every text of (doc_id, text)."""
    shared, added = df.sparkSession.sparkContext.broadcast(load(path)), added_tokens(path)

    def make(batch):
        raw, offsets = text_buffer(batch.column(1))
        for a, b, ids, at in with_end(shared.value, raw, offsets, end, added):
            size = np.diff(at)
            many = -(-size // capacity)
            head = size - (many - 1) * capacity
            row = np.repeat(np.arange(b - a), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            data = memoryview(ids.astype("<u4").view(np.uint8))
            p = (at[row] + start) * 4
            yield {
                "doc_id": batch.column(0).slice(a, b - a).take(pa.array(row)),
                "piece": piece.astype(np.int32),
                "start": start,
                "length": length,
                "ids_crc32": [zlib.crc32(data[x:y]) for x, y in zip(p, p + length * 4)],
            }

    return map_arrow(df, make, PIECES)


def _fitted(df: DataFrame, capacity: int, keep: str, size: str) -> DataFrame:
    """The kept columns with bin, offset and fill, each task packing windows of its rows."""
    names = keep.split(", ")

    def run(batches):
        task, seen, window, rows = TaskContext.get().partitionId(), 0, [], 0

        def packed():
            nonlocal seen
            t = pa.Table.from_batches(window).combine_chunks()
            b, at, fill = best_fit(t[size].to_numpy(), capacity)
            key = (np.int64(task) << 36) + seen + b
            seen += len(fill)
            cols = [t[n.split()[0]].combine_chunks() for n in names] + [pa.array(key), pa.array(at), pa.array(fill[b])]
            yield from pa.Table.from_arrays(cols, [*(n.split()[0] for n in names), "bin", "at", "fill"]).to_batches(100_000)

        for batch in batches:
            window.append(batch)
            rows += batch.num_rows
            if rows >= WINDOW:
                yield from packed()
                window, rows = [], 0
        if rows:
            yield from packed()

    return df.mapInArrow(run, f"{keep}, bin long, at long, fill long")


def pack(items: DataFrame, keep: str, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """items: the columns of keep (a schema text) with ``length`` from 1 to capacity.  Adds sequence_id and offset."""
    names = [n.split()[0] for n in keep.split(", ")]
    placed = written(_fitted(items, capacity, keep, "length"), "pack0")
    underfull = placed.where((F.col("at") == 0) & (F.col("fill") < capacity - slack)).select(F.col("bin").alias("low"), F.col("fill").alias("size"))
    count, level, whole = underfull.count(), 1, None
    while count > 1:
        tasks = -(-count // TASK_BINS)
        up = written(_fitted(underfull.repartition(tasks, "low"), capacity, "low long, size long", "size").withColumn("bin", F.col("bin") + F.lit(level << 58)), f"pack{level}")
        step = up.select("low", F.col("bin").alias("top"), F.col("at").alias("base"))
        if whole is None:
            whole = step
        else:
            over = step.select(F.col("low").alias("top"), F.col("top").alias("over"), F.col("base").alias("more"))
            whole = whole.join(over, "top", "left").select("low", F.coalesce("over", "top").alias("top"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        underfull = up.where((F.col("at") == 0) & (F.col("fill") < capacity - slack)).select(F.col("bin").alias("low"), F.col("fill").alias("size"))
        left = underfull.count()
        if tasks == 1 or left == count:
            break
        count, level = left, level + 1
    if whole is None:
        return placed.select(*names, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    return placed.join(whole.withColumnRenamed("low", "bin"), "bin", "left").select(*names, F.coalesce("top", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("base", F.lit(0))).alias("offset"))


def op8_best_fit(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return pack(pieces(docs, public_tokenizers.path(VOCABULARY)), PIECES)
