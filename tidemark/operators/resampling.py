"""Permutation nulls and bootstrap intervals without a row for each replicate.

Rows are put in the order of their score once, in ranges; a task makes all replicates'
weights of its rows from hashes, a batch at a time, and gives sums: those of the values at
its edges, which may go on in the next range, and of all between.  Sums of ranges are then
put together in their order.  What is shuffled doesn't depend on the number of replicates,
and what is collected is a few sums for each range and replicate.

A permutation is a bijection of 0 to n - 1 by four rounds of a keyed Feistel network, so a
row knows its place in each reordering by itself; the labels are those of n1 ones followed
by zeros.  A bootstrap replicate gives a row a Poisson weight of mean 1.

Defined results: rows with a null score or label take no part; labels other than 1 are
zeros; equal scores count half; a replicate without ones or without zeros has a null area;
an empty table has null areas.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranks

#: Rows of a batch times replicates are held at once: rows of a batch.
ROWS_AT_ONCE = 4_096
#: The multipliers of a 64-bit finaliser.
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def reordered(place: np.ndarray, n: int, key: int) -> np.ndarray:
    """Each place's place in the reordering of 0 to n - 1 that belongs to key."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = place.astype(np.uint64)
    moving = np.arange(len(out))
    while len(moving):
        left, right = out[moving] >> half, out[moving] & mask
        for turn in range(4):
            with np.errstate(over="ignore"):
                salt = mixed(np.array([key * 4 + turn + 1], np.uint64))[0]
            left, right = right, left ^ (mixed(right ^ salt) & mask)
        out[moving] = left << half | right
        moving = moving[out[moving] >= n]  # beyond the end: on to the next place of its cycle
    return out.astype(np.int64)


def poisson(ids: np.ndarray, key: int) -> np.ndarray:
    """A Poisson count of mean 1 for each id, by hash."""
    with np.errstate(over="ignore"):
        salt = mixed(np.array([key + 1], np.uint64))[0]
    u = (mixed(mixed(ids.astype(np.int64).view(np.uint64)) ^ salt) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.searchsorted(np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]), u, side="right")


def permuted_weights(n: int, ones: int, seed: int) -> Callable:
    """A row's weight among ones and among zeros, by row and replicate: its place decides."""

    def make(batch: pa.RecordBatch, replicates: range) -> tuple[np.ndarray, np.ndarray]:
        place = batch.column("_place").to_numpy()
        one = np.stack([reordered(place, n, seed * 1_000_003 + rep) < ones for rep in replicates], 1).astype(np.float64)
        return one, 1 - one

    return make


def bootstrap_weights(seed: int) -> Callable:
    def make(batch: pa.RecordBatch, replicates: range) -> tuple[np.ndarray, np.ndarray]:
        ids, one = batch.column("_id").to_numpy(), batch.column("_label").to_numpy() == 1
        times = np.stack([poisson(ids, seed * 1_000_003 + rep) for rep in replicates], 1).astype(np.float64)
        return times * one[:, None], times * ~one[:, None]

    return make


def _joined(values: list[tuple[float, np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Neighbours of one value as one."""
    out: list[tuple[float, np.ndarray, np.ndarray]] = []
    for value, one, zero in values:
        if out and (out[-1][0] == value or out[-1][0] != out[-1][0] and value != value):
            out[-1] = value, out[-1][1] + one, out[-1][2] + zero
        else:
            out.append((value, one, zero))
    return out


_SUMS = "task long, part int, value double, ones array<double>, zeros array<double>, wins array<double>"


def _range_sums(weights: Callable, replicates: range):
    """For each range, in order: sums of its first value, of all between (with wins among themselves), of its last value."""

    def run(batches):
        task, edges, inner = None, [], None

        def give():
            if task is not None:
                first, *more = edges
                rows = [(0, first[0], first[1], first[2], np.zeros_like(first[1])), (1, None, *inner)]
                rows += [(2, v, a, b, np.zeros_like(a)) for v, a, b in more]
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), *(pa.array([r[k].tolist() for r in rows], pa.list_(pa.float64())) for k in (2, 3, 4))], [c.split()[0] for c in _SUMS.split(", ")])

        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(i, ROWS_AT_ONCE)
                if task is None:
                    task, inner = rows.column("_task")[0].as_py(), tuple(np.zeros(len(replicates)) for _ in range(3))
                value = rows.column("_score").to_numpy()
                new = np.append(True, (value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1])))
                begin = np.flatnonzero(new)
                one, zero = (np.add.reduceat(w, begin, axis=0) for w in weights(rows, replicates))
                found = _joined(edges[1:] + list(zip(value[begin], one, zero))) if len(edges) > 1 else _joined(edges + list(zip(value[begin], one, zero)))
                if len(edges) > 1:
                    found = [edges[0], *found]
                # All values but the first and the last so far are whole.
                for _, a, b in found[1:-1]:
                    inner = inner[0] + a, inner[1] + b, inner[2] + a * (inner[1] + b / 2)
                edges = found if len(found) < 2 else [found[0], found[-1]]
        yield from give()

    return run


def areas(df: DataFrame, score: str, label: str, replicates: int, weights: str = "permuted", seed: int = 42, ident: str | None = None) -> DataFrame:
    """rep and auc, the area under the curve of each replicate: labels permuted, or rows (known by the number ``ident``) weighted by bootstrap."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    known: Column = F.col(ident).cast("long") if ident else F.lit(0).cast("long")
    rows = rows.select(F.col(score).cast("double").alias("_score"), F.when(F.col(label) == 1, 1).otherwise(0).cast("long").alias("_label"), known.alias("_id"))
    # Ties are split over ranges by id, so that a value of most rows is many tasks' work.
    order = ["_score", F.xxhash64("_id"), "_id"]
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    placed = ranks.with_places(rows, "_place", *order).select(F.col("_task"), (F.col("_place") - 1).alias("_place"), "_score", "_label", "_id")
    make = permuted_weights(n, ones, seed) if weights == "permuted" else bootstrap_weights(seed)
    found = sorted(placed.mapInArrow(_range_sums(make, range(replicates)), _SUMS).collect(), key=lambda r: (r[0], r[1]))
    below, above, wins = (np.zeros(replicates) for _ in range(3))
    waiting: list = []  # the value that may go on

    def done():
        nonlocal below, above, wins
        for _, a, b in waiting:
            wins, above, below = wins + a * (below + b / 2), above + a, below + b
        waiting.clear()

    for r in found:
        one, zero, inside = (np.array(x) for x in (r["ones"], r["zeros"], r["wins"]))
        if r["part"] == 1:
            if one.any() or zero.any() or inside.any():
                done()
                wins, above, below = wins + inside + one * below, above + one, below + zero
        elif waiting and (waiting[0][0] == r["value"] or waiting[0][0] != waiting[0][0] and r["value"] != r["value"]):
            waiting[0] = r["value"], waiting[0][1] + one, waiting[0][2] + zero
        else:
            done()
            waiting.append((r["value"], one, zero))
    done()
    with np.errstate(invalid="ignore", divide="ignore"):
        auc = wins / (above * below)
    return df.sparkSession.createDataFrame([(i, float(a) if np.isfinite(a) else None) for i, a in enumerate(auc)], "rep long, auc double")


def random_tops(df: DataFrame, fold: str, label: str, tie: str, replicates: int, share: int = 5, seed: int = 7) -> DataFrame:
    """rep, fold, top and base: the mean label of a random n / share rows of each fold, and of all of it, for each replicate."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(fold).cast("long").alias("_fold"), F.col(label).cast("double").alias("_label"), F.col(tie).alias("_tie"))
    placed = ranks.numbered(rows, "_place", "_tie", keys=("_fold",))
    sizes = {r[0]: r[1] for r in rows.groupBy("_fold").count().collect()}  # a number for each fold

    def run(batches):
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            of, place, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_fold", "_place", "_label"))
            for f in np.unique(of):
                mine = of == f
                n = sizes[int(f)]
                top = np.stack([reordered(place[mine] - 1, n, (seed * 1_000_003 + rep) * 1_009 + int(f)) < n // share for rep in range(replicates)])
                kept = total.setdefault(int(f), [np.zeros(replicates), np.zeros(replicates)])
                kept[0] += top.sum(1)
                kept[1] += top @ y[mine]
        for f, (count, hits) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(np.full(replicates, f)), pa.array(count), pa.array(hits)], ["rep", "_fold", "n", "hits"])

    found = placed.mapInArrow(run, "rep long, _fold long, n double, hits double").groupBy("rep", "_fold").agg((F.sum("hits") / F.when(F.sum("n") > 0, F.sum("n"))).alias("top"))
    base = rows.groupBy("_fold").agg(F.avg("_label").alias("base"))
    return found.join(base, "_fold").select("rep", F.col("_fold").alias(fold), "top", "base")
