"""Aggregates over sliding windows of time that cost the same for any length of the window.

A window from at + lo to at + hi is the end of one block of hi - lo and the beginning of
the next.  Bars and the two edges of every window are dealt by key and block; within a
block what has been seen so far, forwards for later edges and backwards for earlier ones,
is a running aggregate, and a row's two halves are put together.  So each row is looked at
a fixed number of times, and one key's long history is many tasks' work.

Defined results: a window without rows, or with nulls only, has null (sums too); a null
time has null; rows of one key and time have the same windows; equal maxima are told
apart by what the caller puts into the struct that is compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over_range(df: DataFrame, lo: int, hi: int, aggregates: dict[str, tuple[Callable, Column]], key: str = "symbol", at: str = "ts_ms", points: DataFrame | None = None) -> DataFrame:
    """points (df itself, if not given) with each aggregate (F.max, F.min or F.sum of a column of df) over df's rows of the key from at + lo to at + hi."""
    asked = df if points is None else points
    out = asked.select(F.col(key).alias("_key"), F.col(at).alias("_origin")).where(F.col(at).isNotNull()).distinct()
    size = hi - lo
    names = list(aggregates)
    start = lambda c: c - F.pmod(c, F.lit(max(size, 1)))
    values = [v.alias(n) for n, (_, v) in aggregates.items()]
    rows = df.where(F.col(at).isNotNull()).select(F.col(key).alias("_key"), start(F.col(at)).alias("_block"), F.col(at).alias("_place"), F.lit(None).cast("long").alias("_origin"), F.lit(0).alias("_edge"), *values)
    kinds = dict(rows.dtypes)
    # A window of one moment has one edge; else its earlier edge takes the end of a block, its later one the beginning of the next.
    edges = [(1, F.col("_origin") + lo), (2, F.col("_origin") + hi)]
    if not size:
        edges = [(1, F.col("_origin") + lo)]
    edge = F.explode(F.array(*(F.struct(F.lit(k).alias("edge"), c.alias("place")) for k, c in edges)))
    queries = out.select("_key", "_origin", edge.alias("_e")).select("_key", start(F.col("_e.place")).alias("_block"), F.col("_e.place").alias("_place"), F.col("_origin").cast("long").alias("_origin"), F.col("_e.edge").alias("_edge"), *(F.lit(None).cast(kinds[n]).alias(n) for n in names))
    merged = rows.unionByName(queries)
    if size:
        # Rows come before later edges of their time, and, seen backwards, before earlier ones.
        forth = Window.partitionBy("_key", "_block").orderBy("_place", "_edge").rowsBetween(Window.unboundedPreceding, 0)
        back = Window.partitionBy("_key", "_block").orderBy(F.col("_place").desc(), "_edge").rowsBetween(Window.unboundedPreceding, 0)
        halves = [F.when(F.col("_edge") == 1, f(n).over(back)).otherwise(f(n).over(forth)).alias(n) for n, (f, _) in aggregates.items()]
    else:
        same = Window.partitionBy("_key", "_block", "_place")
        halves = [f(n).over(same).alias(n) for n, (f, _) in aggregates.items()]
    found = merged.select("_key", "_origin", "_edge", *halves).where("_edge > 0")
    whole = found.groupBy("_key", "_origin").agg(*(f(n).alias(n) for n, (f, _) in aggregates.items()))
    kept = [c for c in asked.columns if c not in names]
    return asked.select(*kept).join(whole, (F.col(key).eqNullSafe(F.col("_key"))) & (F.col(at) == F.col("_origin")), "left").select(*kept, *names)
