"""Frames of rows over long histories of few keys: a key is cut into parts that overlap by a frame.

Rows get their exact position in their key (ranges, not one task), a part has PART_ROWS of
them and, before these, as many as a frame looks back; windows run by key and part, and only
a part's own rows stay.  Results equal those of the unsplit windows.

Defined results: rows of one key and time stand in any order among themselves; a null
value takes no part in averages and sums and has a null itself; an empty table gives no
rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators import ranks

PART_ROWS = 10_000


def split(df: DataFrame, overlap: int, order: str = "ts_ms", key: str = "symbol", part_rows: int = PART_ROWS) -> DataFrame:
    """df with _i (position in its key, from 0), _part and _own: a row is in its part, and in the next if that looks back on it."""
    placed = ranks.numbered(df, "_i", order, keys=(key,)).withColumn("_i", F.col("_i") - 1)
    home = F.expr(f"_i div {part_rows}")
    # Parts from the row's own to the last whose first own row is at most ``overlap`` rows later.
    parts = F.sequence(home, F.expr(f"(_i + {overlap}) div {part_rows}"))
    return placed.withColumn("_part", F.explode(parts)).withColumn("_own", F.col("_part") == home)


def of_part(key: str = "symbol") -> WindowSpec:
    return Window.partitionBy(key, "_part").orderBy("_i")


def joined(df: DataFrame) -> DataFrame:
    """The parts' own rows, without what split added."""
    return df.where("_own").drop("_i", "_part", "_own")


def rows_for(span: int, n: int) -> int:
    """Own rows of a part whose weights, powers of the average's decay, a double can hold."""
    return max(1, min(PART_ROWS, int(600 / math.log((span + 1) / (span - 1))) - n)) if span > 1 else PART_ROWS


def framed_ema(parts: DataFrame, column: str, span: int, n: int, name: str, key: str = "symbol") -> DataFrame:
    """parts with ``name``: the recursive exponential average over the last n rows, seeded with the first of them.

    Values weigh growing powers of the decay, so that a frame is a difference of two running
    sums and costs the same for any n.  A null keeps the last average; a frame that begins
    with one has a null.
    """
    if span <= 1:
        return parts.withColumn(name, F.col(column).cast("double"))
    w = of_part(key)
    decay = (span - 1) / (span + 1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    at = parts.withColumn("_p", F.count(column).over(so_far))
    at = at.withColumn("_a", F.coalesce(F.sum(F.col(column) * F.pow(F.lit(1 / decay), F.col("_p"))).over(so_far), F.lit(0.0)))
    here = F.struct(F.col(column).cast("double").alias("c"), F.col("_p").alias("p"), F.col("_a").alias("a"))
    at = at.withColumn("_s", F.coalesce(F.lag(here, n - 1).over(w), F.first(here).over(so_far)))
    value = F.pow(F.lit(decay), F.col("_p") - F.col("_s.p")) * F.col("_s.c") + (1 - decay) * F.pow(F.lit(decay), F.col("_p")) * (F.col("_a") - F.col("_s.a"))
    return at.withColumn(name, value).drop("_p", "_a", "_s")


def with_framed_ema(df: DataFrame, column: str, span: int, n: int, name: str, order: str = "ts_ms", key: str = "symbol") -> DataFrame:
    return joined(framed_ema(split(df, n - 1, order, key, rows_for(span, n)), column, span, n, name, key))


def with_cusum(df: DataFrame, column: str, target: float, n: int, name: str, order: str = "ts_ms", key: str = "symbol", part_rows: int = PART_ROWS) -> DataFrame:
    """df with ``name``: max(0, previous + value - target), from 0, over the last n rows; a null adds nothing.

    That is the running sum less its least value since the frame began, and a least value
    over n + 1 rows is that of the end of one block of n and of the beginning of the next.
    """
    w = of_part(key)
    parts = split(df, n, order, key, part_rows).withColumn("_sum", F.sum(F.coalesce(F.col(column) - target, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    block = Window.partitionBy(key, "_part", F.expr(f"_i div {n}"))
    forth, back = (block.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in ("_i", F.col("_i").desc()))
    parts = parts.withColumn("_low", F.min("_sum").over(forth)).withColumn("_rest", F.min("_sum").over(back))
    # What comes before the history's first row is 0.
    least = F.least("_low", F.coalesce(F.lag("_rest", n).over(w), F.lit(0.0)))
    parts = parts.withColumn(name, F.when(F.col("_i") < n, F.col("_sum") - F.least("_low", F.lit(0.0))).otherwise(F.col("_sum") - least))
    return joined(parts.drop("_sum", "_low", "_rest"))
