"""Window operators over panels keyed by symbol and time.

All rolling windows are full windows: null until the frame holds as many values as it
asks for.  Row frames count rows, time frames count milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators import extremes, halo

HOUR_MS = 3_600_000


def by_symbol(order: str = "ts_ms", key: str | list[str] = "symbol") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def frame(n: int, end: int = 0, order: str = "ts_ms", key: str | list[str] = "symbol") -> WindowSpec:
    """The n rows that end ``end`` rows before the current one."""
    return by_symbol(order, key).rowsBetween(-(n - 1) - end, -end)


def full(value: Column, over: WindowSpec, n: int, seen: Column) -> Column:
    """value over the frame, null unless the frame holds n non-null values of seen."""
    return F.when(F.count(seen).over(over) == n, value.over(over))


def rolling(fn, column: str, n: int, end: int = 0, order: str = "ts_ms", key: str | list[str] = "symbol") -> Column:
    """fn (an aggregate) of a column over a full frame of n rows, ``end`` rows back."""
    return full(fn(column), frame(n, end, order, key), n, F.col(column))


def true_range(high: str = "high", low: str = "low", close: str = "close", over: WindowSpec | None = None) -> Column:
    """The largest of the bar's range and its distances to the last close; the first bar has its range."""
    before = F.lag(close).over(over or by_symbol())
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def indicators(bars: DataFrame, atr: int = 14, box: int = 24, ema: int = 50) -> DataFrame:
    """bars with tr, atr, ema, box_high, box_low, avg_volume, v24, prev24 and n_bars.

    The box and the average volume leave the current bar out; the exponential average is
    taken over the last ``5 * ema - 11`` bars, as a live reader with so many bars sees it.
    A symbol's history is split into overlapping parts.
    """
    n = 5 * ema - 11
    overlap = max(n - 1, 48, box, atr)
    parts = halo.framed_ema(halo.split(bars, overlap, part_rows=halo.rows_for(ema, overlap)), "close", ema, n, "ema")
    of = {"order": "_i", "key": ["symbol", "_part"]}
    with_tr = parts.withColumn("tr", true_range(over=halo.of_part()))
    out = with_tr.select(
        *bars.columns, "_i", "_part", "_own", "tr",
        rolling(F.avg, "tr", atr, **of).alias("atr"),
        "ema",
        rolling(F.max, "high", box, 1, **of).alias("box_high"),
        rolling(F.min, "low", box, 1, **of).alias("box_low"),
        rolling(F.avg, "volume", box, 1, **of).alias("avg_volume"),
        rolling(F.sum, "volume", 24, **of).alias("v24"),
        rolling(F.sum, "volume", 24, 24, **of).alias("prev24"),
        (F.col("_i") + 1).cast("int").alias("n_bars"),
    )
    return halo.joined(out)


def folded_ema(column: str, span: int, n: int, order: str = "ts_ms", key: str = "symbol") -> Column:
    """Recursive exponential average, seeded with the first value of the last n rows, step by step.

    For short frames: it holds n values for each row.  ``halo.framed_ema`` costs the same
    for any n and differs from this beyond the twelfth digit.
    """
    alpha = 2.0 / (span + 1)
    values = F.collect_list(column).over(by_symbol(order, key).rowsBetween(-(n - 1), 0))
    return F.aggregate(F.slice(values, 2, n), F.element_at(values, 1).cast("double"), lambda acc, x: acc + (x - acc) * alpha)


def _last_failure(condition: Column, w: WindowSpec) -> Column:
    return F.last(F.when(~F.coalesce(condition, F.lit(False)), F.col("_at")), ignorenulls=True).over(w)


def with_run_length(df: DataFrame, condition: Column, name: str, order: str = "ts_ms", key: str = "symbol") -> DataFrame:
    """df and ``name``: how many rows in a row, up to each, meet the condition."""
    w = by_symbol(order, key)
    numbered = df.withColumn("_at", F.row_number().over(w))
    return numbered.withColumn(name, F.col("_at") - F.coalesce(_last_failure(condition, w), F.lit(0))).drop("_at")


def islands(df: DataFrame, position: str, keys: list[str]) -> DataFrame:
    """df with ``island``: equal within a run of consecutive positions of a key."""
    w = Window.partitionBy(*keys).orderBy(position)
    return df.withColumn("island", F.col(position) - F.row_number().over(w))


def sessions(df: DataFrame, at: str, gap: int, keys: list[str]) -> DataFrame:
    """df with ``session``, numbered from 1 in a key: a new one where the gap to the row before exceeds ``gap``."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def equal_count_bin(column: str, q: int, keys: list[str], tie: str) -> Column:
    """Bin 0 to q - 1 by position, as quantile edges on first-come ranks give it."""
    base = Window.partitionBy(*keys)
    rn, n = F.row_number().over(base.orderBy(column, tie)), F.count("*").over(base)
    return F.greatest(F.ceil((rn - 1) * q / F.greatest(n - 1, F.lit(1))) - 1, F.lit(0)).cast("int")


def ordinal_percentile(column: str, keys: list[str], tie: str) -> Column:
    """(position - 1) / (n - 1) among non-null values; null for null."""
    base = Window.partitionBy(*keys, F.col(column).isNull())
    rn, n = F.row_number().over(base.orderBy(column, tie)), F.count("*").over(base)
    return F.when(F.col(column).isNotNull(), (rn - 1) / F.greatest(n - 1, F.lit(1)))


def sample_skew(column: str, over: WindowSpec) -> Column:
    """Bias-corrected skewness, null under 3 values or without variance."""
    n = F.count(column).over(over)
    ok = (n > 2) & (F.stddev_pop(column).over(over) > 0)
    return F.when(ok, F.skewness(column).over(over) * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1)))


def sample_kurtosis(column: str, over: WindowSpec) -> Column:
    """Bias-corrected excess kurtosis, null under 4 values or without variance."""
    n = F.count(column).over(over)
    ok = (n > 3) & (F.stddev_pop(column).over(over) > 0)
    return F.when(ok, (n - 1) / (F.greatest(n - 2, F.lit(1)) * F.greatest(n - 3, F.lit(1))) * ((n + 1) * F.kurtosis(column).over(over) + 6))


def calendar_rolling(df: DataFrame, fn, column: str, hours: int, at: str = "hour_idx", key: str = "symbol") -> Column:
    """fn over the last ``hours`` hours of real time; null if any hour is missing."""
    over = Window.partitionBy(key).orderBy(at).rangeBetween(-(hours - 1), 0)
    return F.when(F.count(column).over(over) == hours, fn(column).over(over))


def with_future_extreme(df: DataFrame, high: str, hours: int, top: str = "top", top_at: str = "top_ms", key: str = "symbol", at: str = "ts_ms") -> DataFrame:
    """df with the highest value of the next ``hours`` hours, from the next bar on, and its time; of equal ones the latest."""
    best = F.struct(F.col(high).alias("v"), F.col(at).alias("t"))
    out = extremes.over_range(df, HOUR_MS, hours * HOUR_MS, {"_best": (F.max, F.when(F.col(high).isNotNull(), best))}, key, at)
    return out.select(*df.columns, F.col("_best.v").alias(top), F.col("_best.t").alias(top_at))
