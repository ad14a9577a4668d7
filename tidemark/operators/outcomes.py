"""What happens after a decision: windows that read the future, and nothing else does.

A decision never meets every bar of its window: each bar gets its own future aggregates
once, over a sorted run, and a decision looks them up at its reference bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, extremes
from tidemark.operators.windows import HOUR_MS


def path_aggregates(bars: DataFrame, hours: int, key: str = "symbol") -> DataFrame:
    """bars with, over [ts, ts + hours): f_high, f_low, f_close, f_first_high_ms (first of equal highs), f_bars, f_last_ms."""
    best = F.when(F.col("high").isNotNull(), F.struct(F.col("high").alias("v"), (-F.col("ts_ms")).alias("t")))
    facts = {"_best": (F.max, best), "f_low": (F.min, F.col("low")), "f_close": (F.max, F.col("close")), "f_bars": (F.sum, F.lit(1).cast("long")), "f_last_ms": (F.max, F.col("ts_ms"))}
    out = extremes.over_range(bars.select(key, "ts_ms", "open", "high", "low", "close"), 0, hours * HOUR_MS - 1, facts, key)
    return out.select(key, "ts_ms", "open", F.col("_best.v").alias("f_high"), "f_low", "f_close", (-F.col("_best.t")).alias("f_first_high_ms"), "f_bars", "f_last_ms")


def forward(decisions: DataFrame, bars: DataFrame, hours: int, reach: float = 2.0, key: str = "symbol") -> DataFrame:
    """decisions (key, ts_ms) with the forward outcome from the open of the first bar at or after them.

    delayed: whole bars were skipped; elapsed: the data runs past the window's end; state
    is no_reference, partial_tail, gap or complete; verdict is reached or not only where it
    can be known: a reach counts at once, a failure only in a complete window.
    """
    facts = ["open", "f_high", "f_low", "f_close", "f_first_high_ms", "f_bars", "f_last_ms"]
    at = asof.forward(decisions, path_aggregates(bars, hours, key), facts, key)
    end = bars.groupBy(key).agg(F.max("ts_ms").alias("data_end"))
    out = at.join(end, key, "left").withColumn("touch", F.col("f_high") / F.col("open"))
    elapsed = F.col("obs_ms") + (hours - 1) * HOUR_MS <= F.col("data_end")
    state = F.when(F.col("obs_ms").isNull(), "no_reference").when(~elapsed, "partial_tail").when(F.col("f_bars") < hours, "gap").otherwise("complete")
    verdict = F.when(F.col("touch") >= reach, "reach").when(state == "complete", "no_reach").otherwise("undetermined")
    return out.select(
        key, "ts_ms", F.col("obs_ms").alias("ref_ms"), F.col("open").alias("ref_price"), (F.col("obs_ms") - F.col("ts_ms") >= HOUR_MS).alias("delayed"), "touch",
        (F.col("f_close") / F.col("open")).alias("max_close"), F.least(F.lit(0.0), F.col("f_low") / F.col("open") - 1).alias("worst"), F.col("f_first_high_ms").alias("peak_ms"),
        F.coalesce(elapsed, F.lit(False)).alias("elapsed"), state.alias("state"), verdict.alias("verdict"),
    )


def labels(bars: DataFrame, hours: int, reach: float = 2.0, key: str = "symbol") -> DataFrame:
    """Direct labels on the dense grid: reference the close of the bar before, touch the highest high of the next ``hours`` hours."""
    grid = bars.withColumn("hour_idx", F.expr(f"ts_ms div {HOUR_MS}"))
    facts = {"top": (F.max, F.col("high")), "n": (F.sum, F.when(F.col("high").isNotNull(), 1).otherwise(0).cast("long"))}
    ahead = extremes.over_range(grid.select(key, "hour_idx", "close", "high"), 1, hours, facts, key, "hour_idx")
    # The bar of the hour before, and the history's end, are one bar and one number.
    before = extremes.over_range(grid, -1, -1, {"ref": (F.max, F.col("close"))}, key, "hour_idx", points=ahead)
    end = grid.groupBy(key).agg(F.max("hour_idx").alias("last_hour"))
    out = before.join(end, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    state = F.when(F.col("ref").isNull(), "no_reference").when(F.col("hour_idx") + hours > F.col("last_hour"), "partial_tail").when(F.col("n") < hours, "gap").otherwise("complete")
    return out.select(key, "hour_idx", (F.col("top") / F.col("ref")).alias("touch"), state.alias("state"), F.when(state == "complete", F.when(F.col("top") / F.col("ref") >= reach, "reach").otherwise("no_reach")).otherwise("undetermined").alias("verdict"))


def close_drawdown(key: str = "symbol", order: str = "ts_ms") -> Column:
    """Deepest fall of the close from its running peak so far."""
    return F.col("close") / F.max("close").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - 1
