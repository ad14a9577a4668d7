"""Waves, episodes and greedy events over bars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import HOUR_MS, islands, sessions, with_future_extreme

#: Gains that name a wave's tier, from the top.
TIERS = (10.0, 5.0, 3.0, 2.5, 2.0)


def waves(bars: DataFrame, hours: int, gain: float, merge_hours: int = 48, tiers: tuple[float, ...] = TIERS, key: str = "symbol") -> DataFrame:
    """Waves: runs of bars whose best high of the next ``hours`` hours is ``gain`` times their close, merged over gaps up to merge_hours.

    Returns key, session, start_ms, end_ms, n_bars, segments (runs before merging, by index
    and by time), best gain with its bar, and tier.
    """
    ahead = with_future_extreme(bars.select(key, "ts_ms", "close", "high"), "high", hours, key=key)
    marked = ahead.select(key, "ts_ms", "close", (F.col("top") / F.col("close")).alias("m"), F.col("top_ms").alias("peak_ms")).where(F.col("m") >= gain)
    runs = islands(marked.withColumn("h", F.expr(f"ts_ms div {HOUR_MS}")), "h", [key])
    merged = sessions(runs, "ts_ms", merge_hours * HOUR_MS, [key])
    best = F.max(F.struct("m", (-F.col("ts_ms")).alias("t"), "peak_ms"))
    out = merged.groupBy(key, "session").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("n_bars"), F.countDistinct("island").alias("segments"), best.alias("b"))
    tier = F.lit(None).cast("double")
    for t in sorted(tiers):
        tier = F.when(F.col("b.m") >= t, t).otherwise(tier)
    return out.select(key, "session", "start_ms", "end_ms", "n_bars", "segments", F.col("b.m").alias("gain"), (-F.col("b.t")).alias("ref_ms"), F.col("b.peak_ms").alias("peak_ms"), tier.alias("tier"))


def greedy_pumps(daily: DataFrame, skip: int = 20, least_rows: int = 90, back: int = 60, window: int = 30, around: int = 10, gain: float = 1.0, ignite: float = 1.15, key: str = "symbol") -> DataFrame:
    """Daily pumps, without overlap: after a hit, ``skip`` rows are passed over.  A pump needs a trough before its peak's row and an ignition after the trough; others aren't hits and pass nothing over.

    Window functions find the candidates (few); only those, sorted, go through the greedy
    pass of their symbol.
    """
    w = Window.partitionBy(key).orderBy("day")
    n = F.count("*").over(Window.partitionBy(key))
    ret = F.col("close") / F.when(F.lag("close", window).over(w) != 0, F.lag("close", window).over(w)) - 1
    rows = daily.withColumn("i", F.row_number().over(w) - 1).withColumn("n", n).withColumn("ret", ret)
    rows = rows.withColumn("top", F.max("ret").over(w.rowsBetween(-around, around)))
    low = F.min(F.struct(F.col("low"), F.col("i").alias("at"), F.col("day").alias("on"), F.col("close").alias("c"))).over(w.rowsBetween(-back, 0))
    rows = rows.withColumn("t", low).withColumn("recent", F.collect_list(F.struct("i", "day", "close")).over(w.rowsBetween(-back, 0)))
    lit = F.try_element_at(F.filter("recent", lambda x: (x["i"] > F.col("t.at")) & (x["close"] >= ignite * F.col("t.c"))), F.lit(1))
    found = rows.where((F.col("n") >= least_rows) & (F.col("i") >= back) & (F.col("i") <= F.col("n") - 2) & (F.col("ret") >= 1) & (F.col("ret") == F.col("top")) & (F.col("high") / F.col("t.low") - 1 >= gain) & (F.col("t.at") < F.col("i")) & lit.isNotNull())
    found = found.select(key, F.col("i").cast("long").alias("i"), "day", F.col("t.on").alias("trough"), lit["day"].alias("ignite"), (F.col("high") / F.col("t.low") - 1).alias("gain"))

    def greedy(rows_: Iterator[pd.DataFrame]) -> pd.DataFrame:
        rows_ = rows_.sort_values("i")
        keep, free = [], -1
        for i in rows_["i"]:
            keep.append(i >= free)
            if keep[-1]:
                free = i + skip
        return rows_[pd.Series(keep, index=rows_.index)]

    return found.groupBy(key).applyInPandas(greedy, found.schema)
