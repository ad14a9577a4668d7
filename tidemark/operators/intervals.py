"""What a history holds within an event's intervals, as differences of running totals.

Cut points of all events and the history's rows of a key are merged in one sorted run, and
a cut point takes the totals so far; a count or sum over an interval is the difference of
its two cuts.  No event meets the history's rows.

Defined results: a history without rows up to a cut has totals of 0; a null cut or time
takes no part (null totals); repeated events are a row each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, extremes
from tidemark.operators.asof import HOUR_MS


def totals_at(events: DataFrame, history: DataFrame, cuts: dict[str, Column], sums: dict[str, Column], key: str = "symbol", at: str = "ts_ms") -> DataFrame:
    """events with <cut>_<sum> for each: the sum over the key's history rows at or before the cut (a long column of milliseconds)."""
    columns = events.columns
    one = events.groupBy(*columns).agg(F.count("*").alias("_times"))  # equal events ask once
    each = one.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("cut"), c.alias("ms")) for n, c in cuts.items()))).alias("_c"))
    held = F.struct(*columns, "_times").alias("_event")
    asked = each.select(F.col(key).alias("_key"), F.col("_c.ms").alias("_ms"), F.lit(1).alias("_kind"), F.col("_c.cut").alias("_cut"), held, *(F.lit(0).cast("double").alias(f"_{n}") for n in sums))
    kind = asked.schema["_event"].dataType
    known = history.where(F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).alias("_ms"), F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_cut"), F.lit(None).cast(kind).alias("_event"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_{n}") for n, c in sums.items()))
    w = Window.partitionBy("_key").orderBy("_ms", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = known.unionByName(asked).select("_kind", "_ms", "_cut", "_event", *(F.sum(f"_{n}").over(w).alias(f"_{n}") for n in sums)).where("_kind = 1")
    got = placed.groupBy("_event").agg(*(F.max(F.when((F.col("_cut") == cut) & F.col("_ms").isNotNull(), F.col(f"_{n}"))).alias(f"{cut}_{n}") for cut in cuts for n in sums))
    many = got.select("_event.*", *(f"{cut}_{n}" for cut in cuts for n in sums)).withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return many.select(*columns, *(f"{cut}_{n}" for cut in cuts for n in sums))


def reverse_coverage(events: DataFrame, selections: DataFrame, before_ms: int, after_ms: int, key: str = "symbol") -> DataFrame:
    """events (key, t0, t1) with how many selections lie before (in before_ms), during and after (in after_ms), and their disposition."""
    cuts = {"a": F.col("t0") - before_ms - 1, "b": F.col("t0") - 1, "c": F.col("t1"), "d": F.col("t1") + after_ms}
    out = totals_at(events, selections, cuts, {"n": F.lit(1)}, key)
    span = lambda x, y: (F.col(f"{y}_n") - F.col(f"{x}_n")).cast("long")
    out = out.select(*events.columns, span("a", "b").alias("pre"), span("b", "c").alias("mid"), span("c", "d").alias("late"))
    return out.withColumn("disposition", F.when(F.col("pre") > 0, "before").when(F.col("mid") > 0, "during").when(F.col("late") > 0, "late").otherwise("missed"))


def reminders(events: DataFrame, selections: DataFrame, before_ms: int, key: str = "symbol") -> DataFrame:
    """events (key, t0) with ``reminders``, the selections in (t0 - before_ms, t0]."""
    out = totals_at(events, selections, {"a": F.col("t0") - before_ms, "b": F.col("t0")}, {"n": F.lit(1)}, key)
    return out.select(*events.columns, (F.col("b_n") - F.col("a_n")).cast("long").alias("reminders"))


def best_before(events: DataFrame, ranked: DataFrame, before_ms: int, rank: str = "rk", key: str = "symbol") -> DataFrame:
    """events (key, ts_ms) with ``best``, the smallest rank in [ts_ms - before_ms, ts_ms), and ``at_start``, the one an hour before."""
    best = extremes.over_range(ranked, -before_ms, -1, {"best": (F.min, F.col(rank))}, key, points=events)
    return extremes.over_range(ranked, -HOUR_MS, -HOUR_MS, {"at_start": (F.min, F.col(rank))}, key, points=best)


def recall_at(events: DataFrame, sizes: list[int]) -> DataFrame:
    """top_n, n_events and the shares of events whose best rank, and rank at the start, is within it."""
    one = events.agg(F.count("*").alias("n_events"), *(F.avg(F.when(F.col(c) <= n, 1.0).otherwise(0.0)).alias(f"{c}_{n}") for n in sizes for c in ("best", "at_start")))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("top_n"), F.col("n_events"), F.col(f"best_{n}").alias("recall_any"), F.col(f"at_start_{n}").alias("recall_start")) for n in sizes))).alias("of")).select("of.*")


def tradability(events: DataFrame, bars: DataFrame, hours: int, key: str = "symbol") -> DataFrame:
    """events (key, t0, p0) with hours, fillable, spike_share and hours_to_double over the bars of [t0, t0 + hours].

    How many bars can fill depends on the event's own price, so the bars of its hours are
    looked at; they meet by key and equal buckets of time, not by key alone.
    """
    spans = events.select(key, "t0", "p0", F.col("t0").alias("lo"), (F.col("t0") + hours * HOUR_MS + 1).alias("hi"))
    met = asof.nearest_in_range(bars.select(key, "ts_ms", "high", "low", "volume"), spans, key, "ts_ms", "lo", "hi", hours * HOUR_MS)
    double = F.when(F.col("high") >= 2 * F.col("p0"), (F.col("ts_ms") - F.col("t0")) / float(HOUR_MS))
    out = met.groupBy(key, "t0", "p0").agg(F.count("*").alias("hours"), F.sum(F.when(F.col("low") <= F.col("p0"), 1).otherwise(0)).alias("fillable"), (F.max("volume") / F.nullif(F.sum("volume"), F.lit(0.0))).alias("spike_share"), F.min(double).alias("hours_to_double"))
    return out
