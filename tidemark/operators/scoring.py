"""Scores, statuses and gates of the screening rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.operators.windows import indicators


@dataclass(frozen=True)
class Weights:
    """Points of each condition and the thresholds of the derivative conditions."""

    trend: int = 5
    oi_day: int = 4
    oi_three_days: int = 3
    long_short: int = 3
    breakout: int = 2
    volume_up: int = 1
    oi_day_at: float = 0.10
    oi_three_days_at: float = 0.20
    long_short_under: float = 1.0


def _points(condition: Column, n: int) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), n).otherwise(0)


def box_score(bars: DataFrame, weights: Weights = Weights(), box: int = 24, ema: int = 50) -> DataFrame:
    """Each bar's K-line score as of its close: null where the box or the average isn't full."""
    x = indicators(bars, box=box, ema=ema)
    known = F.col("box_high").isNotNull() & (F.col("n_bars") >= 2)
    score = _points(F.col("close") > F.col("box_high"), weights.breakout) + _points(F.col("close") > F.col("ema"), weights.trend) + _points((F.col("n_bars") >= 48) & (F.col("v24") > F.col("prev24")), weights.volume_up)
    return x.withColumn("score", F.when(known, score))


def last_closed(scored: DataFrame, key: str = "symbol") -> DataFrame:
    """The row before the last of each symbol: the last bar is still forming."""
    back = Window.partitionBy(key).orderBy(F.col("ts_ms").desc())
    return scored.withColumn("_back", F.row_number().over(back)).where("_back = 2").drop("_back")


def ranked(scored: DataFrame, by: str = "score", key: str = "symbol") -> DataFrame:
    """Ordinal rank by the score, highest first, ties by symbol; the unscored have none."""
    order = Window.partitionBy(F.col(by).isNull()).orderBy(F.col(by).desc(), key)
    return scored.withColumn("rk", F.when(F.col(by).isNotNull(), F.row_number().over(order)))


def derivative_score(changes: DataFrame, ratio: str, weights: Weights = Weights(), strict: bool = False) -> DataFrame:
    """changes (chg_24, chg_72 and a ratio column) with points and status ok, partial or failed.

    strict: thresholds must be passed, and the score is null unless all three are known.
    """
    over = (lambda c, t: F.col(c) > t) if strict else (lambda c, t: F.col(c) >= t)
    points = _points(over("chg_24", weights.oi_day_at), weights.oi_day) + _points(over("chg_72", weights.oi_three_days_at), weights.oi_three_days) + _points(F.col(ratio) < weights.long_short_under, weights.long_short)
    both, one = F.col("chg_24").isNotNull() & F.col("chg_72").isNotNull(), F.col(ratio).isNotNull()
    some = F.col("chg_24").isNotNull() | F.col("chg_72").isNotNull() | one
    score = F.when(both & one, points) if strict else points
    return changes.withColumn("score_deriv", score).withColumn("deriv_status", F.when(both & one, "ok").when(some, "partial").otherwise("failed"))


def at_decisions(decisions: DataFrame, interest: DataFrame, ratios: DataFrame, lag_ms: int = 0, rows: int = 200, least: int = 25, weights: Weights = Weights()) -> DataFrame:
    """decisions (symbol, ts_ms) with what bounded as-of lookups give, and the derivative score."""
    changes = asof.bounded_changes(interest, "value", rows, least, place="place")
    first = asof.backward(decisions, changes, ["n_valid", "adopted", "chg_24", "chg_72", "stale"], lag_ms=lag_ms, order=["place"]).drop("obs_ms")
    both = asof.backward(first, ratios.where(F.col("ratio").isNotNull() & ~F.isnan("ratio")), ["ratio"], lag_ms=lag_ms).drop("obs_ms")
    return derivative_score(both, "ratio", weights)


def leverage_veto(df: DataFrame, interest: str, volume: str, limit: float = 3.2, keep_unknown: bool = True) -> DataFrame:
    """df with ratio and veto: over the limit, or unknown where unknowns are dropped."""
    known = F.col(interest).isNotNull() & ~F.isnan(interest) & (F.col(volume) > 0) & ~F.isnan(volume)
    ratio = F.when(known, F.col(interest) / F.col(volume))
    return df.withColumn("ratio", ratio).withColumn("veto", F.when(known, ratio > limit).otherwise(F.lit(not keep_unknown)))
