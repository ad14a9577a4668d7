"""A registry of bar features: column expressions by name, all causal, over one window specification per length.

Catalyst computes all features of a frame in one window operator; the number of sorts is
one, as every frame has the same key and order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import by_symbol, frame, rolling, sample_kurtosis, sample_skew

Feature = Callable[[], Column]


def _over(fn, column: str, n: int) -> Column:
    return rolling(fn, column, n)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def registry(lengths: tuple[int, ...] = (4, 12, 24, 72, 168)) -> dict[str, Column]:
    """Features by name.  Inputs: open, high, low, close, volume and, from prepared(), ret, body, upper, lower, i."""
    w = by_symbol()
    out: dict[str, Column] = {}
    for n in lengths:
        high, low = _over(F.max, "high", n), _over(F.min, "low", n)
        mean, sd = _over(F.avg, "close", n), _over(F.stddev_pop, "close", n)
        volume, volume_sd = _over(F.avg, "volume", n), _over(F.stddev_pop, "volume", n)
        total, squares = _over(F.sum, "volume", n), _over(F.sum, "volume2", n)
        out |= {
            f"ret_{n}": _ratio(F.col("close"), F.lag("close", n).over(w)) - 1,
            f"vol_{n}": _over(F.stddev_pop, "ret", n) * n**0.5,
            f"up_share_{n}": _over(F.avg, "up", n),
            f"range_pos_{n}": _ratio(F.col("close") - low, high - low),
            f"dist_high_{n}": _ratio(F.col("close"), high) - 1,
            f"dist_low_{n}": _ratio(F.col("close"), low) - 1,
            f"new_high_{n}": (F.col("close") >= 0.999 * high).cast("int"),
            f"width_{n}": _ratio(high - low, low),
            f"z_close_{n}": _ratio(F.col("close") - mean, sd),
            f"z_volume_{n}": _ratio(F.col("volume") - volume, volume_sd),
            f"cv_volume_{n}": _ratio(volume_sd, volume),
            f"hhi_volume_{n}": _ratio(squares, total * total),
            f"volume_ratio_{n}": _ratio(F.col("volume"), volume),
            f"body_{n}": _over(F.avg, "body", n),
            f"upper_{n}": _over(F.avg, "upper", n),
            f"lower_{n}": _over(F.avg, "lower", n),
            f"slope_{n}": F.when(F.count("close").over(frame(n)) == n, F.regr_slope("close", "i").over(frame(n))),
            f"rsi_{n}": _ratio(100 * _over(F.sum, "gain", n), _over(F.sum, "move", n)),
        }
    for n in lengths[2:]:
        full = F.count("ret").over(frame(n)) == n
        out |= {f"skew_{n}": F.when(full, sample_skew("ret", frame(n))), f"kurt_{n}": F.when(full, sample_kurtosis("ret", frame(n)))}
    peak = F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out |= {
        "drawdown": _ratio(F.col("close"), peak) - 1,
        "hour_of_day": F.expr("ts_ms div 3600000 % 24"),
        "gap_hours": F.expr("ts_ms") / 3_600_000 - F.lag("ts_ms").over(w) / 3_600_000,
        "age_bars": F.col("i"),
    }
    return out


def prepared(bars: DataFrame) -> DataFrame:
    """bars with what the registry reads of each bar and the one before."""
    w = by_symbol()
    span = F.when(F.col("high") != F.col("low"), F.col("high") - F.col("low"))
    move = F.col("close") - F.lag("close").over(w)
    return bars.withColumns({
        "i": F.row_number().over(w), "ret": _ratio(F.col("close"), F.lag("close").over(w)) - 1, "volume2": F.col("volume") * F.col("volume"),
        "gain": F.greatest(move, F.lit(0.0)), "move": F.abs(move), "up": F.when(move.isNotNull(), (move > 0).cast("double")),
        "body": F.abs(F.col("close") - F.col("open")) / span, "upper": (F.col("high") - F.greatest("open", "close")) / span, "lower": (F.least("open", "close") - F.col("low")) / span,
    })


def bar_features(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """symbol, ts_ms and the named features (all by default)."""
    made = registry()
    return prepared(bars).select("symbol", "ts_ms", *(made[n].alias(n) for n in (names or made)))
