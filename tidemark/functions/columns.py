"""Column functions: pure expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: str | Column) -> Column:
    """A number that is neither null, NaN nor infinite."""
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def safe_float(x: str | Column, default: float = 0.0) -> Column:
    """x as a double; what isn't a finite number becomes the default."""
    d = F.expr("try_cast({} AS DOUBLE)".format(x)) if isinstance(x, str) else x.try_cast("double")
    return F.when(finite(d), d).otherwise(F.lit(default))


def safe_divide(a: str | Column, b: str | Column) -> Column:
    """a / b, null if either isn't finite or b is zero."""
    a, b = _c(a), _c(b)
    return F.when(finite(a) & finite(b) & (b != 0), a / b)


def normalize_epoch(x: str | Column) -> Column:
    """Milliseconds since 1970 from seconds, milliseconds, microseconds or a date text; null for what can't be one.

    Numbers by size: under 1e8 or from 1e17 on none, from 1e14 microseconds, from 1e11
    milliseconds, else seconds.
    """
    t = F.trim(_c(x).cast("string"))
    n = t.try_cast("double")
    number = F.when((n < 1e8) | (n >= 1e17) | F.isnan(n), None).when(n >= 1e14, F.floor(n / 1000)).when(n >= 1e11, F.floor(n)).otherwise(F.floor(n * 1000))
    stamp = F.unix_millis(F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"))))
    return F.when(n.isNotNull(), number.cast("long")).otherwise(stamp)


def time_class(x: str | Column) -> Column:
    """What a time cell holds: ns, us, ms, s, toosmall, strdate, str, empty or nonfinite."""
    t = F.trim(_c(x).cast("string"))
    n = t.try_cast("double")
    number = F.when(F.isnan(n) | (F.abs(n) == float("inf")), "nonfinite").when(n > 1e17, "ns").when(n >= 1e14, "us").when(n >= 1e11, "ms").when(n > 1e9, "s").otherwise("toosmall")
    return F.when(t.isNull() | (t == ""), "empty").when(n.isNotNull(), number).when(normalize_epoch(t).isNotNull(), "strdate").otherwise("str")


def archive_key(key: str | Column) -> dict[str, Column]:
    """Fields of data/<market>/<period>/<dataset>/<symbol>[/<interval>]/<file>: the folders decide, the file's name is checked against them."""
    parts = F.split(_c(key), "/")
    at = lambda i: F.get(parts, F.lit(i))
    name = F.regexp_replace(F.get(parts, F.size(parts) - 1), r"\.zip$", "")
    dated = F.regexp_extract(name, r"(\d{4}-\d{2}(?:-\d{2})?)$", 1)
    has = F.size(parts) >= 7
    return {"market": at(1), "kind": at(2), "dataset": at(3), "symbol": at(4), "interval": F.when(has, at(5)), "period": F.when(dated != "", dated), "name_agrees": F.startswith(name, F.concat(at(4), F.lit("-")))}


def signed_log(x: str | Column) -> Column:
    x = _c(x)
    return F.signum(x) * F.log1p(F.abs(x))


def log_ratio(a: str | Column, b: str | Column) -> Column:
    return F.ln((_c(b) + 1) / (_c(a) + 1))


def net_return(x: str | Column, cost: float = 0.003) -> Column:
    return (1 + _c(x)) * (1 - cost) - 1


def human_money(x: str | Column) -> Column:
    """1.2B, 3.4M and the like."""
    x = _c(x)
    out = F.format_string("%.0f", x)
    for at, unit in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(F.abs(x) >= at, F.concat(F.format_string("%.1f", x / at), F.lit(unit))).otherwise(out)
    return out


def ban_until_ms(message: str | Column, now_ms: str | Column) -> Column:
    """When a refusal ends: ``banned until <ms>``, or now and ``retry-after <s>``; null if it says neither."""
    m = F.lower(_c(message))
    until, wait = F.regexp_extract(m, r"banned until (\d+)", 1), F.regexp_extract(m, r"retry-after:? (\d+)", 1)
    return F.when(until != "", until.try_cast("long")).when(wait != "", _c(now_ms) + wait.try_cast("long") * 1000)


def bigram_overlap(a: str | Column, b: str | Column) -> Column:
    """Shared distinct bigrams over the smaller number of them."""

    def grams(t: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(2))))

    x, y = grams(_c(a)), grams(_c(b))
    return F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))


def joined_conditions(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold, with commas, or ``none``."""
    names = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in conditions.items()))), ",")
    return F.when(names == "", "none").otherwise(names)


def safe_segment(x: str | Column) -> Column:
    """A path segment without anything but letters, digits, dot, dash and underscore."""
    return F.regexp_replace(_c(x), r"[^A-Za-z0-9._-]", "_")
