"""Queries through the DataFrame operators, each with SQL that computes the same another way."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, events, halo, intervals, outcomes, scoring, stats, windows
from tidemark.plans import dialect, evaluation
from tidemark.plans.domain import domain, sql

_FULL_TIME = ["ts", "event_id"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    """Registers a function (spark, sf_dir) under its name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = dialect.check_text(oracle)
        return fn

    return add


def _timed(observations: str) -> str:
    """The same rows with their full time, which says what is later within a millisecond."""
    return observations.replace(" FROM events", f", {', '.join(_FULL_TIME)} FROM events")


def r(c: str | Column, places: int = 5) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), places) + F.lit(0.0)


_INTEREST = "SELECT user_id % 20 AS symbol, $ms(ts) AS ts_ms, value FROM events WHERE event_type = 'purchase'"
_RATIOS = "SELECT user_id % 20 AS symbol, $ms(ts) AS ts_ms, value / 50 AS ratio FROM events WHERE event_type = 'signup'"
_DECISIONS = "SELECT user_id % 20 AS symbol, $ms(ts) AS ts_ms, event_id FROM events WHERE event_type = 'error'"
_EMA = "list_reduce(list(close) OVER (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 238 PRECEDING AND CURRENT ROW), lambda a, x: a + (x - a) * CAST(2.0 / 51 AS DOUBLE))"
_BOX = f"""x AS (SELECT symbol, ts_ms, close, count(*) OVER u AS n, CASE WHEN count(high) OVER b = 24 THEN max(high) OVER b END AS box_high, CASE WHEN count(low) OVER b = 24 THEN min(low) OVER b END AS box_low,
 CASE WHEN count(volume) OVER w24 = 24 THEN sum(volume) OVER w24 END AS v24, CASE WHEN count(volume) OVER p24 = 24 THEN sum(volume) OVER p24 END AS prev24, {_EMA} AS ema FROM bars
 WINDOW u AS (PARTITION BY symbol ORDER BY ts_ms ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), w24 AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), p24 AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING)),
 s AS (SELECT *, CASE WHEN box_high IS NOT NULL THEN CASE WHEN close > box_high THEN 2 ELSE 0 END + CASE WHEN close > ema THEN 5 ELSE 0 END + CASE WHEN n >= 48 AND coalesce(v24 > prev24, FALSE) THEN 1 ELSE 0 END END AS score, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC) AS back FROM x)"""


@query(f"WITH {_BOX} SELECT symbol, ts_ms, score, $r(close) AS close, $r(box_high) AS box_high, $r(box_low) AS box_low, $r(v24) AS v24, $r(prev24) AS prev24, CAST(row_number() OVER (PARTITION BY score IS NULL ORDER BY score DESC, symbol) AS INTEGER) AS rk FROM s WHERE back = 2")
def c03_box_score_rank(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by the score of their last closed bar."""
    out = scoring.ranked(scoring.last_closed(scoring.box_score(domain(spark, d, "bars"))))
    return out.select("symbol", "ts_ms", "score", *(r(c).alias(c) for c in ("close", "box_high", "box_low", "v24", "prev24")), "rk")


@query(f"WITH {_BOX} SELECT symbol, ts_ms, $r(ema) AS ema, $r(box_high) AS box_high, $r(box_low) AS box_low FROM s")
def w04_ema_and_box(spark, d):
    """The framed recursive average and the box of the bars before."""
    return windows.indicators(domain(spark, d, "bars")).select("symbol", "ts_ms", r("ema").alias("ema"), r("box_high").alias("box_high"), r("box_low").alias("box_low"))


@query("SELECT symbol, ts_ms, $r(list_reduce(list_prepend(CAST(0 AS DOUBLE), list(CAST(trades AS DOUBLE)) OVER (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)), lambda a, x: greatest(CAST(0 AS DOUBLE), a + x - 3))) AS cusum FROM bars")
def w41_cusum(spark, d):
    return halo.with_cusum(domain(spark, d, "bars").select("symbol", "ts_ms", "trades"), "trades", 3.0, 100, "cusum").select("symbol", "ts_ms", r("cusum").alias("cusum"))


@query("WITH c AS (SELECT symbol, ts_ms, row_number() OVER w AS i, (max(high) OVER b - min(low) OVER b) / nullif(min(low) OVER b, 0) <= 40 AS ok FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms), b AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) SELECT symbol, ts_ms, $int(i - coalesce(max(CASE WHEN NOT coalesce(ok, FALSE) THEN i END) OVER (PARTITION BY symbol ORDER BY ts_ms), 0)) AS box_age FROM c")
def w13_box_age(spark, d):
    w = windows.frame(6)
    width = (F.max("high").over(w) - F.min("low").over(w)) / F.when(F.min("low").over(w) != 0, F.min("low").over(w))
    rows = domain(spark, d, "bars").withColumn("ok", width <= 40)
    return windows.with_run_length(rows, F.col("ok"), "box_age").select("symbol", "ts_ms", F.col("box_age").cast("long").alias("box_age"))


@query("WITH b AS (SELECT symbol, ts_ms, rank() OVER (PARTITION BY symbol ORDER BY ts_ms) AS i, close, volume FROM bars), p AS (SELECT a.symbol, a.ts_ms, x.close, x.volume FROM b a JOIN b x ON x.symbol = a.symbol AND x.i BETWEEN a.i - 23 AND a.i WHERE a.i >= 24), k AS (SELECT symbol, ts_ms, rank() OVER (PARTITION BY symbol, ts_ms ORDER BY close) + (count(*) OVER (PARTITION BY symbol, ts_ms, close) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol, ts_ms ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, ts_ms, volume) - 1) / 2.0 AS b FROM p) SELECT symbol, ts_ms, $r(corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE))) AS rho FROM k GROUP BY 1, 2")
def w20_rolling_spearman(spark, d):
    """Rank correlation of close and volume over 24 rows, at every bar."""
    return stats.rolling_spearman(domain(spark, d, "bars"), "close", "volume", ["symbol"], "ts_ms", 24, "rho").select("symbol", "ts_ms", r("rho").alias("rho"))


@query(None)
def w20_rolling_spearman_168(spark, d):
    """W20 whole: close and volume at every bar with a full window of 168 rows."""
    return stats.rolling_spearman(domain(spark, d, "bars"), "close", "volume", ["symbol"], "ts_ms", 168, "rho").select("symbol", "ts_ms", r("rho").alias("rho"))


@query(None)
def w30_random_rank(spark, d):
    """A control rank by hash of seed, hour and symbol: the same on any cluster."""
    order = Window.partitionBy("ts_ms").orderBy(F.xxhash64(F.lit(42), "ts_ms", "symbol"), "symbol")
    return domain(spark, d, "bars").select("ts_ms", "symbol", F.row_number().over(order).alias("rk"))


@query("SELECT symbol, ts_ms, $r(max(high) OVER f) AS top, CAST(max(CASE WHEN TRUE THEN (high, ts_ms) END) OVER f AS STRUCT(a DOUBLE, b BIGINT)).b AS top_ms FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN 3600000 FOLLOWING AND 86400000 FOLLOWING)")
def w35_future_extreme(spark, d):
    return windows.with_future_extreme(domain(spark, d, "bars").select("symbol", "ts_ms", "high"), "high", 24).select("symbol", "ts_ms", r("top").alias("top"), "top_ms")


@query(f"WITH o AS ({_INTEREST}), q AS ({_DECISIONS}) SELECT q.symbol, q.ts_ms, q.event_id, o.ts_ms AS obs_ms, $r(o.value) AS value FROM q ASOF LEFT JOIN (SELECT symbol, ts_ms, value FROM o) o ON o.symbol = q.symbol AND o.ts_ms <= q.ts_ms")
def j07_asof_backward(spark, d):
    return asof.backward(sql(spark, d, _DECISIONS), sql(spark, d, _timed(_INTEREST)), ["value"], order=_FULL_TIME).select("symbol", "ts_ms", "event_id", "obs_ms", r("value").alias("value"))


@query(f"WITH o AS ({_INTEREST}), q AS (SELECT symbol, ts_ms, event_id, ts_ms - 3600000 AS cut FROM ({_DECISIONS}) z) SELECT q.symbol, q.ts_ms, q.event_id, $r(o.value) AS value FROM q ASOF LEFT JOIN o ON o.symbol = q.symbol AND o.ts_ms <= q.cut")
def p07_publish_lag(spark, d):
    return asof.backward(sql(spark, d, _DECISIONS), sql(spark, d, _timed(_INTEREST)), ["value"], lag_ms=3_600_000, order=_FULL_TIME).select("symbol", "ts_ms", "event_id", r("value").alias("value"))


@query(f"WITH o AS ({_INTEREST}), q AS ({_DECISIONS}) SELECT q.symbol, q.ts_ms, q.event_id, o.ts_ms AS obs_ms, $r(o.value) AS value FROM q ASOF LEFT JOIN o ON o.symbol = q.symbol AND o.ts_ms >= q.ts_ms")
def j09_asof_forward(spark, d):
    return asof.forward(sql(spark, d, _DECISIONS), sql(spark, d, _timed(_INTEREST)), ["value"], order=_FULL_TIME).select("symbol", "ts_ms", "event_id", "obs_ms", r("value").alias("value"))


_BOUNDED = f"""o AS (SELECT symbol, ts_ms, value, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, value) AS i FROM ({_INTEREST}) z),
 v AS (SELECT a.symbol, a.ts_ms, a.i, a.value, b.ts_ms AS t, b.value AS x, b.i AS bi FROM o a JOIN o b ON b.symbol = a.symbol AND b.i BETWEEN a.i - 199 AND a.i AND b.value > 5),
 l AS (SELECT symbol, ts_ms, i, value, count(*) AS n_valid, max(t) AS adopted_ms, arg_max(x, t) AS adopted, max(bi) AS last_i FROM v GROUP BY 1, 2, 3, 4),
 g AS (SELECT l.*, (SELECT arg_max(v.x, v.t) FROM v WHERE v.symbol = l.symbol AND v.i = l.i AND v.t <= l.adopted_ms - 24 * 3600000) AS b24, (SELECT arg_max(v.x, v.t) FROM v WHERE v.symbol = l.symbol AND v.i = l.i AND v.t <= l.adopted_ms - 72 * 3600000) AS b72 FROM l)"""


@query(f"WITH {_BOUNDED} SELECT symbol, ts_ms, n_valid, CASE WHEN n_valid >= 25 THEN adopted_ms END AS adopted_ms, $r(CASE WHEN n_valid >= 25 THEN adopted / b24 - 1 END) AS chg_24, $r(CASE WHEN n_valid >= 25 THEN adopted / b72 - 1 END) AS chg_72, i - last_i AS stale FROM g")
def j08_bounded_changes(spark, d):
    """Changes against offset bases inside the last 200 observations, gated by 25 valid ones."""
    out = asof.bounded_changes(sql(spark, d, _INTEREST), "value", 200, 25, valid=F.col("value") > 5).where("n_valid > 0")
    return out.select("symbol", "ts_ms", F.col("n_valid").cast("long").alias("n_valid"), "adopted_ms", r("chg_24").alias("chg_24"), r("chg_72").alias("chg_72"), F.col("stale").cast("long").alias("stale"))


@query(f"""WITH {_BOUNDED}, q AS ({_DECISIONS}), rt AS ({_RATIOS}), k AS (SELECT symbol, ts_ms, CASE WHEN n_valid >= 25 THEN adopted / b24 - 1 END AS c24, CASE WHEN n_valid >= 25 THEN adopted / b72 - 1 END AS c72 FROM g),
 j AS (SELECT q.symbol, q.ts_ms, q.event_id, k.c24, k.c72 FROM q ASOF LEFT JOIN k ON k.symbol = q.symbol AND k.ts_ms <= q.ts_ms), j2 AS (SELECT j.*, rt.ratio FROM j ASOF LEFT JOIN rt ON rt.symbol = j.symbol AND rt.ts_ms <= j.ts_ms)
 SELECT symbol, ts_ms, event_id, CASE WHEN coalesce(c24 >= 0.1, FALSE) THEN 4 ELSE 0 END + CASE WHEN coalesce(c72 >= 0.2, FALSE) THEN 3 ELSE 0 END + CASE WHEN coalesce(ratio < 1, FALSE) THEN 3 ELSE 0 END AS score_deriv,
 CASE WHEN c24 IS NOT NULL AND c72 IS NOT NULL AND ratio IS NOT NULL THEN 'ok' WHEN c24 IS NOT NULL OR c72 IS NOT NULL OR ratio IS NOT NULL THEN 'partial' ELSE 'failed' END AS deriv_status FROM j2""")
def c04_derivative_score(spark, d):
    """Points and status at decision times."""
    # In the SQL null times stand last, so no observation that a decision can meet counts them.
    interest = sql(spark, d, _INTEREST).where("symbol IS NOT NULL AND ts_ms IS NOT NULL")
    changes = asof.bounded_changes(interest, "value", 200, 25, valid=F.col("value") > 5, place="place").where("n_valid > 0")
    first = asof.backward(sql(spark, d, _DECISIONS), changes, ["chg_24", "chg_72"], order=["place"]).drop("obs_ms")
    both = asof.backward(first, sql(spark, d, _timed(_RATIOS)), ["ratio"], order=_FULL_TIME)
    return scoring.derivative_score(both, "ratio").select("symbol", "ts_ms", "event_id", "score_deriv", "deriv_status")


@query("""WITH f AS (SELECT symbol, ts_ms, close, max(high) OVER x AS top FROM bars WINDOW x AS (PARTITION BY symbol ORDER BY ts_ms RANGE BETWEEN 3600000 FOLLOWING AND 86400000 FOLLOWING)), m AS (SELECT symbol, ts_ms, top / close AS m FROM f WHERE top / close >= 20),
 i AS (SELECT *, $div(ts_ms; 3600000) - row_number() OVER (PARTITION BY symbol ORDER BY ts_ms) AS island, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms) <= 6 * 3600000 THEN 0 ELSE 1 END AS nw FROM m), s AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY ts_ms) AS session FROM i)
 SELECT symbol, $int(session) AS session, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n_bars, count(DISTINCT island) AS segments, $r(max(m)) AS gain FROM s GROUP BY 1, 2""")
def d02_waves(spark, d):
    """Waves merged by time gap, with their segments."""
    return events.waves(domain(spark, d, "bars"), 24, 20.0, 6).select("symbol", "session", "start_ms", "end_ms", "n_bars", "segments", r("gain").alias("gain"))


@query(None)
def d01_greedy_pumps(spark, d):
    out = events.greedy_pumps(domain(spark, d, "daily"))
    return out.select("symbol", F.col("day").cast("string").alias("day"), F.col("trough").cast("string").alias("trough"), F.col("ignite").cast("string").alias("ignite"), r("gain").alias("gain"))


_FWD = """q AS (SELECT symbol, ts_ms - 1800000 AS ts_ms FROM bars), a AS (SELECT q.symbol, q.ts_ms, b.ts_ms AS ref_ms, b.open AS ref_price FROM q ASOF LEFT JOIN bars b ON b.symbol = q.symbol AND b.ts_ms >= q.ts_ms),
 e AS (SELECT symbol, max(ts_ms) AS data_end FROM bars GROUP BY 1), p AS (SELECT a.symbol, a.ts_ms, a.ref_ms, a.ref_price, max(b.high) AS hi, min(b.low) AS lo, count(b.ts_ms) AS n, arg_max(b.ts_ms, (b.high, -b.ts_ms)) AS peak_ms FROM a LEFT JOIN bars b ON b.symbol = a.symbol AND b.ts_ms >= a.ref_ms AND b.ts_ms < a.ref_ms + 48 * 3600000 GROUP BY 1, 2, 3, 4),
 z AS (SELECT p.*, CASE WHEN ref_ms IS NULL THEN 'no_reference' WHEN NOT (ref_ms + 47 * 3600000 <= data_end) THEN 'partial_tail' WHEN n < 48 THEN 'gap' ELSE 'complete' END AS state FROM p LEFT JOIN e ON e.symbol = p.symbol)"""


@query(f"WITH {_FWD} SELECT symbol, ts_ms, ref_ms, $r8(hi / ref_price) AS touch, $r8(least(0, lo / ref_price - 1)) AS worst, peak_ms, state, CASE WHEN hi / ref_price >= 5 THEN 'reach' WHEN state = 'complete' THEN 'no_reach' ELSE 'undetermined' END AS verdict FROM z")
def e01_forward_outcomes(spark, d):
    """Reference at the first bar's open, touch, worst, first peak and verdict over 48 hours."""
    bars = domain(spark, d, "bars")
    decisions = bars.select("symbol", (F.col("ts_ms") - 1_800_000).alias("ts_ms"))
    return outcomes.forward(decisions, bars, 48, 5.0).select("symbol", "ts_ms", "ref_ms", r("touch", 8).alias("touch"), r("worst", 8).alias("worst"), "peak_ms", "state", "verdict")


@query("""WITH g AS (SELECT symbol, $div(ts_ms; 3600000) AS h, close, high FROM bars), x AS (SELECT symbol, h, max(h) OVER (PARTITION BY symbol) AS last_h, max(close) OVER (PARTITION BY symbol ORDER BY h RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS ref, max(high) OVER f AS top, count(high) OVER f AS n FROM g WINDOW f AS (PARTITION BY symbol ORDER BY h RANGE BETWEEN 1 FOLLOWING AND 24 FOLLOWING)),
 s AS (SELECT *, CASE WHEN ref IS NULL THEN 'no_reference' WHEN h + 24 > last_h THEN 'partial_tail' WHEN n < 24 THEN 'gap' ELSE 'complete' END AS state FROM x) SELECT symbol, h AS hour_idx, $r8(top / ref) AS touch, state, CASE WHEN state = 'complete' THEN CASE WHEN top / ref >= 5 THEN 'reach' ELSE 'no_reach' END ELSE 'undetermined' END AS verdict FROM s""")
def e03_outcome_labels(spark, d):
    return outcomes.labels(domain(spark, d, "bars"), 24, 5.0).select("symbol", "hour_idx", r("touch", 8).alias("touch"), "state", "verdict")


@query("WITH x AS (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM samples) SELECT lang, count(*) AS n, $int(sum(label)) AS n1, $r(CASE WHEN count(*) >= 30 AND sum(label) BETWEEN 1 AND count(*) - 1 THEN (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) END) AS auc FROM x GROUP BY 1")
def f01_auc(spark, d):
    return stats.auc(domain(spark, d, "samples"), "score", "label", ["lang"]).select("lang", "n", "n1", r("auc").alias("auc"))


@query("WITH x AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY lang ORDER BY x1) + (count(*) OVER (PARTITION BY lang, x1) - 1) / 2.0 AS b FROM samples) SELECT lang, count(*) AS n, $r(CASE WHEN count(*) >= 30 THEN corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)) END) AS ic FROM x GROUP BY 1")
def f02_spearman(spark, d):
    return stats.spearman(domain(spark, d, "samples"), "score", "x1", ["lang"]).select("lang", "n", r("ic").alias("ic"))


_P_AT_N = "k AS (SELECT $div(ts_ms; 3600000) AS hour_idx, symbol, CASE WHEN close > open THEN 1 ELSE 0 END AS y, row_number() OVER (PARTITION BY ts_ms ORDER BY volume DESC, symbol) AS rk FROM bars WHERE trades > 1)"


@query(f"WITH {_P_AT_N}, n AS (SELECT unnest([1, 2, 3]) AS top_n) SELECT top_n, $int(sum(CASE WHEN rk <= top_n THEN 1 ELSE 0 END)) AS shown, $int(sum(CASE WHEN rk <= top_n AND y = 1 THEN 1 ELSE 0 END)) AS hits, $r(sum(CASE WHEN rk <= top_n AND y = 1 THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN rk <= top_n THEN 1 ELSE 0 END) AS DOUBLE)) AS p_at_n, $r(sum(CASE WHEN rk <= top_n AND y = 1 THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN rk <= top_n THEN 1 ELSE 0 END) AS DOUBLE) / avg(y)) AS lift FROM k CROSS JOIN n GROUP BY 1")
def f20_precision_at_n(spark, d):
    ranked = sql(spark, d, f"WITH {_P_AT_N} SELECT * FROM k")
    return stats.precision_at(ranked, "y", [1, 2, 3]).select("top_n", "shown", "hits", r("p_at_n").alias("p_at_n"), r("lift").alias("lift"))


@query("WITH s AS (SELECT symbol, ts_ms AS lo, ts_ms + 21600000 AS hi FROM bars WHERE trades >= 7), b AS (SELECT symbol, ts_ms, high FROM bars) SELECT b.symbol, s.lo, count(*) AS n, $r(max(b.high)) AS top FROM b JOIN s ON s.symbol = b.symbol AND b.ts_ms >= s.lo AND b.ts_ms < s.hi GROUP BY 1, 2")
def j11_range_join(spark, d):
    bars = domain(spark, d, "bars")
    spans = bars.where("trades >= 7").select("symbol", F.col("ts_ms").alias("lo"), (F.col("ts_ms") + 21_600_000).alias("hi"))
    joined = asof.nearest_in_range(bars.select("symbol", "ts_ms", "high"), spans, "symbol", "ts_ms", "lo", "hi", 86_400_000)
    return joined.groupBy("symbol", "lo").agg(F.count("*").alias("n"), r(F.max("high")).alias("top"))


@query("WITH k AS (SELECT symbol, ts_ms, row_number() OVER (PARTITION BY ts_ms ORDER BY volume DESC, symbol) AS rk FROM bars), e AS (SELECT symbol, ts_ms AS start_ms FROM bars WHERE trades >= 7) SELECT e.symbol, e.start_ms, $int(min(k.rk)) AS best_rank FROM e LEFT JOIN k ON k.symbol = e.symbol AND k.ts_ms >= e.start_ms - 43200000 AND k.ts_ms < e.start_ms GROUP BY 1, 2")
def j12_best_rank_before(spark, d):
    """The best rank in the 12 hours before an event: one window over the merged run, no range join."""
    ranked = domain(spark, d, "bars").withColumn("rk", F.row_number().over(Window.partitionBy("ts_ms").orderBy(F.col("volume").desc(), "symbol")))
    w = Window.partitionBy("symbol").orderBy("ts_ms").rangeBetween(-43_200_000, -1)
    return ranked.withColumn("best", F.min("rk").over(w)).where("trades >= 7").select("symbol", F.col("ts_ms").alias("start_ms"), F.col("best").cast("long").alias("best_rank"))


@query("WITH a AS (SELECT symbol, close / nullif(lag(close) OVER w, 0) - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC) AS back FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)) SELECT a.symbol, count(*) AS n, $r(covar_samp(a.ret, b.ret) / nullif(var_pop(b.ret), 0)) AS beta FROM a JOIN a b ON b.symbol = 'click' AND b.back = a.back WHERE a.back <= 100 AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1")
def j13_tail_aligned_beta(spark, d):
    """The benchmark aligned by position from the end, not by time."""
    w, back = windows.by_symbol(), Window.partitionBy("symbol").orderBy(F.col("ts_ms").desc())
    rets = domain(spark, d, "bars").select("symbol", (F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0)) - 1).alias("ret"), F.row_number().over(back).alias("back")).where("back <= 100")
    bench = rets.where("symbol = 'click'").select("back", F.col("ret").alias("bench"))
    both = rets.join(bench, "back").where("ret IS NOT NULL AND bench IS NOT NULL")
    return both.groupBy("symbol").agg(F.count("*").alias("n"), r(F.covar_samp("ret", "bench") / F.nullif(F.var_pop("bench"), F.lit(0.0))).alias("beta"))


@query("WITH e AS (SELECT symbol, day FROM daily WHERE volume >= 150), c AS (SELECT d.symbol, d.day FROM daily d WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.symbol = d.symbol AND abs($days(d.day; e.day)) < 45)) SELECT symbol, count(*) AS candidates, $ymd(min(day)) AS first_day FROM c GROUP BY 1")
def j15_control_days(spark, d):
    """Days at least 45 days from every event of their symbol: gaps to the nearest events by two running lookups."""
    w = Window.partitionBy("symbol").orderBy("day")
    hit = F.when(F.col("volume") >= 150, F.col("day"))
    before, after = F.last(hit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(hit, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    far = (F.coalesce(F.datediff("day", before), F.lit(9999)) >= 45) & (F.coalesce(F.datediff(after, F.col("day")), F.lit(9999)) >= 45)
    rows = domain(spark, d, "daily").withColumn("far", far).where("far")
    return rows.groupBy("symbol").agg(F.count("*").alias("candidates"), F.min("day").cast("string").alias("first_day"))


@query("WITH s AS (SELECT user_id, $ms(ts) AS t FROM events), n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 86400000 THEN 0 ELSE 1 END AS nw FROM s), g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t) AS session FROM n), z AS (SELECT user_id, session, min(t) AS lo, max(t) AS hi, count(*) AS n FROM g GROUP BY 1, 2), p AS (SELECT user_id, $ms(ts) + 7200000 AS t, event_id FROM events WHERE event_type = 'view') SELECT p.event_id, $int(min(z.session)) AS session FROM p LEFT JOIN z ON z.user_id = p.user_id AND p.t BETWEEN z.lo AND z.hi GROUP BY 1")
def j20_point_in_interval(spark, d):
    """The session that contains a point: the last one that begins before it, if it hasn't ended."""
    s = sql(spark, d, "SELECT user_id AS symbol, $ms(ts) AS ts_ms FROM events")
    z = windows.sessions(s, "ts_ms", 86_400_000, ["symbol"]).groupBy("symbol", "session").agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    points = sql(spark, d, "SELECT user_id AS symbol, $ms(ts) + 7200000 AS ts_ms, event_id FROM events WHERE event_type = 'view'")
    got = asof.backward(points, z.select("symbol", F.col("lo").alias("ts_ms"), "session", "hi"), ["session", "hi"])
    return got.select("event_id", F.when(F.col("ts_ms") <= F.col("hi"), F.col("session")).alias("session"))


# ---- what a history holds in an event's intervals
def _events(bars: DataFrame) -> DataFrame:
    return bars.where("trades >= 7").select("symbol", F.col("ts_ms").alias("t0"))


@query(evaluation.SQL["e06_event_tradability"])
def e06_event_tradability(spark, d):
    bars = domain(spark, d, "bars")
    out = intervals.tradability(bars.where("trades >= 7").select("symbol", F.col("ts_ms").alias("t0"), F.col("close").alias("p0")), bars, 24)
    return out.select("symbol", "t0", "hours", F.col("fillable").cast("long").alias("fillable"), r("spike_share").alias("spike_share"), r("hours_to_double").alias("hours_to_double"))


@query(evaluation.SQL["e07_reverse_coverage"])
def e07_reverse_coverage(spark, d):
    """Where the selections of an event's symbol lie, before, during or after it: differences of running counts."""
    bars = domain(spark, d, "bars")
    events_ = _events(bars).withColumn("t1", F.col("t0") + 6 * 3_600_000)
    return intervals.reverse_coverage(events_, bars.where("close > 4 * open"), 86_400_000, 86_400_000).select("symbol", "t0", "disposition")


@query(evaluation.SQL["e09_reminders"])
def e09_reminders(spark, d):
    bars = domain(spark, d, "bars")
    return intervals.reminders(_events(bars), bars.where("close > open"), 43_200_000).select("symbol", "t0", "reminders")


@query(evaluation.SQL["f21_recall_at_n"])
def f21_recall_at_n(spark, d):
    ranked = domain(spark, d, "bars").withColumn("rk", F.row_number().over(Window.partitionBy("ts_ms").orderBy(F.col("volume").desc(), "symbol")))
    found = intervals.best_before(ranked.where("trades >= 7").select("symbol", "ts_ms"), ranked, 86_400_000)
    return intervals.recall_at(found, [1, 2, 3]).select("top_n", "n_events", r("recall_any").alias("recall_any"), r("recall_start").alias("recall_start"))
