"""Window queries that one SQL text expresses: indicators, ranks, transitions, future windows.

``w`` is always the symbol's history, ``w<n>`` its last n rows with the current one, ``b<n>``
the n rows before it.
"""

from __future__ import annotations

SQL: dict[str, str] = {}


def _rows(name: str, start: int, end: int, order: str = "ts_ms") -> str:
    edge = lambda k: "CURRENT ROW" if k == 0 else f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"
    return f"{name} AS (PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {edge(start)} AND {edge(end)})"


def _frames(*names: str, order: str = "ts_ms") -> str:
    out = []
    for n in names:
        k = int(n[1:]) if n[1:] else 0
        if n == "w":
            out.append(f"w AS (PARTITION BY symbol ORDER BY {order})")
        elif n[0] == "w":
            out.append(_rows(n, 1 - k, 0, order))
        elif n[0] == "b":
            out.append(_rows(n, -k, -1, order))
        elif n[0] == "p":  # the n rows before the last n
            out.append(_rows(n, 1 - 2 * k, -k, order))
        elif n[0] == "q":  # and those before them
            out.append(_rows(n, 1 - 3 * k, -2 * k, order))
        elif n[0] == "u":
            out.append(f"u AS (PARTITION BY symbol ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return "WINDOW " + ", ".join(out)


_TR = "SELECT symbol, ts_ms, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)"
_RET = "SELECT symbol, ts_ms, open, high, low, close, volume, close / nullif(lag(close) OVER w, 0) - 1 AS ret, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)"

SQL["w01_prev_close"] = "SELECT symbol, ts_ms, $r(lag(close) OVER w) AS prev_close FROM bars " + _frames("w")
SQL["w02_true_range"] = f"SELECT symbol, ts_ms, $r(tr) AS tr FROM ({_TR}) x"
SQL["w03_atr"] = f"SELECT symbol, ts_ms, $r($full(avg, tr, w14, 14)) AS atr FROM ({_TR}) x " + _frames("w14")
SQL["w07_avg_volume"] = "SELECT symbol, ts_ms, $r($full(avg, volume, b24, 24)) AS avg_volume FROM bars " + _frames("b24")
SQL["w08_day_volumes"] = "SELECT symbol, ts_ms, $r($full(sum, volume, w24, 24)) AS v24, $r($full(sum, volume, p24, 24)) AS prev24 FROM bars " + _frames("w24", "p24")
SQL["w09_stairs"] = "SELECT symbol, ts_ms, $r($full(sum, volume, w4, 4)) AS v4, $r($full(sum, volume, p4, 4)) AS prev4, $full(sum, volume, w4, 4) > $full(sum, volume, p4, 4) AND $full(sum, volume, p4, 4) > $full(sum, volume, q4, 4) AS stairs FROM bars " + _frames("w4", "p4", "q4")
SQL["w10_taker_share"] = "SELECT symbol, ts_ms, $r(CASE WHEN count(*) OVER w24 >= 11 AND sum(volume) OVER w24 > 0 THEN sum(taker) OVER w24 / sum(volume) OVER w24 END) AS share FROM bars " + _frames("w24")
SQL["w11_returns"] = "SELECT symbol, ts_ms, $r(close / nullif(lag(close, 4) OVER w, 0) - 1) AS r4, $r(close / nullif(lag(close, 12) OVER w, 0) - 1) AS r12, $r(close / nullif(lag(close, 24) OVER w, 0) - 1) AS r24, $r(close / nullif(lag(close, 72) OVER w, 0) - 1) AS r72, $r(close / nullif(lag(close, 168) OVER w, 0) - 1) AS r168 FROM bars " + _frames("w")
SQL["w12_move_48h"] = "SELECT symbol, ts_ms, $r(($full(max, high, w48, 48) - $full(min, low, w48, 48)) / nullif($full(min, low, w48, 48), 0)) AS move FROM bars " + _frames("w48")
SQL["w14_drawdown"] = "SELECT symbol, ts_ms, $r(max(close) OVER u) AS peak, $r(close / nullif(max(close) OVER u, 0) - 1) AS drawdown FROM bars " + _frames("u0")
SQL["w15_rsi"] = "WITH d AS (SELECT symbol, ts_ms, close - lag(close) OVER w AS d FROM bars " + _frames("w") + ") SELECT symbol, ts_ms, $r(CASE WHEN count(d) OVER w14 = 14 THEN 100 * sum(CASE WHEN d > 0 THEN d ELSE 0 END) OVER w14 / nullif(sum(abs(d)) OVER w14, 0) END) AS rsi FROM d " + _frames("w14")
SQL["w16_realised_vol"] = f"SELECT symbol, ts_ms, $r($full(stddev_pop, ret, w24, 24) * sqrt(24)) AS vol24, $r($full(stddev_pop, ret, w168, 168) * sqrt(168)) AS vol168 FROM ({_RET}) x " + _frames("w24", "w168")
SQL["w17_skew_kurt"] = "SELECT symbol, ts_ms, $r(CASE WHEN count(close) OVER w48 = 48 THEN $skew(close; w48) END) AS skew, $r(CASE WHEN count(close) OVER w48 = 48 THEN $kurt(close; w48) END) AS kurt FROM bars " + _frames("w48")
SQL["w18_vol_of_vol"] = f"WITH v AS (SELECT symbol, ts_ms, $full(stddev_samp, ret, w24, 24) AS v FROM ({_RET}) x " + _frames("w24") + ") SELECT symbol, ts_ms, $r($full(stddev_samp, v, w72, 72)) AS vov FROM v " + _frames("w72")
SQL["w19_slope"] = f"SELECT symbol, ts_ms, $r(CASE WHEN count(close) OVER w24 = 24 THEN regr_slope(close, i) OVER w24 END) AS slope24, $r(CASE WHEN count(close) OVER w72 = 72 THEN regr_slope(close, i) OVER w72 END) AS slope72 FROM ({_RET}) x " + _frames("w24", "w72")
SQL["w21_beta"] = f"WITH r AS ({_RET}), m AS (SELECT a.symbol, a.ts_ms, a.ret, b.ret AS bench FROM r a JOIN r b ON b.symbol = 'click' AND b.ts_ms = a.ts_ms WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL) SELECT symbol, ts_ms, $r(CASE WHEN count(ret) OVER w24 = 24 THEN covar_samp(ret, bench) OVER w24 / nullif(var_pop(bench) OVER w24, 0) END) AS beta FROM m " + _frames("w24")
SQL["w22_up_share"] = f"SELECT symbol, ts_ms, $r(CASE WHEN count(ret) OVER w24 = 24 THEN avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) OVER w24 END) AS up_share FROM ({_RET}) x " + _frames("w24")
SQL["w23_range_position"] = "SELECT symbol, ts_ms, $r((close - $full(min, low, w24, 24)) / nullif($full(max, high, w24, 24) - $full(min, low, w24, 24), 0)) AS pos, $r(close / nullif($full(max, high, w24, 24), 0) - 1) AS dist_high, $r(close / nullif($full(min, low, w24, 24), 0) - 1) AS dist_low, close >= 0.999 * $full(max, high, w24, 24) AS new_high FROM bars " + _frames("w24")
SQL["w24_bars_since"] = f"WITH r AS ({_RET}), s AS (SELECT symbol, ts_ms, i, CASE WHEN ret > 1 THEN i END AS hit FROM r) SELECT symbol, ts_ms, i - $last(hit; u) AS since_big_up FROM s " + _frames("u0")
SQL["w25_concentration"] = "WITH x AS (SELECT symbol, ts_ms, volume, sum(volume) OVER w24 AS s, sum(volume * volume) OVER w24 AS s2, avg(volume) OVER w24 AS mu, stddev_pop(volume) OVER w24 AS sd, count(volume) OVER w24 AS n FROM bars " + _frames("w24") + ") SELECT symbol, ts_ms, $r(CASE WHEN n = 24 THEN s2 / nullif(s * s, 0) END) AS hhi, $r(CASE WHEN n = 24 THEN (volume - mu) / nullif(sd, 0) END) AS z, $r(CASE WHEN n = 24 THEN sd / nullif(mu, 0) END) AS cv FROM x"
SQL["w26_candle_anatomy"] = "WITH x AS (SELECT symbol, ts_ms, abs(close - open) / nullif(high - low, 0) AS body, (high - greatest(open, close)) / nullif(high - low, 0) AS upper_, (least(open, close) - low) / nullif(high - low, 0) AS lower_ FROM bars) SELECT symbol, ts_ms, $r(avg(body) OVER w24) AS body, $r(avg(upper_) OVER w24) AS upper_wick, $r(avg(lower_) OVER w24) AS lower_wick FROM x " + _frames("w24")
SQL["w27_dry_up"] = "SELECT symbol, ts_ms, $r($full(avg, volume, w24, 24) / nullif($full(avg, volume, w72, 72), 0)) AS dry_up, $r(($full(max, high, w24, 24) - $full(min, low, w24, 24)) / nullif($full(max, high, w72, 72) - $full(min, low, w72, 72), 0)) AS quiet FROM bars " + _frames("w24", "w72")
SQL["w28_calendar_rolling"] = "WITH h AS (SELECT symbol, $div(ts_ms; 3600000) AS hour_idx, close, volume FROM bars) SELECT symbol, hour_idx, $r(CASE WHEN count(close) OVER c24 = 24 THEN avg(close) OVER c24 END) AS mean24, $r(CASE WHEN count(volume) OVER c24 = 24 THEN sum(volume) OVER c24 END) AS qv24 FROM h WINDOW c24 AS (PARTITION BY symbol ORDER BY hour_idx RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)"
SQL["w29_cross_rank"] = "SELECT ts_ms, symbol, $int(row_number() OVER (PARTITION BY ts_ms ORDER BY volume DESC, symbol)) AS rk FROM bars WHERE trades > 1"
SQL["w31_percentile_rank"] = "WITH x AS (SELECT symbol, ts_ms, row_number() OVER (PARTITION BY ts_ms ORDER BY close, symbol) AS rn, count(*) OVER (PARTITION BY ts_ms) AS n FROM bars) SELECT symbol, ts_ms, $r((rn - 1) / CAST(greatest(n - 1, 1) AS DOUBLE)) AS pr FROM x"
SQL["w32_market_rank"] = "WITH days AS (SELECT day, lag(day) OVER (ORDER BY day) AS prev_day FROM (SELECT DISTINCT day FROM daily) d), r AS (SELECT a.symbol, a.day, a.close / nullif(b.close, 0) - 1 AS ret FROM daily a JOIN days ON days.day = a.day LEFT JOIN daily b ON b.symbol = a.symbol AND b.day = days.prev_day) SELECT symbol, $ymd(day) AS day, $int(rank() OVER (PARTITION BY day ORDER BY ret DESC)) AS rk FROM r WHERE ret IS NOT NULL"
SQL["w33_average_rank"] = "SELECT doc_id, rank() OVER (PARTITION BY lang ORDER BY x2) + (count(*) OVER (PARTITION BY lang, x2) - 1) / CAST(2 AS DOUBLE) AS rk FROM samples"
SQL["w34_rank_product"] = "WITH x AS (SELECT doc_id, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS a, (rank() OVER (ORDER BY x1) + (count(*) OVER (PARTITION BY x1) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS b FROM samples) SELECT doc_id, $r(a * b) AS product FROM x"
SQL["w36_future_window"] = "WITH h AS (SELECT symbol, $div(ts_ms; 3600000) AS hour_idx, high FROM bars) SELECT symbol, hour_idx, $r(max(high) OVER f) AS max_high, count(high) OVER f AS n FROM h WINDOW f AS (PARTITION BY symbol ORDER BY hour_idx RANGE BETWEEN 1 FOLLOWING AND 72 FOLLOWING)"
SQL["w37_future_rows"] = "SELECT symbol, ts_ms, $r(max(high) OVER f) AS max_high FROM bars WINDOW " + _rows("f", 1, 72)
SQL["w38_local_peak"] = "WITH r AS (SELECT symbol, day, close, close / nullif(lag(close, 30) OVER w, 0) - 1 AS ret30 FROM daily " + _frames("w", order="day") + ") SELECT symbol, $ymd(day) AS day, $r(ret30) AS ret30 FROM (SELECT *, max(ret30) OVER p AS m FROM r WINDOW " + _rows("p", -10, 10, "day") + ") x WHERE ret30 >= 1 AND ret30 = m"
SQL["w39_trough"] = "SELECT symbol, $ymd(day) AS day, $r(min(low) OVER w61) AS trough FROM daily " + _frames("w61", order="day")
SQL["w40_trajectory"] = "WITH s AS (SELECT symbol, day, CASE WHEN close > avg(close) OVER b20 THEN 1 ELSE 0 END + CASE WHEN volume > avg(volume) OVER b20 THEN 1 ELSE 0 END AS s FROM daily " + _frames("b20", order="day") + ") SELECT symbol, $ymd(day) AS day, s - lag(s, 3) OVER w AS d3, s - lag(s, 5) OVER w AS d5, (s - lag(s, 3) OVER w) - (lag(s, 3) OVER w - lag(s, 6) OVER w) AS accel, $r(avg(CASE WHEN s >= 1 THEN 1.0 ELSE 0.0 END) OVER w5) AS persistence, s = 2 AND coalesce(lag(s) OVER w, 0) < 2 AS newly_pooled, s = max(s) OVER w10 AS is_peak FROM s " + _frames("w", "w5", "w10", order="day")
SQL["w42_fresh_flip"] = "WITH c AS (SELECT symbol, ts_ms, CASE WHEN close > open THEN 1 ELSE 0 END AS c FROM bars) SELECT symbol, ts_ms, c = 1 AND min(c) OVER b3 = 0 AS fresh FROM c " + _frames("b3")
SQL["w43_trailing"] = "SELECT symbol, $ymd(day) AS day, $r(close / nullif(lag(close, 1) OVER w, 0) - 1) AS r1, $r(close / nullif(lag(close, 7) OVER w, 0) - 1) AS r7, $r(close / nullif(lag(close, 30) OVER w, 0) - 1) AS r30, $r(close / nullif(max(close) OVER w60, 0) - 1) AS dd60 FROM daily " + _frames("w", "w60", order="day")
SQL["w44_transitions"] = "WITH m AS (SELECT symbol, ts_ms, row_number() OVER (PARTITION BY ts_ms ORDER BY volume DESC, symbol) <= 2 AS inside FROM bars) SELECT symbol, ts_ms, CASE WHEN inside THEN 'enter' ELSE 'leave' END AS step FROM (SELECT *, coalesce(lag(inside) OVER w, FALSE) AS before FROM m " + _frames("w") + ") x WHERE inside <> before"
SQL["w45_context"] = "SELECT symbol, $ymd(day) AS day, $int($days(day; min(day) OVER u)) AS age, $int($days(day; lag(day) OVER w)) AS since_last, day = last_day(day) AS month_end FROM daily " + _frames("w", "u0", order="day")

# ---- scoring and gates over windows
_SCORED = "SELECT symbol, ts_ms, close, volume, i, $full(max, high, b24, 24) AS box_high, $full(min, low, b24, 24) AS box_low, $full(avg, close, w50, 50) AS base, $full(sum, volume, w24, 24) AS v24, $full(sum, volume, p24, 24) AS prev24, $full(avg, volume, b24, 24) AS avg_volume FROM (" + _RET + ") x " + _frames("w24", "w50", "b24", "p24")
SQL["c01_weighted_score"] = f"SELECT symbol, ts_ms, CASE WHEN box_high IS NULL OR base IS NULL THEN NULL ELSE CASE WHEN close > base THEN 5 ELSE 0 END + CASE WHEN close > box_high THEN 2 ELSE 0 END + CASE WHEN i >= 48 AND v24 > prev24 THEN 1 ELSE 0 END END AS score FROM ({_SCORED}) s"
SQL["c05_strict_variant"] = f"SELECT symbol, count(*) AS n, $int(sum(CASE WHEN v24 / nullif(prev24, 0) - 1 >= 0.1 THEN 4 ELSE 0 END)) AS live_points, $int(sum(CASE WHEN v24 / nullif(prev24, 0) - 1 > 0.1 AND prev24 IS NOT NULL THEN 4 ELSE 0 END)) AS research_points FROM ({_SCORED}) s GROUP BY 1"
SQL["c06_breakout_signal"] = f"WITH a AS (SELECT symbol, ts_ms, $full(avg, tr, w14, 14) AS atr FROM ({_TR}) t " + _frames("w14") + f"), s AS ({_SCORED}), x AS (SELECT s.symbol, s.ts_ms, s.close, greatest(s.close - 1.5 * a.atr, 0.995 * s.box_high) AS stop_ FROM s JOIN a ON a.symbol = s.symbol AND a.ts_ms = s.ts_ms WHERE s.i >= 53 AND s.close > s.box_high AND s.volume >= 1.5 * s.avg_volume AND s.close > s.base) SELECT symbol, ts_ms, $r(close) AS entry, $r(stop_) AS stop_price, $r(close + 2 * (close - stop_)) AS take_profit FROM x WHERE close - stop_ > 0"
SQL["c07_extra_score"] = "SELECT t.symbol, CASE WHEN t.fut_volume >= t.quote_volume / 40000 THEN 1 ELSE 0 END + CASE WHEN c.cap <= 1980000 THEN 2 WHEN c.cap <= 1995000 THEN 1 ELSE 0 END + CASE WHEN t.quote_volume / nullif(c.cap, 0) >= 40 THEN 2 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = length(t.base)) THEN 1 ELSE 0 END AS extra FROM tickers t LEFT JOIN caps c ON c.base = t.base"
SQL["c08_status_machine"] = "WITH x AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS oi, count(*) FILTER (WHERE event_type = 'signup') AS ls, count(*) FILTER (WHERE event_type = 'error') AS err FROM events GROUP BY 1) SELECT user_id, CASE WHEN oi = 0 AND ls = 0 THEN 'no_futures' WHEN err > 30 THEN 'paused' WHEN oi >= 15 AND ls >= 1 THEN 'ok' WHEN oi + ls < 5 THEN 'failed' ELSE 'partial' END AS status FROM x"
SQL["c11_cell_status"] = "WITH g AS (SELECT symbol, ts_ms, count(*) OVER u AS n_closed, ts_ms - lag(ts_ms) OVER w AS gap, CASE WHEN close > open THEN 5 ELSE 0 END AS total FROM user_bars " + _frames("w", "u0") + ") SELECT symbol, ts_ms, CASE WHEN n_closed < 26 THEN 'kline_short_history' WHEN gap > 3600000 THEN 'kline_gap' WHEN total >= 5 THEN 'selected' ELSE 'scored_below_threshold' END AS status FROM g"
SQL["c13_leverage_veto"] = "WITH x AS (SELECT t.symbol, t.fut_volume AS oi, CASE WHEN c.cap IS NULL THEN NULL ELSE t.quote_volume / 10000 END AS spot FROM tickers t LEFT JOIN caps c ON c.base = t.base AND c.cap < 1995000) SELECT symbol, $r(oi / nullif(spot, 0)) AS ratio, CASE WHEN spot IS NULL OR spot <= 0 OR oi IS NULL THEN 'unknown' WHEN oi / spot > 0.28 THEN 'veto' ELSE 'keep' END AS verdict FROM x"
SQL["c14_gate_specs"] = "WITH q AS (SELECT $filter_pct(score; 0.6; doc_id % 3 <> 0) AS t60 FROM samples), f AS (SELECT label, score > 1500 AS a, x1 > 0.1 AS b, x2 > 250 AS c, score > t60 AS d FROM samples CROSS JOIN q) SELECT 'additive' AS gate, count(*) AS n, $r(avg(label)) AS rate FROM f WHERE CAST(a AS INT) * 3 + CAST(b AS INT) * 2 + CAST(c AS INT) >= 4 UNION ALL SELECT 'conjunction', count(*), $r(avg(label)) FROM f WHERE a AND b AND c UNION ALL SELECT 'two_of_three', count(*), $r(avg(label)) FROM f WHERE CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) >= 2 UNION ALL SELECT 'additive_veto', count(*), $r(avg(label)) FROM f WHERE CAST(a AS INT) * 3 + CAST(b AS INT) * 2 + CAST(c AS INT) >= 4 AND NOT d"
SQL["c15_tradability"] = "SELECT symbol, coalesce(max(high) / nullif(min(low), 0) > 2, FALSE) AND coalesce(sum(volume) > 100, FALSE) AND coalesce(count(*) >= 50, FALSE) AS tradable FROM user_bars GROUP BY 1"
SQL["c16_dynamic_buckets"] = "SELECT CASE WHEN score < 500 THEN 'cold' WHEN score < 2000 THEN 'warm' ELSE 'hot' END AS bucket, count(*) AS n, $r(avg(label)) AS rate, $r($pct(score, 0.5)) AS med FROM samples GROUP BY 1"
SQL["c17_death_verdict"] = "WITH x AS (SELECT lang, source, count(*) AS n, avg(label) AS rate, avg(toxic) AS tox FROM samples GROUP BY 1, 2) SELECT lang, source, CASE WHEN n < 3 THEN 'too_small' WHEN rate = 1 AND tox = 0 THEN 'alive' WHEN tox > 0.3 THEN 'poisoned' WHEN rate < 0.5 THEN 'dead' WHEN n < 6 THEN 'weak' ELSE 'mixed' END AS verdict FROM x"
SQL["c18_hindsight"] = "WITH x AS (SELECT event_type, corr(value, $k(props)) AS c_now, corr(value, CAST(user_id AS DOUBLE)) AS c_before FROM events GROUP BY 1) SELECT event_type, CASE WHEN abs(c_now) < 0.03 AND abs(c_before) < 0.03 THEN 'noise' WHEN abs(c_now) >= abs(c_before) AND c_now > 0 THEN 'leading' WHEN c_now < 0 THEN 'inverse' ELSE 'lagging' END AS verdict FROM x"
SQL["c19_derived"] = "SELECT doc_id, $r(score * x1) AS m04, $r(ln(1 + score) - ln(1 + x2)) AS m05, $r(sign(x1 - 0.1) * ln(1 + abs(x1 - 0.1))) AS m06, $r(score / nullif(x2, 0)) AS m09 FROM samples"
SQL["c20_combo"] = "WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS a, row_number() OVER (ORDER BY x1, doc_id) AS b, row_number() OVER (ORDER BY x2, doc_id) AS c, count(*) OVER () AS n FROM samples) SELECT doc_id, $r((-(a - 1) / CAST(greatest(n - 1, 1) AS DOUBLE) - (b - 1) / CAST(greatest(n - 1, 1) AS DOUBLE) + (c - 1) / CAST(greatest(n - 1, 1) AS DOUBLE)) / 3) AS combo3 FROM x"

# ---- episodes and sessions
SQL["d04_episodes"] = "WITH s AS (SELECT symbol, $div(ts_ms; 3600000) AS h, trades, volume FROM bars WHERE close > open), i AS (SELECT *, h - row_number() OVER (PARTITION BY symbol ORDER BY h) AS g FROM s) SELECT symbol, min(h) * 3600000 AS start_ms, count(*) AS n_hours, $int(min(trades)) AS min_trades, $int(max(trades)) AS max_trades FROM i GROUP BY symbol, g"
SQL["d05_occupancy"] = "WITH m AS (SELECT symbol, $div(ts_ms; 3600000) AS h, row_number() OVER (PARTITION BY ts_ms ORDER BY volume DESC, symbol) AS rk FROM bars), i AS (SELECT symbol, h, h - 2 * row_number() OVER (PARTITION BY symbol ORDER BY h) AS g FROM m WHERE rk <= 2 AND h % 2 = 0) SELECT symbol, min(h) AS first_h, count(*) AS points FROM i GROUP BY symbol, g"
SQL["d06_qv24"] = "SELECT symbol, ts_ms, $r(CASE WHEN count(close) OVER w24 = 24 THEN sum(close * volume) OVER w24 END) AS qv24 FROM bars " + _frames("w24")
