"""Outcome, coverage and evaluation queries that one SQL text expresses."""

from __future__ import annotations

SQL: dict[str, str] = {}

_FOLD = "CASE WHEN doc_id % 100 < 40 THEN 0 WHEN doc_id % 100 < 60 THEN 1 WHEN doc_id % 100 < 80 THEN 2 ELSE 3 END"

# ---- outcomes and coverage
SQL["e02_granularity_fallback"] = "WITH f AS (SELECT symbol, ts_ms, $over(high; open) AS t FROM user_bars WHERE trades > 1), c AS (SELECT symbol, $div(ts_ms; 86400000) * 86400000 AS d, $over(max(high); min(low)) AS t FROM user_bars GROUP BY 1, 2) SELECT u.symbol, u.ts_ms, CASE WHEN f.t IS NOT NULL THEN 'fine' WHEN c.t IS NOT NULL THEN 'coarse' ELSE 'none' END AS granularity, $r_half(coalesce(f.t, c.t)) AS touch FROM user_bars u LEFT JOIN f ON f.symbol = u.symbol AND f.ts_ms = u.ts_ms LEFT JOIN c ON c.symbol = u.symbol AND c.d = $div(u.ts_ms; 86400000) * 86400000"
SQL["e04_proxy_labels"] = "WITH h AS (SELECT symbol, $div(ts_ms; 3600000) AS hour_idx, CASE WHEN trades >= 7 THEN 1 ELSE 0 END AS starts FROM bars) SELECT symbol, hour_idx, coalesce(max(starts) OVER (PARTITION BY symbol ORDER BY hour_idx RANGE BETWEEN 1 FOLLOWING AND 24 FOLLOWING), 0) AS e FROM h"
SQL["e05_horizon_returns"] = "WITH x AS (SELECT symbol, day, close, low, high, min(day) OVER f AS d0, max(high) OVER f AS mfe, min(low) OVER f AS mae, $plus_days(day, 7) AS target FROM daily WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)) SELECT x.symbol, $ymd(x.day) AS day, $r(t.close / nullif(x.close, 0) - 1) AS ret7, $r(x.mfe / nullif(x.close, 0) - 1) AS mfe, $r(x.mae / nullif(x.close, 0) - 1) AS mae FROM x LEFT JOIN daily t ON t.symbol = x.symbol AND t.day = x.target"
SQL["e06_event_tradability"] = "WITH e AS (SELECT symbol, ts_ms AS t0, close AS p0 FROM bars WHERE trades >= 7), p AS (SELECT e.symbol, e.t0, e.p0, b.ts_ms, b.high, b.low, b.close, b.volume FROM e JOIN bars b ON b.symbol = e.symbol AND b.ts_ms BETWEEN e.t0 AND e.t0 + 86400000) SELECT symbol, t0, count(*) AS hours, $int(sum(CASE WHEN low <= p0 THEN 1 ELSE 0 END)) AS fillable, $r(max(volume) / nullif(sum(volume), 0)) AS spike_share, $r(min(CASE WHEN high >= 2 * p0 THEN (ts_ms - t0) / 3600000.0 END)) AS hours_to_double FROM p GROUP BY 1, 2"
SQL["e07_reverse_coverage"] = "WITH e AS (SELECT symbol, ts_ms AS t0, ts_ms + 6 * 3600000 AS t1 FROM bars WHERE trades >= 7), s AS (SELECT symbol, ts_ms FROM bars WHERE close > 4 * open), c AS (SELECT e.symbol, e.t0, max(CASE WHEN s.ts_ms < e.t0 AND s.ts_ms >= e.t0 - 86400000 THEN 1 ELSE 0 END) AS pre, max(CASE WHEN s.ts_ms BETWEEN e.t0 AND e.t1 THEN 1 ELSE 0 END) AS mid, max(CASE WHEN s.ts_ms > e.t1 AND s.ts_ms <= e.t1 + 86400000 THEN 1 ELSE 0 END) AS late FROM e LEFT JOIN s ON s.symbol = e.symbol AND s.ts_ms BETWEEN e.t0 - 86400000 AND e.t1 + 86400000 GROUP BY 1, 2) SELECT symbol, t0, CASE WHEN pre = 1 THEN 'before' WHEN mid = 1 THEN 'during' WHEN late = 1 THEN 'late' ELSE 'missed' END AS disposition FROM c"
SQL["e08_workload"] = "WITH m AS (SELECT symbol, $div(ts_ms; 3600000) AS h, row_number() OVER (PARTITION BY ts_ms ORDER BY volume DESC, symbol) AS rk FROM bars), c AS (SELECT 1 AS cadence UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 6), q AS (SELECT cadence, symbol, h, lag(h) OVER (PARTITION BY cadence, symbol ORDER BY h) AS before FROM m JOIN c ON m.h % c.cadence = 0 WHERE rk <= 2) SELECT cadence, count(*) AS shown, $int(sum(CASE WHEN before IS NULL THEN 1 ELSE 0 END)) AS first_adds, $int(sum(CASE WHEN h - before > cadence THEN 1 ELSE 0 END)) AS re_adds FROM q GROUP BY 1"
SQL["e09_reminders"] = "WITH e AS (SELECT symbol, ts_ms AS t0 FROM bars WHERE trades >= 7), s AS (SELECT symbol, ts_ms FROM bars WHERE close > open) SELECT e.symbol, e.t0, count(s.ts_ms) AS reminders FROM e LEFT JOIN s ON s.symbol = e.symbol AND s.ts_ms > e.t0 - 43200000 AND s.ts_ms <= e.t0 GROUP BY 1, 2"
SQL["e10_causal_features"] = "WITH h AS (SELECT symbol, $div(ts_ms; 3600000) + 1 AS hour_idx, close, high, low, volume FROM bars) SELECT symbol, hour_idx, $r(CASE WHEN count(high) OVER c = 48 THEN close / nullif(max(high) OVER c, 0) - 1 END) AS dist48, $r(CASE WHEN count(high) OVER c = 48 THEN (max(high) OVER c - min(low) OVER c) / nullif(min(low) OVER c, 0) END) AS boxwidth, $r(CASE WHEN count(volume) OVER c = 48 THEN volume / nullif(avg(volume) OVER c, 0) END) AS volratio FROM h WINDOW c AS (PARTITION BY symbol ORDER BY hour_idx RANGE BETWEEN 47 PRECEDING AND CURRENT ROW)"
SQL["e11_pump_features"] = "WITH x AS (SELECT symbol, ts_ms, $div(ts_ms; 86400000) AS d, close, volume, avg(close) OVER w50 AS base, max(high) OVER b24 AS box_high, sum(volume) OVER w4 AS v4, sum(volume) OVER p4 AS prev4 FROM bars WINDOW w50 AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), b24 AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), w4 AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), p4 AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING)) SELECT symbol, d AS day_idx, $max_by(close > base; ts_ms) AS c_trend, $max_by(close > box_high; ts_ms) AS c_breakout, $max_by(v4 > prev4; ts_ms) AS c_v4up, $r($max_by(close; ts_ms)) AS close FROM x WHERE ts_ms % 86400000 <= 22 * 3600000 GROUP BY 1, 2"
SQL["e12_derivative_features"] = "WITH o AS (SELECT user_id % 20 AS symbol, $day(ts) AS day, avg(value) AS oi, min(value) AS lo, avg(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END) AS neg FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT a.symbol, $ymd(a.day) AS day, $r(a.oi / nullif(b.oi, 0) - 1) AS chg1, $r(c.oi / nullif(a.oi, 0) - 1) AS fwd2, $r((SELECT min(z.lo) FROM o z WHERE z.symbol = a.symbol AND z.day > $plus_days(a.day, -7) AND z.day <= a.day)) AS min7, $r(a.neg) AS neg_ratio FROM o a LEFT JOIN o b ON b.symbol = a.symbol AND b.day = $plus_days(a.day, -1) LEFT JOIN o c ON c.symbol = a.symbol AND c.day = $plus_days(a.day, 2)"
SQL["e14_condition_panel"] = "WITH x AS (SELECT symbol, ts_ms, CASE WHEN close > open THEN 1 ELSE 0 END + CASE WHEN volume > avg(volume) OVER b THEN 2 ELSE 0 END AS s FROM bars WINDOW b AS (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)), d AS (SELECT symbol, $div(ts_ms; 86400000) AS day_idx, $max_by(s; ts_ms) AS s FROM x WHERE ts_ms % 86400000 <= 22 * 3600000 GROUP BY 1, 2) SELECT symbol, day_idx, s, s - lag(s) OVER (PARTITION BY symbol ORDER BY day_idx) AS d1 FROM d"
SQL["e15_depth_features"] = "SELECT user_id % 20 AS symbol, $ymd(ts) AS day, count(*) AS snapshots, $r6($max_by(CASE WHEN $k(props) < 50 THEN value END; CASE WHEN $k(props) < 50 THEN 1 ELSE 0 END, ts, event_id)) AS last_bid, $r6(avg(CASE WHEN $k(props) < 50 THEN value END)) AS bid_mean, $r6(avg(CASE WHEN $k(props) >= 50 THEN value END)) AS ask_mean, $r6(ln((sum(CASE WHEN $k(props) < 50 THEN value ELSE 0 END) + 1) / (sum(CASE WHEN $k(props) >= 50 THEN value ELSE 0 END) + 1))) AS imbalance FROM events GROUP BY 1, 2 HAVING count(*) >= 10"

# ---- statistics
SQL["f04_stat_block"] = "WITH v AS (SELECT 'score' AS var, score AS x, label FROM samples UNION ALL SELECT 'x1', x1, label FROM samples UNION ALL SELECT 'x2', CASE WHEN doc_id % 5 = 0 THEN NULL ELSE x2 END, label FROM samples), k AS (SELECT var, x, label, rank() OVER (PARTITION BY var ORDER BY x) + (count(*) OVER (PARTITION BY var, x) - 1) / CAST(2 AS DOUBLE) AS rk FROM v WHERE x IS NOT NULL), c AS (SELECT var, $r(avg(CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END)) AS coverage FROM v GROUP BY 1) SELECT k.var, count(*) AS n, max(c.coverage) AS coverage, $r((sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / CAST(2 AS DOUBLE)) / nullif(sum(label) * (count(*) - sum(label)), 0)) AS auc FROM k JOIN c ON c.var = k.var GROUP BY k.var"
SQL["f07_conditional_terciles"] = "WITH b AS (SELECT score, label, row_number() OVER (ORDER BY x1, doc_id) AS rn, count(*) OVER () AS n FROM samples), t AS (SELECT score, label, $int(greatest(ceil((rn - 1) * 3 / CAST(greatest(n - 1, 1) AS DOUBLE)) - 1, 0)) AS bin FROM b), k AS (SELECT bin, label, rank() OVER (PARTITION BY bin ORDER BY score) + (count(*) OVER (PARTITION BY bin, score) - 1) / CAST(2 AS DOUBLE) AS rk FROM t) SELECT bin, count(*) AS n, $r((sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / CAST(2 AS DOUBLE)) / nullif(sum(label) * (count(*) - sum(label)), 0)) AS auc FROM k GROUP BY bin"
SQL["f08_sign_flip"] = "WITH s AS (SELECT 'score' AS var, sign(avg(CASE WHEN label = 1 THEN score END) - avg(CASE WHEN label = 0 THEN score END)) AS sg FROM samples WHERE doc_id % 2 = 0 UNION ALL SELECT 'x1', sign(avg(CASE WHEN label = 1 THEN x1 END) - avg(CASE WHEN label = 0 THEN x1 END)) FROM samples WHERE doc_id % 2 = 0), t AS (SELECT 'score' AS var, sign(avg(CASE WHEN label = 1 THEN score END) - avg(CASE WHEN label = 0 THEN score END)) AS sg FROM samples WHERE doc_id % 2 = 1 UNION ALL SELECT 'x1', sign(avg(CASE WHEN label = 1 THEN x1 END) - avg(CASE WHEN label = 0 THEN x1 END)) FROM samples WHERE doc_id % 2 = 1) SELECT s.var, s.sg = t.sg AS same_sign FROM s JOIN t ON t.var = s.var"
SQL["f09_rank_tournament"] = "WITH k AS (SELECT score, x2, row_number() OVER (ORDER BY x1, doc_id) AS rn, count(*) OVER () AS n FROM samples), b AS (SELECT score, x2, $int(greatest(ceil((rn - 1) * 5 / CAST(greatest(n - 1, 1) AS DOUBLE)) - 1, 0)) AS bin FROM k) SELECT $r($filter_pct(score; 0.5; bin = 4) - $pct(score, 0.5)) AS q5_minus_pool, $r($filter_pct(score; 0.5; bin = 4) - $filter_pct(score; 0.5; bin = 0)) AS q5_minus_q1 FROM b"
SQL["f10_walk_forward"] = "WITH c AS (SELECT 250 AS cut UNION ALL SELECT 500 UNION ALL SELECT 750) SELECT $int(c.cut) AS cut, $int(sum(CASE WHEN s.doc_id < c.cut THEN 1 ELSE 0 END)) AS train_n, $int(sum(CASE WHEN s.doc_id >= c.cut THEN 1 ELSE 0 END)) AS test_n, $r(avg(CASE WHEN s.doc_id >= c.cut THEN s.label END)) AS test_rate FROM samples s CROSS JOIN c GROUP BY 1"
SQL["f11_disjoint_folds"] = f"SELECT $int({_FOLD}) AS fold, count(*) AS n, $r(avg(label)) AS rate FROM samples GROUP BY 1"
SQL["f12_train_threshold"] = f"WITH s AS (SELECT *, {_FOLD} AS fold FROM samples), t AS (SELECT $pct(score, 0.8) AS th FROM s WHERE fold = 0) SELECT $int(fold) AS fold, $r(max(th)) AS threshold, $r($filter_pct(x2; 0.5; score > th) - $pct(x2, 0.5)) AS delta_median, $r(avg(CASE WHEN score > th THEN label END) - avg(label)) AS delta_rate FROM s CROSS JOIN t WHERE fold > 0 GROUP BY 1"
SQL["f14_fold_summary"] = f"WITH s AS (SELECT *, {_FOLD} AS fold FROM samples), b AS (SELECT fold, avg(label) AS base FROM s GROUP BY 1), f AS (SELECT 'long' AS rule_id, fold, avg(label) AS rate FROM s WHERE score > 2000 GROUP BY fold UNION ALL SELECT 'vowels', fold, avg(label) FROM s WHERE x1 > 0.1 GROUP BY fold) SELECT f.rule_id, count(*) AS folds, $int(sum(CASE WHEN f.rate >= b.base - 0.000000001 THEN 1 ELSE 0 END)) AS not_worse FROM f JOIN b ON b.fold = f.fold GROUP BY 1"
SQL["f15_quantile_spread"] = "WITH q AS (SELECT $pct(score, 0.2) AS lo, $pct(score, 0.8) AS hi FROM samples) SELECT $r(avg(CASE WHEN score >= hi THEN label END) - avg(CASE WHEN score <= lo THEN label END)) AS spread FROM samples CROSS JOIN q"
SQL["f18_information_gain"] = "WITH p AS (SELECT label, lang, avg(label) OVER (PARTITION BY lang) AS m, avg(label) OVER () AS b FROM samples), c AS (SELECT label, least(greatest(m, 0.001), 0.999) AS m, b FROM p) SELECT $r((avg(-(label * ln(b) + (1 - label) * ln(1 - b))) - avg(-(label * ln(m) + (1 - label) * ln(1 - m)))) / ln(2)) AS bits FROM c"
SQL["f19_chi_square"] = "WITH t AS (SELECT label, score > 1000 AS c, count(*) AS n FROM samples GROUP BY 1, 2), e AS (SELECT n, sum(n) OVER (PARTITION BY label) * CAST(sum(n) OVER (PARTITION BY c) AS DOUBLE) / sum(n) OVER () AS ex FROM t) SELECT $r(sum((n - ex) * (n - ex) / nullif(ex, 0))) AS chi2 FROM e"
SQL["f21_recall_at_n"] = "WITH k AS (SELECT symbol, ts_ms, row_number() OVER (PARTITION BY ts_ms ORDER BY volume DESC, symbol) AS rk FROM bars), e AS (SELECT symbol, ts_ms AS t0 FROM bars WHERE trades >= 7), m AS (SELECT e.symbol, e.t0, min(k.rk) AS best, min(CASE WHEN k.ts_ms = e.t0 - 3600000 THEN k.rk END) AS at_start FROM e LEFT JOIN k ON k.symbol = e.symbol AND k.ts_ms >= e.t0 - 86400000 AND k.ts_ms < e.t0 GROUP BY 1, 2), n AS (SELECT 1 AS top_n UNION ALL SELECT 2 UNION ALL SELECT 3) SELECT top_n, count(*) AS n_events, $r(avg(CASE WHEN best <= top_n THEN 1.0 ELSE 0.0 END)) AS recall_any, $r(avg(CASE WHEN at_start <= top_n THEN 1.0 ELSE 0.0 END)) AS recall_start FROM m CROSS JOIN n GROUP BY 1"
SQL["f22_split_without_crossing"] = "WITH h AS (SELECT symbol, $div(ts_ms; 3600000) AS h FROM bars), s AS (SELECT min(h) + 480 AS cut FROM h) SELECT CASE WHEN h.h >= s.cut THEN 'test' WHEN h.h + 72 >= s.cut THEN 'cross' ELSE 'train' END AS part, count(*) AS n FROM h CROSS JOIN s GROUP BY 1"
SQL["f23_segments"] = "WITH h AS (SELECT symbol, $div(ts_ms; 3600000) AS h, high / open AS touch FROM bars), s AS (SELECT min(h) + 480 AS cut FROM h) SELECT CASE WHEN h.h + 24 < s.cut THEN 'explore' WHEN h.h >= s.cut THEN 'review' ELSE 'cross' END AS segment, count(*) AS n, $r($pct(touch, 0.5)) AS med_touch FROM h CROSS JOIN s GROUP BY 1"
SQL["f24_clock_sensitivity"] = "WITH d AS (SELECT user_id, $ymd(ts) AS day, $max_by(value; event_id) AS v_file, $max_by(value; ts) AS v_2355, $max_by(CASE WHEN $hm(ts) <= '22:55' THEN value END; CASE WHEN $hm(ts) <= '22:55' THEN 1 ELSE 0 END, ts) AS v_2255 FROM events GROUP BY 1, 2) SELECT count(*) AS n, $int(sum(CASE WHEN v_file = v_2355 THEN 1 ELSE 0 END)) AS same_file, $int(sum(CASE WHEN v_2255 = v_2355 THEN 1 ELSE 0 END)) AS same_cut FROM d"
SQL["f25_publication_lag"] = "SELECT o_orderpriority, $r($pct($days(l_shipdate; o_orderdate), 0.5)) AS med_lag, $int(max($days(l_shipdate; o_orderdate))) AS max_lag FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"
SQL["f26_reskin_check"] = "WITH k AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE) AS a, rank() OVER (ORDER BY x2) + (count(*) OVER (PARTITION BY x2) - 1) / CAST(2 AS DOUBLE) AS b FROM samples) SELECT $r(corr(a, b)) AS rho, abs(corr(a, b)) >= 0.9 AS reskin FROM k"
SQL["f27_label_cleaning"] = "WITH t AS (SELECT doc_id, label, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 3 = 0 END AS tradable FROM samples) SELECT doc_id, CASE WHEN label = 1 AND NOT tradable THEN 0 ELSE label END AS label FROM t WHERE NOT (label = 1 AND tradable IS NULL)"
SQL["f28_rule_acceptance"] = f"WITH s AS (SELECT *, {_FOLD} AS fold FROM samples), b AS (SELECT fold, avg(label) AS base, avg(x2) AS base_x, count(*) AS n FROM s GROUP BY 1), f AS (SELECT 'long' AS rule_id, fold, avg(label) AS rate, avg(x2) AS mx, count(*) AS n FROM s WHERE score > 2500 GROUP BY fold UNION ALL SELECT 'short', fold, avg(label), avg(x2), count(*) FROM s WHERE score <= 2500 GROUP BY fold) SELECT f.rule_id, min(CASE WHEN f.rate >= b.base - 0.000000001 AND f.mx >= b.base_x - 0.000000001 THEN 1 ELSE 0 END) = 1 AND sum(f.n) / CAST(sum(b.n) AS DOUBLE) <= 0.5 AND count(*) = 4 AS accepted FROM f JOIN b ON b.fold = f.fold GROUP BY 1"
