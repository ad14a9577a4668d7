"""Queries that one SQL text expresses: filters, joins, aggregations, sets, top-k, data quality.

Keys start with the operator's ID in the survey's inventory.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

# ---- sources and ingest, over the driver's tables
SQL["a02_dedupe_first"] = """SELECT user_id AS symbol, $hour(ts) AS ts_ms, $min_by(event_id; ts, event_id) AS event_id, $r($min_by(value; ts, event_id)) AS value, count(*) AS n_rows FROM events GROUP BY 1, 2"""
SQL["a04_dedupe_last"] = """SELECT user_id AS symbol, $hour(ts) AS ts_ms, $max_by(event_id; ts, event_id) AS event_id, $r($max_by(value; ts, event_id)) AS value FROM events GROUP BY 1, 2"""
SQL["a05_hourly_only"] = """SELECT symbol, ts_ms, $r(close) AS close FROM bars WHERE ts_ms % 14400000 = 0"""
SQL["a06_daily_summary"] = """SELECT user_id AS symbol, $ymd(ts) AS day, $r($max_by(CASE WHEN $hm(ts) <= '22:55' THEN value END; CASE WHEN $hm(ts) <= '22:55' THEN 1 ELSE 0 END, ts, event_id)) AS last_value, $r(avg(value)) AS mean_value, $r(avg(CASE WHEN $hm(ts) <= '22:55' THEN value END)) AS mean_cut FROM events GROUP BY 1, 2"""
SQL["a09_month_list"] = """SELECT symbol, $ym(day) AS month, count(*) AS bars FROM daily GROUP BY 1, 2"""
SQL["a16_caps_max"] = """SELECT base, $r(cap) AS cap FROM caps"""
SQL["a22_url_fields"] = """SELECT page_id, $extract(url, '^([a-z]+)://', 1) AS scheme, $extract(url, '://([^/?#]*)', 1) AS host, $extract(url, '://[^/?#]*([^?#]*)', 1) AS path, url LIKE '%?%' AS has_query FROM pages"""
SQL["a24_universe_diff"] = """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), u AS (SELECT k FROM a UNION SELECT k FROM b)
SELECT u.k AS custkey, a.k IS NOT NULL AS in_new, b.k IS NOT NULL AS in_old FROM u LEFT JOIN a ON u.k = a.k LEFT JOIN b ON u.k = b.k"""
SQL["a25_missing_months"] = """WITH months AS (SELECT DISTINCT $ym(day) AS month FROM daily), symbols AS (SELECT DISTINCT symbol FROM daily), seen AS (SELECT DISTINCT symbol, $ym(day) AS month FROM daily WHERE volume >= 40)
SELECT s.symbol, m.month FROM symbols s CROSS JOIN months m LEFT JOIN seen x ON x.symbol = s.symbol AND x.month = m.month WHERE x.month IS NULL"""

SQL["a03_rows_without_dedupe"] = """SELECT user_id AS symbol, $hour(ts) AS ts_ms, event_id FROM events"""
SQL["a08_month_window"] = """SELECT symbol, $ymd(day) AS day, $r(close) AS close FROM daily WHERE $ym(day) BETWEEN '1997-03' AND '1997-08' AND symbol IN ('Brand#1', 'Brand#2')"""
SQL["a10_day_list"] = """WITH s AS (SELECT symbol, min($int($days(day; DATE '1995-01-01'))) AS lo, max($int($days(day; DATE '1995-01-01'))) AS hi FROM daily GROUP BY 1), g AS (SELECT symbol, $explode_range(lo, hi) AS k FROM s) SELECT symbol, count(*) AS days FROM g GROUP BY 1"""
SQL["a12_unit_fix_and_clamp"] = """WITH x AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN $ms(ts) * 1000 WHEN event_id % 4 = 1 THEN 5 ELSE $ms(ts) END AS t FROM events), f AS (SELECT event_id, CASE WHEN t > 100000000000000 THEN $div(t; 1000) ELSE t END AS t FROM x) SELECT event_id, t FROM f WHERE t BETWEEN 1400000000000 AND 2100000000000"""
SQL["a14_long_cells"] = """SELECT symbol, $div(ts_ms; 3600000) AS hour_idx, trades FROM user_bars"""
SQL["a23_latest_by_time"] = """SELECT user_id, $r($max_by(value; ts, event_id)) AS latest, max($ms(ts)) AS at_ms FROM events GROUP BY 1"""

# ---- filters and projections
SQL["p01_safe_float"] = """SELECT event_id, coalesce($try_double(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(value AS STRING) END), 0.0) AS value FROM events"""
SQL["p04_universe_filter"] = """SELECT t.symbol, $r(t.quote_volume) AS quote_volume, $r(c.cap) AS cap FROM tickers t LEFT JOIN caps c ON t.base = c.base
WHERE t.symbol LIKE '%/USDT' AND t.symbol NOT LIKE '%:%' AND t.base NOT IN ('Brand#3') AND t.quote_volume BETWEEN 1000000 AND 1000000000000 AND (c.cap IS NULL OR c.cap <= 1998000)"""
SQL["p05_gates"] = """SELECT t.symbol, t.quote_volume >= 5000000 AS gate_vol_min, t.quote_volume <= 100000000000 AS gate_vol_max, c.cap IS NOT NULL AS gate_cap_known, coalesce(c.cap <= 1990000, TRUE) AS gate_cap, t.quote_volume >= 5000000 AND t.quote_volume <= 100000000000 AND coalesce(c.cap <= 1990000, TRUE) AS pass_gate FROM tickers t LEFT JOIN caps c ON t.base = c.base"""
SQL["p06_closed_bars"] = """SELECT symbol, count(*) AS closed, max(ts_ms) AS last_closed FROM bars WHERE ts_ms + 3600000 <= (SELECT max(ts_ms) FROM bars) GROUP BY symbol"""
SQL["p08_short_history"] = """SELECT symbol, count(*) AS n, CASE WHEN count(*) < 27 THEN 'short_history' ELSE 'ok' END AS status FROM user_bars GROUP BY symbol"""
SQL["p09_skip_reasons"] = """WITH x AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'inactive' WHEN c_mktsegment = 'MACHINERY' THEN 'non_spot' WHEN c_nationkey > 20 THEN 'no_futures' END AS reason FROM customer)
SELECT reason, count(*) AS n, min(c_custkey) AS first_key FROM x WHERE reason IS NOT NULL GROUP BY reason"""
SQL["p10_day_safe_filter"] = """SELECT $ymd(ts) AS day, count(*) AS n FROM events WHERE $hm(ts) <= '22:55' GROUP BY 1"""
SQL["p13_computed_columns"] = """SELECT event_id, $r(value - $k(props)) AS diff, round(value / nullif($k(props), 0), 9) AS ratio FROM events"""
SQL["p15_coverage_filter"] = """SELECT event_type, $r(avg(CASE WHEN $k(props) >= 40 THEN 1.0 ELSE 0.0 END)) AS coverage, avg(CASE WHEN $k(props) >= 40 THEN 1.0 ELSE 0.0 END) >= 0.6 AS kept FROM events GROUP BY 1"""
SQL["p16_median_impute"] = """WITH x AS (SELECT event_id, event_type, CASE WHEN $k(props) % 4 <> 0 THEN value END AS v FROM events), m AS (SELECT $pct(v, 0.5) AS med FROM x WHERE event_id % 3 <> 0)
SELECT event_id, $r(coalesce(v, med)) AS v FROM x CROSS JOIN m"""
SQL["p17_standardise"] = """WITH m AS (SELECT avg(value) AS mu, $stddev_pop(value) AS sd FROM events WHERE event_id % 3 <> 0) SELECT event_id, $r((value - mu) / nullif(sd, 0)) AS z FROM events CROSS JOIN m"""
SQL["p18_sanitize"] = """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE $r(value) END AS value FROM events"""
SQL["p19_ratios"] = """SELECT t.symbol, $r(t.quote_volume / nullif(c.cap, 0)) AS volume_cap_ratio, $r(t.fut_volume / nullif(c.cap, 0)) AS oi_cap_ratio FROM tickers t LEFT JOIN caps c ON t.base = c.base"""

SQL["p11_in_list"] = """SELECT $k(props) AS k, count(*) AS n, $r(avg(value)) AS mean_value FROM events WHERE $k(props) IN (1, 5, 50, 99) GROUP BY 1"""
SQL["p14_rename_before_join"] = """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS total FROM orders), b AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS total_lines FROM lineitem GROUP BY 1) SELECT a.k, $r(a.total) AS total, $r(b.total_lines) AS total_lines FROM a JOIN b ON a.k = b.k"""

# ---- joins
SQL["j01_inner"] = """SELECT o.o_orderkey, c.c_mktsegment, $r(o.o_totalprice) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""
SQL["j02_left"] = """SELECT c.c_custkey, count(o.o_orderkey) AS orders_n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' GROUP BY 1"""
SQL["j03_star"] = """SELECT n.n_name, r.r_name, p.p_type, count(*) AS n, $r(sum(l.l_extendedprice * (1 - l.l_discount))) AS revenue FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2, 3"""
SQL["j04_lookup_first"] = """WITH first_part AS (SELECT p_brand, $min_by(p_name; p_partkey) AS p_name FROM part GROUP BY 1) SELECT t.base, f.p_name FROM tickers t LEFT JOIN first_part f ON t.base = f.p_brand"""
SQL["j05_semi"] = """SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)"""
SQL["j06_anti_covered"] = """WITH monthly AS (SELECT symbol, $ym(day) AS ym FROM daily GROUP BY 1, 2 HAVING count(*) >= 16)
SELECT d.symbol, $ymd(d.day) AS day FROM daily d WHERE NOT EXISTS (SELECT 1 FROM monthly m WHERE m.symbol = d.symbol AND m.ym = $ym(d.day))"""
SQL["j10_exact_offsets"] = """WITH x AS (SELECT symbol, day, close, $days(day; DATE '2000-01-01') AS n FROM daily) SELECT symbol, $ymd(day) AS day, $r(close / nullif(max(close) OVER (PARTITION BY symbol ORDER BY n RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) - 1) AS chg1, $r(close / nullif(max(close) OVER (PARTITION BY symbol ORDER BY n RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING), 0) - 1) AS chg3, $r(close / nullif(max(close) OVER (PARTITION BY symbol ORDER BY n RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING), 0) - 1) AS chg7 FROM x"""
SQL["j14_grid"] = """WITH span AS (SELECT symbol, min(ts_ms) AS lo, max(ts_ms) AS hi FROM user_bars GROUP BY 1), grid AS (SELECT symbol, $explode_range($div(lo; 3600000), $div(hi; 3600000)) AS hour_idx FROM span)
SELECT g.symbol, g.hour_idx, b.ts_ms IS NOT NULL AS present FROM grid g LEFT JOIN user_bars b ON b.symbol = g.symbol AND b.ts_ms = g.hour_idx * 3600000"""
SQL["j16_full_diff"] = """WITH a AS (SELECT symbol, ts_ms, trades FROM user_bars WHERE trades > 1), b AS (SELECT symbol, ts_ms, CASE WHEN ts_ms % 7200000 = 0 THEN trades ELSE trades + 1 END AS trades FROM user_bars WHERE volume > 60)
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ts_ms, b.ts_ms) AS ts_ms, CASE WHEN a.symbol IS NULL THEN 'only_new' WHEN b.symbol IS NULL THEN 'only_old' WHEN a.trades = b.trades THEN 'same' ELSE 'changed' END AS state FROM a FULL OUTER JOIN b ON a.symbol = b.symbol AND a.ts_ms = b.ts_ms"""
SQL["j17_event_diff"] = """WITH o AS (SELECT user_id, ts, value FROM events WHERE value > 60 AND event_type <> 'view'), n AS (SELECT user_id, ts, value FROM events WHERE value > 50 AND event_type <> 'click')
SELECT CASE WHEN o.user_id IS NULL THEN 'only_new' WHEN n.user_id IS NULL THEN 'only_old' ELSE 'kept' END AS state, count(*) AS n FROM o FULL OUTER JOIN n ON o.user_id = n.user_id AND o.ts = n.ts GROUP BY 1"""
SQL["j18_daily_on_hourly"] = """WITH m AS (SELECT event_type AS symbol, $day(ts) AS day, avg(value) AS mean_value FROM events GROUP BY 1, 2), h AS (SELECT event_type AS symbol, $hour(ts) AS ts_ms, $day(ts) AS day, sum(value) AS volume FROM events GROUP BY 1, 2, 3)
SELECT h.symbol, h.ts_ms, $r(h.volume) AS volume, $r(m.mean_value) AS mean_value FROM h LEFT JOIN m ON m.symbol = h.symbol AND m.day = h.day"""
SQL["j19_planned_minus_local"] = """WITH planned AS (SELECT DISTINCT p_brand AS symbol, $ym(o_orderdate) AS month FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), local_ AS (SELECT DISTINCT symbol, $ym(day) AS month FROM daily WHERE volume > 30)
SELECT p.month, p.symbol FROM planned p LEFT JOIN local_ l ON l.symbol = p.symbol AND l.month = p.month WHERE l.symbol IS NULL"""

# ---- aggregations
SQL["g01_rates"] = """SELECT lang, count(*) AS n, $int(sum(label)) AS positives, $r(sum(CASE WHEN score > 2000 THEN label ELSE 0 END) / CAST(greatest(1, sum(CASE WHEN score > 2000 THEN 1 ELSE 0 END)) AS DOUBLE)) AS prec, $r(sum(CASE WHEN score > 2000 THEN label ELSE 0 END) / CAST(greatest(1, sum(label)) AS DOUBLE)) AS recall, $r((sum(CASE WHEN score > 2000 THEN label ELSE 0 END) / CAST(greatest(1, sum(CASE WHEN score > 2000 THEN 1 ELSE 0 END)) AS DOUBLE)) / nullif(avg(label), 0)) AS lift FROM samples GROUP BY lang"""
SQL["g02_condition_table"] = """WITH c AS (SELECT label, 'long' AS cond, score > 3000 AS hit FROM samples UNION ALL SELECT label, 'spaced', x2 > 300 FROM samples UNION ALL SELECT label, 'vowels', CASE WHEN lang = 'en' THEN x1 > 0.1 END FROM samples)
SELECT cond, count(*) AS n, $r(avg(CASE WHEN label = 1 THEN CAST(hit AS INT) END)) AS rate_pos, $r(avg(CASE WHEN label = 0 THEN CAST(hit AS INT) END)) AS rate_neg, $r(avg(CASE WHEN label = 1 THEN CAST(hit AS INT) END) - avg(CASE WHEN label = 0 THEN CAST(hit AS INT) END)) AS gap, $r(sum(CASE WHEN hit THEN label ELSE 0 END) / CAST(greatest(1, sum(CASE WHEN hit THEN 1 ELSE 0 END)) AS DOUBLE)) AS prec FROM c WHERE hit IS NOT NULL GROUP BY cond"""
SQL["g03_threshold_sweep"] = """WITH t AS (SELECT $explode_range(0, 9) AS k) SELECT $int(t.k) AS k, $int(sum(CASE WHEN score >= t.k * 500 THEN 1 ELSE 0 END)) AS n, $int(sum(CASE WHEN score >= t.k * 500 THEN label ELSE 0 END)) AS hits FROM samples CROSS JOIN t GROUP BY 1"""
SQL["g04_pool_comparison"] = """WITH p AS (SELECT doc_id, score >= 3000 AS in_old, score >= 2000 AS in_new, label FROM samples) SELECT in_new AND NOT in_old AS newly_included, count(*) AS n, $r(avg(label)) AS rate FROM p WHERE in_new GROUP BY 1"""
SQL["g05_quantiles"] = """SELECT event_type, $r($pct(value, 0.25)) AS q25, $r($pct(value, 0.5)) AS q50, $r($pct(value, 0.9)) AS q90, count(*) AS n FROM events GROUP BY 1"""
SQL["g06_payoff"] = """WITH r AS (SELECT user_id, value - 50 AS ret FROM events) SELECT user_id, CASE WHEN sum(CASE WHEN ret < 0 THEN 1 ELSE 0 END) >= 10 AND -sum(CASE WHEN ret < 0 THEN ret ELSE 0 END) > 0.000000001 THEN $r(avg(CASE WHEN ret > 0 THEN ret END) / -avg(CASE WHEN ret < 0 THEN ret END)) END AS payoff FROM r GROUP BY 1"""
SQL["g07_histogram"] = """SELECT CASE WHEN value < 10 THEN '[0,10)' WHEN value < 25 THEN '[10,25)' WHEN value < 50 THEN '[25,50)' WHEN value < 100 THEN '[50,100)' ELSE '[100,inf)' END AS bin, count(*) AS n, $r(avg(value)) AS mean_value FROM events GROUP BY 1"""
SQL["g09_edges_bins"] = """WITH e AS (SELECT $pct(score, 0.2) AS e1, $pct(score, 0.4) AS e2, $pct(score, 0.6) AS e3, $pct(score, 0.8) AS e4 FROM samples) SELECT CASE WHEN score <= e1 THEN 0 WHEN score <= e2 THEN 1 WHEN score <= e3 THEN 2 WHEN score <= e4 THEN 3 ELSE 4 END AS bin, count(*) AS n, $r(avg(label)) AS rate, $r(avg(score)) AS mean_score FROM samples CROSS JOIN e GROUP BY 1"""
SQL["g10_distinct"] = """SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT $day(ts)) AS days FROM events GROUP BY 1"""
SQL["g11_crosstab"] = """SELECT $int(year(o_orderdate)) AS y, $int(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)) AS f, $int(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)) AS o, $int(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)) AS p FROM orders GROUP BY 1"""
SQL["g12_vocabulary_counts"] = """WITH v AS (SELECT 'click' AS k UNION ALL SELECT 'view' UNION ALL SELECT 'refund'), c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT v.k AS status, coalesce(c.n, 0) AS n FROM v LEFT JOIN c ON c.event_type = v.k"""
SQL["g13_multi_cut"] = """SELECT 'overall' AS cut, 'all' AS level, count(*) AS n, $r(avg(score)) AS mean_score FROM samples UNION ALL SELECT 'lang', lang, count(*), $r(avg(score)) FROM samples GROUP BY lang UNION ALL SELECT 'label', CAST(label AS STRING), count(*), $r(avg(score)) FROM samples GROUP BY label UNION ALL SELECT 'score>=1000', 'all', count(*), $r(avg(score)) FROM samples WHERE score >= 1000 UNION ALL SELECT 'score>=4000', 'all', count(*), $r(avg(score)) FROM samples WHERE score >= 4000"""
SQL["g14_daily_list_size"] = """WITH d AS (SELECT $day(ts) AS day, count(DISTINCT user_id) AS n FROM events WHERE value > 80 GROUP BY 1) SELECT count(*) AS days, $r(avg(n)) AS mean_n, min(n) AS min_n, max(n) AS max_n, $r($pct(n, 0.5)) AS med_n FROM d"""
SQL["g15_pivot_last"] = """SELECT $hour(ts) AS ts_ms, $r($max_by(CASE WHEN event_type = 'click' THEN value END; CASE WHEN event_type = 'click' THEN 1 ELSE 0 END, ts, event_id)) AS click, $r($max_by(CASE WHEN event_type = 'view' THEN value END; CASE WHEN event_type = 'view' THEN 1 ELSE 0 END, ts, event_id)) AS view_ FROM events WHERE event_type IN ('click', 'view') GROUP BY 1"""
SQL["g16_split_pivot"] = """SELECT lang, $int(sum(CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END)) AS test_n, $int(sum(CASE WHEN doc_id % 4 <> 0 THEN 1 ELSE 0 END)) AS train_n FROM samples GROUP BY 1"""
SQL["g17_base_rate"] = """WITH f AS (SELECT avg(CASE WHEN label = 1 THEN CASE WHEN score > 2000 THEN 1.0 ELSE 0.0 END END) AS fp, avg(CASE WHEN label = 0 THEN CASE WHEN score > 2000 THEN 1.0 ELSE 0.0 END END) AS fc FROM samples) SELECT $r(fp) AS f_pos, $r(fc) AS f_ctl, $r(fp * 822 / nullif(fp * 822 + fc * 579282, 0)) AS precision_at_base FROM f"""
SQL["g18_break_even"] = """WITH r AS (SELECT event_type, value - 50 AS ret FROM events), s AS (SELECT event_type, avg(CASE WHEN ret > 0 THEN ret END) AS w, avg(CASE WHEN ret <= 0 THEN ret END) AS l, $pct(CASE WHEN ret > 0 THEN ret END, 0.5) AS wm, $pct(CASE WHEN ret <= 0 THEN ret END, 0.5) AS lm FROM r GROUP BY 1) SELECT event_type, $r(-l / nullif(w - l, 0)) AS p_mean, $r(-lm / nullif(wm - lm, 0)) AS p_median FROM s"""
SQL["g19_tier_share"] = """SELECT CASE WHEN value >= 200 THEN 'x10' WHEN value >= 100 THEN 'x5' WHEN value >= 60 THEN 'x3' WHEN value >= 40 THEN 'x2' ELSE 'none' END AS tier, count(*) AS n, $r(count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE)) AS share FROM events GROUP BY 1"""
SQL["g20_status_reconciled"] = """WITH g AS (SELECT symbol, $div(max(ts_ms) - min(ts_ms); 3600000) + 1 AS cells, count(*) AS present FROM user_bars GROUP BY 1) SELECT $int(sum(cells)) AS cells, $int(sum(present)) AS present, $int(sum(cells - present)) AS not_observable FROM g"""
SQL["g21_round_stats"] = """SELECT count(*) AS scope, $int(sum(CASE WHEN trades >= 2 THEN 1 ELSE 0 END)) AS complete, $r(avg(CASE WHEN trades >= 2 THEN 1.0 ELSE 0.0 END)) AS completeness, min(ts_ms) AS oldest FROM user_bars"""
SQL["g22_bytes_by_category"] = """SELECT source, lang, count(*) AS files, $int(sum(n_chars)) AS bytes FROM documents GROUP BY 1, 2"""
SQL["g23_keep_max"] = """SELECT user_id, $ymd(ts) AS day, $r(max(value)) AS gain, $max_by(event_id; value, event_id) AS event_id FROM events GROUP BY 1, 2"""
SQL["g24_mean_without_best"] = """SELECT user_id, count(*) AS n, $r(CASE WHEN count(*) > 1 THEN (sum(value) - max(value)) / (count(*) - 1) END) AS mean_rest FROM events GROUP BY 1"""
SQL["g25_missing_policy"] = """WITH x AS (SELECT value, CASE WHEN $k(props) % 3 = 0 THEN NULL ELSE $k(props) END AS k FROM events) SELECT 'pool' AS grp, count(*) AS n, $r(avg(value)) AS mean_value FROM x UNION ALL SELECT 'known', count(*), $r(avg(value)) FROM x WHERE k IS NOT NULL UNION ALL SELECT 'missing', count(*), $r(avg(value)) FROM x WHERE k IS NULL"""
SQL["g26_failure_attribution"] = """SELECT CASE WHEN label = 1 THEN 'hit' WHEN score < 500 THEN 'short' WHEN x1 > 0.12 THEN 'vowels' ELSE 'other' END AS reason, count(*) AS n FROM samples GROUP BY 1"""
SQL["g27_referential"] = """SELECT 'orphan_orders' AS chk, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey) UNION ALL SELECT 'duplicate_lines', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) d"""
SQL["g28_gap_runs"] = """WITH x AS (SELECT symbol, ts_ms, lead(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms) AS nxt FROM user_bars) SELECT symbol, ts_ms + 3600000 AS gap_start, nxt - 3600000 AS gap_end, $div(nxt - ts_ms; 3600000) - 1 AS hours FROM x WHERE nxt > ts_ms + 3600000"""
SQL["g29_queue_profile"] = """WITH l AS (SELECT l_orderkey, l_returnflag, l_extendedprice FROM lineitem), o AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus <> 'P') SELECT l.l_returnflag AS flag, count(*) AS n, count(DISTINCT l.l_orderkey) AS distinct_n, $int(sum(CASE WHEN o.o_orderkey IS NULL THEN 1 ELSE 0 END)) AS missing, min($ymd(o.o_orderdate)) AS first_day, max($ymd(o.o_orderdate)) AS last_day FROM l LEFT JOIN o ON l.l_orderkey = o.o_orderkey GROUP BY 1"""
SQL["g30_systematic_sample"] = """WITH x AS (SELECT event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_id, $r(value) AS value FROM x WHERE (rn - 1) % greatest($div(n; 40), 1) = 0"""

# ---- sorts, limits, top-k
SQL["t01_top_by_volume"] = """SELECT symbol, $r(quote_volume) AS quote_volume FROM tickers ORDER BY quote_volume DESC, symbol LIMIT 10"""
SQL["t02_candidate_rank"] = """WITH p AS (SELECT *, row_number() OVER (ORDER BY quote_volume DESC, symbol) AS pos FROM tickers) SELECT symbol, $int(row_number() OVER (ORDER BY coalesce(taker, -1) DESC, fut_volume DESC, pos)) AS rank_taker, $int(row_number() OVER (ORDER BY fut_volume DESC, pos)) AS rank_volume, $int(row_number() OVER (ORDER BY symbol)) AS rank_other FROM p"""
SQL["t03_threshold_fallback"] = """WITH s AS (SELECT symbol, percentage, row_number() OVER (ORDER BY percentage DESC, symbol) AS rn, $int(sum(CASE WHEN percentage >= 99 THEN 1 ELSE 0 END) OVER ()) AS chosen FROM tickers) SELECT symbol, $r(percentage) AS percentage FROM s WHERE (chosen > 0 AND percentage >= 99) OR (chosen = 0 AND rn <= 10)"""
SQL["t04_top_percent"] = """WITH r AS (SELECT doc_id, label, row_number() OVER (ORDER BY score DESC, doc_id) AS rn, count(*) OVER () AS n FROM samples), p AS (SELECT 1 AS pct UNION ALL SELECT 2 UNION ALL SELECT 5 UNION ALL SELECT 10) SELECT pct, count(*) AS k, $int(sum(label)) AS hits FROM r JOIN p ON rn <= greatest(1, $div(n * pct; 100)) GROUP BY pct"""
SQL["t05_top_n_curve"] = """WITH b AS (SELECT user_id, min(rk) AS best FROM (SELECT user_id, row_number() OVER (PARTITION BY $day(ts) ORDER BY value DESC, event_id) AS rk FROM events) x GROUP BY 1), h AS (SELECT best, count(*) AS n FROM b GROUP BY 1) SELECT $int(best) AS top_n, $int(sum(n) OVER (ORDER BY best)) AS covered FROM h"""
SQL["t06_retention_scale"] = """WITH b AS (SELECT user_id, min(rk) AS best FROM (SELECT user_id, row_number() OVER (PARTITION BY $day(ts) ORDER BY value DESC, event_id) AS rk FROM events) x GROUP BY 1), h AS (SELECT best, sum(count(*)) OVER (ORDER BY best) AS covered FROM b GROUP BY best), t AS (SELECT count(*) AS base FROM b), p AS (SELECT 100 AS pct UNION ALL SELECT 95 UNION ALL SELECT 90 UNION ALL SELECT 80)
SELECT p.pct, $int(min(h.best)) AS needed_n, min(h.best) IS NULL AS unreachable FROM p CROSS JOIN t LEFT JOIN h ON h.covered >= ceil(t.base * p.pct / 100.0) GROUP BY p.pct"""
SQL["t07_queue_order"] = """SELECT o_orderkey, $int(row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderdate, o_orderkey)) AS pos FROM orders"""
SQL["t08_stratified_sample"] = """WITH x AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source FROM x WHERE (rn - 1) % greatest($div(n; 4), 1) = 0 AND $div(rn - 1; greatest($div(n; 4), 1)) < 4"""
SQL["t09_cases"] = """SELECT * FROM (SELECT 'best' AS kind, event_id, $r(value) AS value FROM events ORDER BY value DESC, event_id LIMIT 20) a UNION ALL SELECT * FROM (SELECT 'worst' AS kind, event_id, $r(value) AS value FROM events ORDER BY value, event_id LIMIT 10) b"""

# ---- sets
SQL["s01_union_dedupe"] = """WITH u AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, user_id, ts FROM events WHERE event_id % 3 = 0) SELECT event_id, count(*) AS copies FROM u GROUP BY 1"""
SQL["s02_positives_controls"] = """SELECT doc_id, 1 AS label FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 0 AS label FROM labels WHERE toxic = 0 AND doc_id % 5 = 0"""
SQL["s03_differences"] = """SELECT 'only_events' AS side, k FROM (SELECT user_id AS k FROM events EXCEPT SELECT o_custkey AS k FROM orders) a UNION ALL SELECT 'both', k FROM (SELECT user_id AS k FROM events INTERSECT SELECT o_custkey AS k FROM orders) b"""
SQL["s04_conflicts"] = """WITH c AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1) SELECT l.l_orderkey, count(*) AS kept FROM lineitem l LEFT JOIN c ON l.l_orderkey = c.l_orderkey AND l.l_linenumber = c.l_linenumber WHERE c.l_orderkey IS NULL GROUP BY 1"""
SQL["s05_pending"] = """SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'F') AND o.o_orderstatus <> 'P'"""
SQL["s06_missing_periods"] = """WITH b AS (SELECT event_type AS symbol, min($div($ms(ts); 3600000)) AS lo, max($div($ms(ts); 3600000)) AS hi FROM events GROUP BY 1), e AS (SELECT symbol, $explode_range(lo, hi) AS h FROM b), p AS (SELECT DISTINCT event_type AS symbol, $div($ms(ts); 3600000) AS h FROM events) SELECT e.symbol, $int(e.h) AS hour_idx FROM e LEFT JOIN p ON p.symbol = e.symbol AND p.h = e.h WHERE p.h IS NULL"""
SQL["s07_partition"] = """SELECT label = 1 AND score > 2000 AS captured, count(*) AS n FROM samples GROUP BY 1"""
SQL["s09_three_way"] = """WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 49) SELECT CASE WHEN a.k IS NULL THEN 'b_only' WHEN b.k IS NULL THEN 'a_only' ELSE 'both' END AS part, count(*) AS n, min(coalesce(a.k, b.k)) AS sample FROM a FULL OUTER JOIN b ON a.k = b.k GROUP BY 1"""
SQL["s10_pareto_front"] = """WITH r AS (SELECT p_brand AS rule_id, $r(avg(p_retailprice)) AS pump, $r(avg(p_size)) AS ret7, count(*) AS share FROM part GROUP BY 1) SELECT a.rule_id, a.pump, a.ret7, a.share FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.pump >= a.pump AND b.ret7 >= a.ret7 AND (b.pump > a.pump OR b.ret7 > a.ret7) AND b.share <= a.share)"""

# ---- data quality
SQL["q01_ohlc_violations"] = """SELECT symbol, $int(sum(CASE WHEN high < greatest(open, close) - 0.000000000001 OR low > least(open, close) + 0.000000000001 OR volume < 0 THEN 1 ELSE 0 END)) AS violations, count(*) AS n FROM bars GROUP BY 1"""
SQL["q02_order_and_duplicates"] = """WITH x AS (SELECT user_id, $hour(ts) AS ts_ms, lag($hour(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) SELECT user_id, $int(sum(CASE WHEN ts_ms = prev THEN 1 ELSE 0 END)) AS dups, $int(sum(CASE WHEN ts_ms < prev THEN 1 ELSE 0 END)) AS unsorted_n FROM x GROUP BY 1"""
SQL["q03_period_vs_content"] = """WITH f AS (SELECT o_orderkey, $ym(o_orderdate) AS named, min($ym(l_shipdate)) AS lo, max($ym(l_shipdate)) AS hi FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT CASE WHEN named < lo THEN 'before' WHEN named > hi THEN 'after' ELSE 'inside' END AS state, count(*) AS n FROM f GROUP BY 1"""
SQL["q04_manifest_validation"] = """SELECT count(*) AS n, $int(sum(CASE WHEN o_totalprice <= 0 THEN 1 ELSE 0 END)) AS bad_size, $int(sum(CASE WHEN o_orderpriority NOT LIKE '_-%' THEN 1 ELSE 0 END)) AS bad_key, count(*) - count(DISTINCT o_orderkey) AS duplicates FROM orders"""
SQL["q05_file_profile"] = """SELECT symbol, count(*) AS n, min(ts_ms) AS lo, max(ts_ms) AS hi, $div(max(ts_ms) - min(ts_ms); 3600000) + 1 - count(*) AS missing FROM user_bars GROUP BY 1"""
SQL["q07_reconciliation"] = """SELECT count(*) AS scope, $int(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)) AS skipped_inactive, $int(sum(CASE WHEN c_acctbal >= 0 AND c_nationkey > 20 THEN 1 ELSE 0 END)) AS skipped_market, $int(sum(CASE WHEN c_acctbal >= 0 AND c_nationkey <= 20 THEN 1 ELSE 0 END)) AS rows_n, count(*) = sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) + sum(CASE WHEN c_acctbal >= 0 AND c_nationkey > 20 THEN 1 ELSE 0 END) + sum(CASE WHEN c_acctbal >= 0 AND c_nationkey <= 20 THEN 1 ELSE 0 END) AS ok FROM customer"""
SQL["q08_coverage_bias"] = """SELECT label, score > 1000 AS covered, count(*) AS n FROM samples GROUP BY 1, 2"""
SQL["q09_recomputed"] = """WITH pub AS (SELECT l_returnflag, count(*) + CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS n FROM lineitem GROUP BY 1), re AS (SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) SELECT coalesce(pub.l_returnflag, re.l_returnflag) AS flag, CASE WHEN pub.n IS NULL OR re.n IS NULL THEN 'UNVERIFIED' WHEN pub.n = re.n THEN 'PASS' ELSE 'FAIL' END AS state FROM pub FULL OUTER JOIN re ON pub.l_returnflag = re.l_returnflag"""
SQL["q06_checksum_states"] = """WITH e AS (SELECT event_id % 50 AS name, max(value) AS v FROM events WHERE event_id % 3 <> 0 GROUP BY 1), f AS (SELECT event_id % 60 AS name, max(value) AS v FROM events WHERE event_id % 3 <> 1 GROUP BY 1) SELECT e.name, CASE WHEN f.name IS NULL THEN 'missing' WHEN e.name % 7 = 0 THEN 'needs_verify' WHEN e.v = f.v THEN 'done' ELSE 'bad' END AS state FROM e LEFT JOIN f ON f.name = e.name"""
SQL["r02_hour_bucket_latest"] = """SELECT user_id, $hour(ts) AS hour_ms, $r($max_by(value; ts, event_id)) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2"""
SQL["r07_health_log"] = """SELECT event_type AS lane, $ymd(ts) AS day, count(*) AS rows_n, $int(sum(CASE WHEN value < 1 THEN 1 ELSE 0 END)) AS suspect, max($ms(ts)) AS last_ms FROM events GROUP BY 1, 2"""
SQL["r08_queue_progress"] = """WITH d AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'F') SELECT o_orderstatus, CASE WHEN d.k IS NULL THEN 'pending' ELSE 'done' END AS state, count(*) AS n FROM orders LEFT JOIN d ON d.k = o_orderkey GROUP BY 1, 2"""
SQL["r09_throughput_plateau"] = """WITH t AS (SELECT $div($ms(ts); 86400000) AS w, count(*) AS rate FROM events GROUP BY 1), g AS (SELECT w, rate, rate / CAST(nullif(lag(rate) OVER (ORDER BY w), 0) AS DOUBLE) - 1 AS growth FROM t), p AS (SELECT w, rate, growth, lag(growth) OVER (ORDER BY w) AS before FROM g) SELECT w, rate, coalesce(growth < 0.1 AND before < 0.1, FALSE) AS plateau FROM p"""
SQL["r10_budget_cut"] = """WITH c AS (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM documents) SELECT source, count(*) AS inside, $int(max(used)) AS used FROM c WHERE used <= 50000 GROUP BY 1"""
SQL["c02_threshold_variants"] = """WITH t AS (SELECT 10 AS th UNION ALL SELECT 20 UNION ALL SELECT 35) SELECT th, count(*) AS n, $int(sum(CASE WHEN value >= th THEN 1 ELSE 0 END)) AS reached FROM events CROSS JOIN t GROUP BY 1"""
