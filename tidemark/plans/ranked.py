"""Queries by exact positions, ranks, quantiles and resampling of whole tables; the SQL of each is written with windows and percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as fn
from tidemark.operators import ranks, resampling, stats, walkforward
from tidemark.plans import evaluation, relational, windowed
from tidemark.plans.domain import domain, sql, table
from tidemark.plans.engine import query, r


@query(relational.SQL["t02_candidate_rank"])
def t02_candidate_rank(spark, d):
    """Candidates' positions by each key; full ties keep the order by volume."""
    out = ranks.numbered(domain(spark, d, "tickers"), "pos", F.col("quote_volume").desc(), "symbol")
    for name, order in {"rank_taker": [F.coalesce("taker", F.lit(-1.0)).desc(), F.col("fut_volume").desc(), "pos"], "rank_volume": [F.col("fut_volume").desc(), "pos"], "rank_other": ["symbol"]}.items():
        out = ranks.numbered(out, name, *order)
    return out.select("symbol", "rank_taker", "rank_volume", "rank_other")


@query(relational.SQL["t03_threshold_fallback"])
def t03_threshold_fallback(spark, d):
    return ranks.threshold_or_top(domain(spark, d, "tickers").select("symbol", "percentage"), "percentage", 99, 10, "symbol").select("symbol", r("percentage").alias("percentage"))


@query(relational.SQL["t04_top_percent"])
def t04_top_percent(spark, d):
    top = ranks.top_percent(domain(spark, d, "samples"), [1, 2, 5, 10], "pct", F.col("score").desc(), "doc_id")
    return top.groupBy("pct").agg(F.count("*").alias("k"), F.sum("label").cast("long").alias("hits"))


@query(relational.SQL["t07_queue_order"])
def t07_queue_order(spark, d):
    """The queue's order over all orders, without one task that sorts them."""
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    rows = table(spark, d, "orders").select("o_orderkey", urgent.alias("urgent"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("open"), "o_orderdate")
    return ranks.numbered(rows, "pos", "urgent", "open", "o_orderdate", "o_orderkey").select("o_orderkey", "pos")


@query(relational.SQL["p16_median_impute"])
def p16_median_impute(spark, d):
    """Missing values get the median of the rows that may be learnt from."""
    rows = sql(spark, d, "SELECT event_id, CASE WHEN $k(props) % 4 <> 0 THEN value END AS v FROM events")
    middle = ranks.quantiles(rows.where("event_id % 3 <> 0"), "v", {"med": 0.5})
    return rows.join(F.broadcast(middle)).select("event_id", r(F.coalesce("v", "med")).alias("v"))  # one row


@query(relational.SQL["g05_quantiles"])
def g05_quantiles(spark, d):
    out = ranks.quantiles(table(spark, d, "events").select("event_type", "value"), "value", {"q25": 0.25, "q50": 0.5, "q90": 0.9}, ("event_type",))
    return out.select("event_type", *(r(c).alias(c) for c in ("q25", "q50", "q90")), "n")


@query(relational.SQL["g09_edges_bins"])
def g09_edges_bins(spark, d):
    rows = domain(spark, d, "samples")
    edges = ranks.quantiles(rows, "score", {"e1": 0.2, "e2": 0.4, "e3": 0.6, "e4": 0.8})
    binned = ranks.edge_bins(rows, "score", edges, ["e1", "e2", "e3", "e4"], "bin")
    return binned.groupBy("bin").agg(F.count("*").alias("n"), r(F.avg("label")).alias("rate"), r(F.avg("score")).alias("mean_score"))


@query(relational.SQL["g18_break_even"])
def g18_break_even(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("value") - 50).alias("ret"))
    means = rows.groupBy("event_type").agg(F.avg(F.when(F.col("ret") > 0, F.col("ret"))).alias("w"), F.avg(F.when(F.col("ret") <= 0, F.col("ret"))).alias("l"))
    for name, some in (("wm", rows.where("ret > 0")), ("lm", rows.where("ret <= 0"))):
        means = means.join(ranks.quantiles(some, "ret", {name: 0.5}, ("event_type",)).select("event_type", name), "event_type", "left")
    even = lambda w, l: -F.col(l) / F.nullif(F.col(w) - F.col(l), F.lit(0.0))
    return means.select("event_type", r(even("w", "l")).alias("p_mean"), r(even("wm", "lm")).alias("p_median"))


@query("WITH x AS (SELECT doc_id, label, row_number() OVER (ORDER BY score, doc_id) AS rn, count(*) OVER () AS n, score FROM samples) SELECT $int(greatest(ceil((rn - 1) * 5 / CAST(greatest(n - 1, 1) AS DOUBLE)) - 1, 0)) AS bin, count(*) AS n, $r(avg(label)) AS rate, $r(avg(score)) AS mean_score FROM x GROUP BY 1")
def g08_equal_count_bins(spark, d):
    binned = ranks.equal_count_bins(domain(spark, d, "samples"), "score", 5, "bin", "doc_id")
    return binned.groupBy("bin").agg(F.count("*").alias("n"), r(F.avg("label")).alias("rate"), r(F.avg("score")).alias("mean_score"))


@query(windowed.SQL["w33_average_rank"])
def w33_average_rank(spark, d):
    return ranks.average_ranks(domain(spark, d, "samples").select("doc_id", "lang", "x2"), "x2", "rk", ("lang",)).select("doc_id", "rk")


@query(windowed.SQL["w34_rank_product"])
def w34_rank_product(spark, d):
    rows = domain(spark, d, "samples").select("doc_id", "score", "x1")
    n = rows.agg(F.count("*").alias("n"))
    both = ranks.average_ranks(ranks.average_ranks(rows, "score", "a"), "x1", "b")
    return both.join(F.broadcast(n)).select("doc_id", r(F.col("a") / F.col("n") * (F.col("b") / F.col("n"))).alias("product"))  # one row


@query(windowed.SQL["c20_combo"])
def c20_combo(spark, d):
    rows = domain(spark, d, "samples").select("doc_id", "score", "x1", "x2")
    n = rows.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("n"))
    for name, column in {"a": "score", "b": "x1", "c": "x2"}.items():
        rows = ranks.numbered(rows, name, column, "doc_id")
    share = lambda c: (F.col(c) - 1) / F.col("n")
    return rows.join(F.broadcast(n)).select("doc_id", r((-share("a") - share("b") + share("c")) / 3).alias("combo3"))  # one row


@query(windowed.SQL["c14_gate_specs"])
def c14_gate_specs(spark, d):
    """Gates over the same rows: a threshold learnt from the training part is one row for all."""
    rows = domain(spark, d, "samples")
    learnt = ranks.quantiles(rows.where("doc_id % 3 <> 0"), "score", {"t60": 0.6}).select("t60")
    f = rows.join(F.broadcast(learnt)).selectExpr("label", "score > 1500 AS a", "x1 > 0.1 AS b", "x2 > 250 AS c", "score > t60 AS d")  # one row
    additive, votes = "CAST(a AS INT) * 3 + CAST(b AS INT) * 2 + CAST(c AS INT) >= 4", "CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) >= 2"
    gates = {"additive": additive, "conjunction": "a AND b AND c", "two_of_three": votes, "additive_veto": f"{additive} AND NOT d"}
    one = f.agg(*(x for name, gate in gates.items() for x in (F.count(F.when(F.expr(gate), 1)).alias(f"n_{name}"), F.avg(F.when(F.expr(gate), F.col("label"))).alias(f"rate_{name}"))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.col(f"n_{g}").alias("n"), r(f"rate_{g}").alias("rate")) for g in gates))).alias("of")).select("of.*")


@query("WITH m AS (SELECT regr_slope(score, x2) AS s1, regr_intercept(score, x2) AS i1, regr_slope(x1, x2) AS s2, regr_intercept(x1, x2) AS i2 FROM samples), e AS (SELECT round(score - s1 * x2 - i1, 6) AS a, round(x1 - s2 * x2 - i2, 9) AS b FROM samples CROSS JOIN m), k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS b FROM e) SELECT count(*) AS n, round(corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)), 4) AS partial_ic FROM k")
def f03_partial_spearman(spark, d):
    rows = domain(spark, d, "samples")
    both = stats.residual(stats.residual(rows, "score", ["x2"], "ra"), "x1", ["x2"], "rb").select(F.round("ra", 6).alias("ra"), F.round("rb", 9).alias("rb"))
    return stats.spearman(both, "ra", "rb", [], 60).select("n", F.round("ic", 4).alias("partial_ic"))


@query(None)
def f05_permutation_band(spark, d):
    """Quantiles and spread of the area under 100 label permutations; the same everywhere, as the order comes from hashes."""
    p = resampling.areas(domain(spark, d, "samples"), "score", "label", 100, "permuted", 42, "doc_id")
    return p.agg(r(F.percentile("auc", F.lit(0.05))).alias("p5"), r(F.percentile("auc", F.lit(0.5))).alias("p50"), r(F.percentile("auc", F.lit(0.95))).alias("p95"), r(F.stddev_samp("auc")).alias("null_sd"))


@query(None)
def f06_bootstrap_auc(spark, d):
    """Bootstrap interval of the area over 500 replicates, Poisson weights from hashes."""
    a = resampling.areas(domain(spark, d, "samples"), "score", "label", 500, "bootstrap", 11, "doc_id")
    return a.agg(r(F.percentile("auc", F.lit(0.025))).alias("lo"), r(F.percentile("auc", F.lit(0.975))).alias("hi"))


@query(None)
def f13_random_key_null(spark, d):
    """How often a random key ranks no worse than the pool in all folds, and the resolution 1.96 sd of its spread: the null for fold counts."""
    tops = resampling.random_tops(domain(spark, d, "samples").withColumn("fold", F.col("doc_id") % 4), "fold", "label", "doc_id", 100)
    wins = tops.groupBy("rep").agg(F.sum(F.when(F.col("top") >= F.col("base") - 1e-9, 1).otherwise(0)).alias("folds"), F.avg(F.col("top") - F.col("base")).alias("spread"))
    sd = wins.agg((1.96 * F.stddev_samp("spread")).alias("resolution"))
    return wins.groupBy("folds").agg(F.count("*").alias("n")).join(F.broadcast(sd)).select("folds", "n", r("resolution").alias("resolution"))  # one row


@query(evaluation.SQL["f07_conditional_terciles"])
def f07_conditional_terciles(spark, d):
    binned = ranks.equal_count_bins(domain(spark, d, "samples"), "x1", 3, "bin", "doc_id")
    return stats.auc(binned, "score", "label", ["bin"], 1).select("bin", "n", r("auc").alias("auc"))


@query(evaluation.SQL["f09_rank_tournament"])
def f09_rank_tournament(spark, d):
    binned = ranks.equal_count_bins(domain(spark, d, "samples"), "x1", 5, "bin", "doc_id")
    pool = ranks.quantiles(binned, "score", {"pool": 0.5}).select("pool")
    of = ranks.quantiles(binned, "score", {"m": 0.5}, ("bin",)).agg(F.max(F.when(F.col("bin") == 4, F.col("m"))).alias("q5"), F.max(F.when(F.col("bin") == 0, F.col("m"))).alias("q1"))
    return of.join(F.broadcast(pool)).select(r(F.col("q5") - F.col("pool")).alias("q5_minus_pool"), r(F.col("q5") - F.col("q1")).alias("q5_minus_q1"))  # one row


@query(evaluation.SQL["f12_train_threshold"])
def f12_train_threshold(spark, d):
    rows = domain(spark, d, "samples").withColumn("fold", F.expr(evaluation._FOLD).cast("long"))
    learnt = ranks.quantiles(rows.where("fold = 0"), "score", {"th": 0.8}).select("th")
    test = rows.where("fold > 0").join(F.broadcast(learnt))  # one row
    chosen = F.col("score") > F.col("th")
    rates = test.groupBy("fold").agg(F.max("th").alias("th"), (F.avg(F.when(chosen, F.col("label"))) - F.avg("label")).alias("delta"))
    for name, some in (("all", test), ("some", test.where(chosen))):
        rates = rates.join(ranks.quantiles(some, "x2", {name: 0.5}, ("fold",)).select("fold", name), "fold", "left")
    return rates.select("fold", r("th").alias("threshold"), r(F.col("some") - F.col("all")).alias("delta_median"), r("delta").alias("delta_rate"))


@query(evaluation.SQL["f15_quantile_spread"])
def f15_quantile_spread(spark, d):
    rows = domain(spark, d, "samples")
    edges = ranks.quantiles(rows, "score", {"lo": 0.2, "hi": 0.8}).select("lo", "hi")
    both = rows.join(F.broadcast(edges))  # one row
    return both.agg(r(F.avg(F.when(F.col("score") >= F.col("hi"), F.col("label"))) - F.avg(F.when(F.col("score") <= F.col("lo"), F.col("label")))).alias("spread"))


@query(evaluation.SQL["f23_segments"])
def f23_segments(spark, d):
    rows = domain(spark, d, "bars").select(F.expr("ts_ms div 3600000").alias("h"), (F.col("high") / F.col("open")).alias("touch"))
    start = rows.agg((F.min("h") + 480).alias("cut"))
    segment = F.when(F.col("h") + 24 < F.col("cut"), "explore").when(F.col("h") >= F.col("cut"), "review").otherwise("cross")
    cut = rows.join(F.broadcast(start)).withColumn("segment", segment)  # one row
    middle = ranks.quantiles(cut, "touch", {"med": 0.5}, ("segment",)).select("segment", "med")
    return cut.groupBy("segment").agg(F.count("*").alias("n")).join(middle, "segment", "left").select("segment", "n", r("med").alias("med_touch"))


@query(evaluation.SQL["f26_reskin_check"])
def f26_reskin_check(spark, d):
    out = stats.spearman(domain(spark, d, "samples"), "score", "x2", [], 1)
    return out.select(r("ic").alias("rho"), (F.abs("ic") >= 0.9).alias("reskin"))


# ---- models on expanding folds
_CUTS = [250, 500, 750]
_WALK = "SELECT c.cut AS split, avg(CASE WHEN s.doc_id < c.cut THEN s.score END) AS m, stddev_pop(CASE WHEN s.doc_id < c.cut THEN s.score END) AS d, covar_pop(CASE WHEN s.doc_id < c.cut THEN s.score END, s.x2) AS cv, avg(CASE WHEN s.doc_id < c.cut THEN s.x2 END) AS y, $int(sum(CASE WHEN s.doc_id < c.cut THEN 1 ELSE 0 END)) AS n, $int(sum(CASE WHEN s.doc_id >= c.cut THEN 1 ELSE 0 END)) AS n_test FROM samples s CROSS JOIN (SELECT 250 AS cut UNION ALL SELECT 500 UNION ALL SELECT 750) c GROUP BY 1"


@query(f"WITH w AS ({_WALK}) SELECT CAST(w.split AS BIGINT) AS split, w.n AS train_n, w.n_test AS test_n, $r(w.n * w.cv / w.d / (w.n + 10)) AS weight, $r(w.y) AS intercept, $r((SELECT sqrt(avg(power(s.x2 - w.y - (s.score - w.m) / w.d * (w.n * w.cv / w.d / (w.n + 10)), 2))) FROM samples s WHERE s.doc_id >= w.split)) AS rmse FROM w")
def f10_walk_forward_ridge(spark, d):
    """a ridge of one feature on each expanding fold and its error on what comes after."""
    rows = domain(spark, d, "samples").select("doc_id", "score", "x2")
    folds = walkforward.ridge(rows, ["score"], "x2", "doc_id", _CUTS)
    test = walkforward.tested(rows, ["score"], "doc_id", folds, "guess")
    errors = test.groupBy("split").agg(F.count("*").alias("test_n"), F.sqrt(F.avg(F.pow(F.col("x2") - F.col("guess"), 2))).alias("rmse"))
    fitted = spark.createDataFrame([(f.split, f.n, float(f.weights[0]), float(f.intercept)) for f in folds if f.weights is not None], "split long, train_n long, weight double, intercept double")
    return fitted.join(errors, "split").select("split", "train_n", "test_n", r("weight").alias("weight"), r("intercept").alias("intercept"), r("rmse").alias("rmse"))


@query(None)
def f17_hierarchical(spark, d):
    """On each expanding fold the chance of the label, the amplitude that positives let expect, their product, and its area."""
    rows = domain(spark, d, "samples").withColumn("amp", fn.signed_log("x2"))
    scored = walkforward.hierarchical(rows, ["score", "x1"], "label", "amp", "doc_id", _CUTS)
    return walkforward.fold_areas(scored, "p_e", "label").select("split", "n", "n1", r("auc").alias("auc"))
