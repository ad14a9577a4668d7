"""Positions, ranks, quantiles and resampling over ranges, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks, resampling, stats


def hot(n, seed):
    """(i, g, x, y): one value in 60 % of rows, some nulls."""
    rng = random.Random(seed)
    x = lambda: 5.0 if rng.random() < 0.6 else rng.choice([None, float(rng.randrange(9)), rng.random() * 10])
    return [(i, rng.choice(["a", "a", "b", None]), x(), rng.randrange(2)) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    found = hot(700, 1)
    return found, spark.createDataFrame(found, "i long, g string, x double, y int").repartition(5).cache()


def average(values):
    order = sorted(values)
    return {v: order.index(v) + (order.count(v) + 1) / 2 for v in set(values)}


def plan_has_no_single_task(df):
    return "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def test_positions_of_all_rows(spark, data):
    found, df = data
    got = ranks.numbered(df, "p", F.col("x").desc_nulls_last(), "i")
    want = sorted(found, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert [r["i"] for r in sorted(got.collect(), key=lambda r: r["p"])] == [r[0] for r in want]
    assert got.columns == ["i", "g", "x", "y", "p"] and plan_has_no_single_task(got)
    by_key = {r["i"]: r["p"] for r in ranks.numbered(df, "p", "x", "i", keys=("g",)).collect()}
    for g in ("a", "b", None):
        mine = sorted((r for r in found if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [by_key[r[0]] for r in mine] == list(range(1, len(mine) + 1))
    assert not ranks.numbered(df.limit(0), "p", "x").collect()


def test_ranks_with_ties(data):
    found, df = data
    for keys in ((), ("g",)):
        out = ranks.average_ranks(df, "x", "r", keys)
        assert plan_has_no_single_task(out)
        got = {r["i"]: r["r"] for r in out.collect()}
        for g in {r[1] if keys else 0 for r in found}:
            mine = [r for r in found if not keys or r[1] == g]
            want = average([r[2] for r in mine if r[2] is not None])
            assert all(got[r[0]] == want.get(r[2]) for r in mine)


def test_quantiles_equal_numpy(spark, data):
    found, df = data
    shares = {"lo": 0.0, "p1": 0.1, "mid": 0.5, "p9": 0.93, "hi": 1.0}
    for keys in ((), ("g",)):
        for r in ranks.quantiles(df, "x", shares, keys).collect():
            mine = [x[2] for x in found if x[2] is not None and (not keys or x[1] == r["g"])]
            assert r["n"] == len(mine) and np.allclose([r[k] for k in shares], np.quantile(mine, list(shares.values())), rtol=1e-12)
    one = spark.createDataFrame([(3.0,), (None,)], "x double")
    assert ranks.quantiles(one, "x", shares).collect()[0].asDict() == {"n": 1} | dict.fromkeys(shares, 3.0)
    assert set(ranks.quantiles(one.limit(0), "x", shares).collect()[0]) == {None}
    assert not ranks.quantiles(one.limit(0), "x", shares, ("x",)).collect()


def test_bins_edges_and_tops(spark, data):
    found, df = data
    some = df.where("x IS NOT NULL")
    order = sorted((r for r in found if r[2] is not None), key=lambda r: (r[2], r[0]))
    n = len(order)
    got = {r["i"]: r["b"] for r in ranks.equal_count_bins(some, "x", 7, "b", "i").collect()}
    assert [got[r[0]] for r in order] == [max(math.ceil(k * 7 / (n - 1)) - 1, 0) for k in range(n)]
    edges = spark.createDataFrame([(2.0, 5.0)], "e1 double, e2 double")
    got = {r["i"]: r["b"] for r in ranks.edge_bins(df, "x", edges, ["e1", "e2"], "b").collect()}
    assert all(got[r[0]] == (None if r[2] is None else (r[2] > 2) + (r[2] > 5)) for r in found)
    assert {r["i"] for r in ranks.threshold_or_top(df, "x", 9.5, 3, "i").collect()} == {r[0] for r in found if (r[2] or 0) >= 9.5}
    top = sorted((-r[2], r[0]) for r in found if r[2] is not None)[:3]
    assert sorted((-r["x"], r["i"]) for r in ranks.threshold_or_top(df, "x", 99, 3, "i").collect()) == top
    got = ranks.top_percent(df, [0, 1, 10], "pct", F.col("x").desc_nulls_last(), "i").groupBy("pct").count().collect()
    assert {r["pct"]: r["count"] for r in got} == {0: 1, 1: 7, 10: 70}


def test_areas_and_correlations_without_rows_in_one_task(data):
    found, df = data
    for keys in ([], ["g"]):
        auc, rho = stats.auc(df, "x", "y", keys), stats.spearman(df.withColumn("z", F.col("x") * 3 + F.col("y") * 4), "x", "z", keys)
        for a in auc.collect():
            mine = [r for r in found if r[2] is not None and (not keys or r[1] == a["g"])]
            pos, neg = ([r[2] for r in mine if r[3] == k] for k in (1, 0))
            assert abs(a["auc"] - sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))) < 1e-12
        for a in rho.collect():
            mine = [(r[2], r[2] * 3 + r[3] * 4) for r in found if r[2] is not None and (not keys or r[1] == a["g"])]
            u, v = (average([m[k] for m in mine]) for k in (0, 1))
            assert abs(a["ic"] - np.corrcoef([u[m[0]] for m in mine], [v[m[1]] for m in mine])[0, 1]) < 1e-9


# ---- resampling
@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_reorderings_are_permutations(n):
    for key in (0, 1, 77):
        assert sorted(resampling.reordered(np.arange(n), n, key)) == list(range(n))
    if n == 1000:
        both = [resampling.reordered(np.arange(n), n, k) for k in (1, 2)]
        assert (both[0] != both[1]).mean() > 0.9 and abs(np.corrcoef(both[0], np.arange(n))[0, 1]) < 0.15


def brute_area(x, one, zero):
    order = np.argsort(x, kind="stable")
    x, one, zero = np.asarray(x)[order], one[order], zero[order]
    return sum(one[i] * (zero[x < x[i]].sum() + zero[x == x[i]].sum() / 2) for i in range(len(x))) / (one.sum() * zero.sum())


def test_replicates_equal_brute_force(spark, data, monkeypatch):
    monkeypatch.setattr(resampling, "ROWS_AT_ONCE", 37)
    found, df = data
    some = [r for r in found if r[2] is not None]
    x, y, ids = ([r[k] for r in some] for k in (2, 3, 0))
    got = resampling.areas(df, "x", "y", 6, "bootstrap", 11, "i").orderBy("rep").collect()
    for r in got:
        w = resampling.poisson(np.array(ids), 11 * 1_000_003 + r["rep"]).astype(float)
        assert abs(r["auc"] - brute_area(x, w * np.array(y), w * (1 - np.array(y)))) < 1e-9
    got = [r["auc"] for r in resampling.areas(df, "x", "y", 40, "permuted", 5, "i").orderBy("rep").collect()]
    order = sorted(zip(x, spark.createDataFrame([(i,) for i in ids], "i long").select(F.xxhash64("i")).toPandas().iloc[:, 0], ids))
    for rep in (0, 39):
        one = (resampling.reordered(np.arange(len(order)), len(order), 5 * 1_000_003 + rep) < sum(y)).astype(float)
        assert abs(got[rep] - brute_area([o[0] for o in order], one, 1 - one)) < 1e-9
    assert 0.47 < np.mean(got) < 0.53 and len(set(got)) > 30
    assert [r["auc"] for r in resampling.areas(df.limit(0), "x", "y", 2).collect()] == [None, None]
    assert [r["auc"] for r in resampling.areas(df.where("y = 1"), "x", "y", 2).collect()] == [None, None]


def test_poisson_counts_have_mean_and_variance_one():
    w = resampling.poisson(np.arange(200_000), 3)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02


def test_random_tops_take_a_share_of_each_fold(data):
    found, df = data
    out = resampling.random_tops(df.withColumn("fold", F.col("i") % 3), "fold", "y", "i", 20).collect()
    assert len(out) == 60
    for r in out:
        mine = sorted(x for x in found if x[0] % 3 == r["fold"])
        n = len(mine)
        to = resampling.reordered(np.arange(n), n, (7 * 1_000_003 + r["rep"]) * 1_009 + r["fold"])
        assert abs(r["top"] - np.mean([m[3] for m, t in zip(mine, to) if t < n // 5])) < 1e-12 and abs(r["base"] - np.mean([m[3] for m in mine])) < 1e-12
