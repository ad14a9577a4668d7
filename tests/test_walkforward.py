"""Expanding folds against plain numpy fits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import walkforward as wf

SPLITS, HORIZON = [300, 60, 170], 12


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        a, b = rng.gauss(3, 2), rng.choice([None] + [rng.gauss(0, 50)] * 9)
        rows.append((i, a, b, 7.0, int(a + (b or 0) / 50 + rng.gauss(0, 1) > 3.5), a * 2 - (b or 0) / 10 + rng.gauss(0, 1)))
    return rows, spark.createDataFrame(rows, "t long, a double, b double, k double, y int, amp double").repartition(5).cache()


def train(rows, split, positives=False):
    mine = [r for r in rows if r[0] + HORIZON < split and r[2] is not None and (not positives or r[4])]
    x = np.array([r[1:4] for r in mine])
    s = np.where(x.std(0) > 1e-9, x.std(0), 1)
    return (x - x.mean(0)) / s, np.array([r[4] for r in mine]), np.array([r[5] for r in mine])


def test_ridge_folds_equal_plain_fits(data):
    rows, df = data
    for fold in wf.ridge(df, ["a", "b", "k"], "amp", "t", SPLITS, HORIZON):
        z, _, y = train(rows, fold.split)
        want = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
        assert fold.n == len(y) and np.allclose(fold.weights, want, atol=1e-8) and abs(fold.intercept - y.mean()) < 1e-9


def test_logistic_folds_are_at_the_minimum(data):
    rows, df = data
    folds = wf.logistic(df, ["a", "b", "k"], "y", "t", SPLITS, HORIZON)
    assert [f.split for f in folds] == sorted(SPLITS)
    for fold in folds:
        z, y, _ = train(rows, fold.split)
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        x, theta = np.column_stack([z, np.ones(len(y))]), np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ theta))
            g, h = 0.5 * x.T @ (w * (p - y)) + np.append(theta[:3], 0), 0.5 * x.T @ (x * (w * p * (1 - p))[:, None]) + np.diag([1, 1, 1, 1e-12])
            theta = theta - np.linalg.solve(h, g)
        assert np.allclose(np.append(fold.weights, fold.intercept), theta, atol=1e-6)


def test_hierarchical_scores_and_areas(data):
    rows, df = data
    out = wf.hierarchical(df, ["a", "b", "k"], "y", "amp", "t", SPLITS, HORIZON)
    got = {(r["split"], r["t"]): r for r in out.collect()}
    assert set(got) == {(s, r[0]) for s in SPLITS for r in rows if r[0] >= s and r[2] is not None}
    ridge = {f.split: f for f in wf.ridge(df.where("y = 1"), ["a", "b", "k"], "amp", "t", SPLITS, HORIZON)}
    for (s, t), r in got.items():
        e = ridge[s].intercept + sum((x - m) / d * w for x, m, d, w in zip(rows[t][1:4], ridge[s].mean, ridge[s].scale, ridge[s].weights))
        assert 0 <= r["p"] <= 1 and abs(r["e"] - e) < 1e-9 and abs(r["p_e"] - r["p"] * r["e"]) < 1e-12
    for a in wf.fold_areas(out, "p", "y").collect():
        mine = [(r["p"], rows[t][4]) for (s, t), r in got.items() if s == a["split"]]
        pos, neg = ([p for p, y in mine if y == k] for k in (1, 0))
        assert abs(a["auc"] - np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])) < 1e-12 and a["auc"] > 0.7


def test_folds_without_rows(data):
    _, df = data
    for some in (df.limit(0), df.where("y = 1")):
        assert all(f.weights is None for f in wf.logistic(some, ["a"], "y", "t", SPLITS))
        assert not wf.hierarchical(some, ["a"], "y", "amp", "t", SPLITS).collect()
    assert [f.weights is None for f in wf.ridge(df.where("t > 100"), ["a"], "amp", "t", SPLITS)] == [True, False, False]
