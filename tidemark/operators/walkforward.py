"""Models trained on expanding folds: what is known before each split, tested on what comes after.

A row trains for every split that its whole window lies before (at + horizon < split); rows
whose window crosses a split train only for later ones.  Ridge folds come from one pass:
moments by the first split that a row trains for, added up from split to split.  Logistic
folds take Newton steps together, one pass a step; a task gives a gradient and a Hessian
for each fold.  What is collected is a few numbers for each split, feature pair and task.

Features are standardised by each fold's own training rows (population deviation; a
constant feature counts as 0).  ``ridge`` has the penalty alpha * |w|**2, ``logistic``
|w|**2 / 2 + c * loss with classes weighted to equal sums; intercepts are free.

Defined results: rows with a null feature, time or target take no part; a fold without
training rows (or, for logistic, of one class) has null coefficients and gives no scores;
splits count in rising order; an empty table gives null folds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import stats


@dataclass
class Fold:
    split: int
    n: int
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None  # of standardised features
    intercept: float


def _rows(df: DataFrame, features: list[str], at: str, *more: str) -> DataFrame:
    out = df
    for c in (*features, at, *more):
        out = out.where(F.col(c).isNotNull())
    return out


def _first_split(at: str, splits: list[int], horizon: int) -> Column:
    """Place of the first split that a row trains for; len(splits) if none."""
    return sum((F.when(F.col(at) + horizon >= s, 1).otherwise(0) for s in splits), F.lit(0))


def _moments(df: DataFrame, features: list[str], target: str, at: str, splits: list[int], horizon: int) -> list[tuple[int, np.ndarray, np.ndarray, float, np.ndarray]]:
    """For each split n, sums, products, the target's sum and its products with features, over its training rows."""
    k = len(features)
    x = [F.col(c).cast("double") for c in features]
    y = F.col(target).cast("double")
    sums = [F.count("*"), *(F.sum(v) for v in x), *(F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k)), F.sum(y), *(F.sum(v * y) for v in x)]
    found = {r[0]: np.array(r[1:], float) for r in _rows(df, features, at, target).groupBy(_first_split(at, splits, horizon)).agg(*sums).collect()}
    out, total = [], np.zeros(len(sums))
    for i in range(len(splits)):
        total = total + found.get(i, 0.0)
        square = np.zeros((k, k))
        square[np.triu_indices(k)] = total[1 + k : 1 + k + k * (k + 1) // 2]
        square = square + np.triu(square, 1).T
        out.append((int(total[0]), total[1 : 1 + k], square, total[-k - 1], total[-k:]))
    return out


def _scaled(n: int, sums: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations (1 for a constant feature) and covariances."""
    mean = sums / max(n, 1)
    covariance = square / max(n, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(covariance), 0))
    return mean, np.where(spread > 1e-12 * np.maximum(1, np.abs(mean)), spread, 1.0), covariance


def ridge(df: DataFrame, features: list[str], target: str, at: str, splits: list[int], horizon: int = 0, alpha: float = 10.0) -> list[Fold]:
    folds = []
    for split, (n, sums, square, total, with_y) in zip(sorted(splits), _moments(df, features, target, at, sorted(splits), horizon)):
        mean, scale, covariance = _scaled(n, sums, square)
        if not n:
            folds.append(Fold(split, n, mean, scale, None, 0.0))
            continue
        gram = n * covariance / np.outer(scale, scale)
        right = (with_y - mean * total) / scale
        folds.append(Fold(split, n, mean, scale, np.linalg.solve(gram + alpha * np.eye(len(features)), right), total / n))
    return folds


def logistic(df: DataFrame, features: list[str], label: str, at: str, splits: list[int], horizon: int = 0, c: float = 0.5, steps: int = 50, least: float = 1e-10) -> list[Fold]:
    """Newton steps for all folds at once, until none moves; a fold's first weights are those before any step."""
    splits = sorted(splits)
    y = "_y"
    rows = _rows(df, features, at, label).withColumn(y, F.when(F.col(label) == 1, 1.0).otherwise(0.0))
    folds = []
    for split, (n, sums, square, ones, _) in zip(splits, _moments(rows, features, y, at, splits, horizon)):
        mean, scale, _ = _scaled(n, sums, square)
        folds.append((Fold(split, n, mean, scale, np.zeros(len(features)) if 0 < ones < n else None, 0.0), n / (2 * max(ones, 1)), n / (2 * max(n - ones, 1))))
    data = rows.select(*(F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)), y, _first_split(at, splits, horizon).alias("_first"))
    k = len(features)

    def passed(now: list[tuple[Fold, float, float]]):
        def run(batches):
            sums = [np.zeros(k + 1 + (k + 1) ** 2) for _ in now]
            for batch in batches:
                x = np.stack([batch.column(i).to_numpy() for i in range(k)], 1)
                label_, first = batch.column(k).to_numpy(), batch.column(k + 1).to_numpy()
                for i, (fold, one, zero) in enumerate(now):
                    mine = first <= i
                    if fold.weights is None or not mine.any():
                        continue
                    z = np.column_stack([(x[mine] - fold.mean) / fold.scale, np.ones(mine.sum())])
                    p = 1 / (1 + np.exp(-np.clip(z @ np.append(fold.weights, fold.intercept), -500, 500)))
                    w = np.where(label_[mine] == 1, one, zero)
                    sums[i] += np.concatenate([z.T @ (w * (p - label_[mine])), (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(now))), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], ["fold", "sums"])

        total = [np.zeros(k + 1 + (k + 1) ** 2) for _ in now]
        for r in data.mapInArrow(run, "fold long, sums array<double>").collect():
            total[r["fold"]] += np.array(r["sums"])
        return total

    for _ in range(steps):
        moved = 0.0
        for (fold, _, _), s in zip(folds, passed(folds)):
            if fold.weights is None:
                continue
            penalty = np.append(np.ones(k), 0.0)
            theta = np.append(fold.weights, fold.intercept)
            step = np.linalg.solve(c * s[k + 1 :].reshape(k + 1, k + 1) + np.diag(penalty) + 1e-12 * np.eye(k + 1), c * s[: k + 1] + penalty * theta)
            fold.weights, fold.intercept = (theta - step)[:k], float((theta - step)[k])
            moved = max(moved, float(np.abs(step).max()))
        if moved < least:
            break
    return [f for f, _, _ in folds]


def linear(fold: Fold, features: list[str]) -> Column:
    """A fold's linear score of a row."""
    out: Column = F.lit(float(fold.intercept))
    for name, m, s, w in zip(features, fold.mean, fold.scale, fold.weights):
        out = out + (F.col(name) - float(m)) / float(s) * float(w)
    return out


def tested(df: DataFrame, features: list[str], at: str, folds: list[Fold], name: str, probability: bool = False) -> DataFrame:
    """df's rows at or after each fold's split, with ``split`` and the fold's score ``name``; a row for each split that it comes after."""
    given = [f for f in folds if f.weights is not None]
    score = lambda f: 1 / (1 + F.exp(-linear(f, features))) if probability else linear(f, features)
    each = F.array(*(F.when(F.col(at) >= f.split, F.struct(F.lit(f.split).cast("long").alias("split"), score(f).alias(name))) for f in given)) if given else F.array().cast(f"array<struct<split:bigint,{name}:double>>")
    return _rows(df, features, at).withColumn("_f", F.explode(each)).where(F.col("_f").isNotNull()).select(*df.columns, F.col("_f.split").alias("split"), F.col(f"_f.{name}").alias(name))


def hierarchical(df: DataFrame, features: list[str], label: str, amplitude: str, at: str, splits: list[int], horizon: int = 0, c: float = 0.5, alpha: float = 10.0) -> DataFrame:
    """The rows after each split with p (the chance of the label), e (the amplitude that a ridge over positives expects) and p_e, their product."""
    chance = logistic(df, features, label, at, splits, horizon, c)
    size = {f.split: f for f in ridge(df.where(F.col(label) == 1), features, amplitude, at, splits, horizon, alpha)}
    out = tested(df, features, at, chance, "p", True)
    e = F.lit(None).cast("double")
    for split, fold in size.items():
        if fold.weights is not None:
            e = F.when(F.col("split") == split, linear(fold, features)).otherwise(e)
    return out.withColumn("e", e).withColumn("p_e", F.col("p") * F.col("e"))


def fold_areas(scored: DataFrame, score: str, label: str, least: int = 2) -> DataFrame:
    """split, n, n1 and auc of each fold's test rows."""
    return stats.auc(scored, score, label, ["split"], least)
