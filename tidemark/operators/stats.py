"""Evaluation statistics as aggregates: ranks with averaged ties, areas, correlations, folds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.operators import ranks


def auc(df: DataFrame, score: str, label: str, keys: list[str], least: int = 30, least_each: int = 1) -> DataFrame:
    """Area under the curve by ranks, null with too few rows of a kind; from counts of each score, so rows are neither ranked nor gathered."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    values = ranks.counted(rows, score, tuple(keys), _ones=F.sum(F.when(F.col(label) == 1, 1).otherwise(0)))
    n1, n = F.sum("_ones"), F.sum("n")
    out = values.groupBy(*keys).agg(n.alias("n"), n1.alias("n1"), F.sum(F.col("_ones") * (F.col("before") + (F.col("n") + 1) / 2)).alias("_s"))
    n0 = F.col("n") - F.col("n1")
    ok = (F.col("n") >= least) & (F.col("n1") >= least_each) & (n0 >= least_each)
    return out.withColumn("auc", F.when(ok, (F.col("_s") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * n0))).drop("_s")


def spearman(df: DataFrame, x: str, y: str, keys: list[str], least: int = 30) -> DataFrame:
    """Rank correlation, null under ``least`` pairs or where a side is constant; from counts of pairs of values."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_m"))
    ranked = pairs
    for side in ("_x", "_y"):
        values = pairs.groupBy(*keys, side).agg(F.sum("_m").alias("_m"))
        placed = ranks.placed(values, side, "_m", tuple(keys)).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(side).alias("_v"), (F.col("before") + (F.col("_m") + 1) / 2).alias(f"_r{side}"))
        same = [F.col(side) == F.col("_v"), *(F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys))]
        ranked = ranked.join(placed, same).select(*ranked.columns, f"_r{side}")
    # Of average ranks the mean is known, (n + 1) / 2: sums of what differs from it lose no digits.
    total = pairs.groupBy(*keys).agg(F.sum("_m").alias("_n")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_n")
    whole = ranked.join(total, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]) if keys else ranked.join(F.broadcast(total))  # one row
    dx, dy = F.col("_r_x") - (F.col("_n") + 1) / 2, F.col("_r_y") - (F.col("_n") + 1) / 2
    out = whole.groupBy(*keys).agg(F.sum("_m").alias("n"), F.sum(F.col("_m") * dx * dy).alias("_c"), F.sum(F.col("_m") * dx * dx).alias("_vx"), F.sum(F.col("_m") * dy * dy).alias("_vy"))
    ok = (F.col("n") >= least) & (F.col("_vx") > 0) & (F.col("_vy") > 0)
    return out.withColumn("ic", F.when(ok, F.col("_c") / F.sqrt(F.col("_vx") * F.col("_vy")))).drop("_c", "_vx", "_vy")


def rolling_spearman(df: DataFrame, x: str, y: str, keys: list[str], time: str, rows: int, name: str) -> DataFrame:
    """keys, time and the rank correlation over the last ``rows`` rows, at every row that has so many; null under three pairs or where a side is constant."""
    w = Window.partitionBy(*keys).orderBy(time)
    pairs = df.select(*keys, time, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.row_number().over(w).alias("_i"))
    frame = w.rowsBetween(1 - rows, 0)
    # A missing side leaves the pair out: both become NaN, so that both lists have a place for each row.
    whole = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    side = lambda c: F.collect_list(F.when(whole, F.col(c)).otherwise(F.lit(float("nan")))).over(frame)
    frames = pairs.select(*keys, time, "_i", side("_x").alias("_x"), side("_y").alias("_y")).where(F.col("_i") >= rows).drop("_i")
    head = df.select(*keys, time).schema

    def ranks(v, ok):
        less = ((v[:, None, :] < v[:, :, None]) & ok[:, None, :]).sum(2)
        return less + (((v[:, None, :] == v[:, :, None]) & ok[:, None, :]).sum(2) + 1) / 2

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                a, b = (np.array(part.column(c).to_pylist(), float) for c in ("_x", "_y"))
                ok = ~(np.isnan(a) | np.isnan(b))
                n = np.maximum(ok.sum(1), 1)
                da, db = (np.where(ok, r - (np.where(ok, r, 0).sum(1) / n)[:, None], 0) for r in (ranks(a, ok), ranks(b, ok)))
                va, vb = (da * da).sum(1), (db * db).sum(1)
                on = (n >= 3) & (va > 0) & (vb > 0)
                rho = np.where(on, (da * db).sum(1) / np.sqrt(np.where(on, va * vb, 1)), 0)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(head)], pa.array(rho, mask=~on)], [*head.names, name])

    return frames.mapInArrow(run, StructType([*head.fields, StructField(name, DoubleType())]))


def residual(df: DataFrame, y: str, controls: list[str], name: str) -> DataFrame:
    """df with y's residual on one or two controls, from normal equations over one aggregate row."""
    means = df.select(*(F.avg(c).alias(f"_m_{c}") for c in (y, *controls)), *(F.covar_pop(a, b).alias(f"_c_{a}_{b}") for i, a in enumerate((y, *controls)) for b in (y, *controls)[i:]))
    row = df.join(F.broadcast(means))  # one row
    c = lambda a, b: F.col(f"_c_{a}_{b}")
    if len(controls) == 1:
        u = controls[0]
        b = [F.when(c(u, u) > 0, c(y, u) / c(u, u)).otherwise(0.0)]
    else:
        u, v = controls
        det = c(u, u) * c(v, v) - c(u, v) * c(u, v)
        b = [F.when(det > 0, (c(y, u) * c(v, v) - c(y, v) * c(u, v)) / det).otherwise(0.0), F.when(det > 0, (c(y, v) * c(u, u) - c(y, u) * c(u, v)) / det).otherwise(0.0)]
    fit: Column = F.col(f"_m_{y}")
    for k, x in zip(b, controls):
        fit = fit + k * (F.col(x) - F.col(f"_m_{x}"))
    return row.withColumn(name, F.col(y) - fit).select(*df.columns, name)


def precision_at(ranked: DataFrame, label: str, sizes: list[int], hour: str = "hour_idx") -> DataFrame:
    """P@N: hits among the first N of every hour, over the sum of min(N, scoreable)."""
    each = ranked.where("rk IS NOT NULL").withColumn("top_n", F.explode(F.array(*map(F.lit, sizes))))
    inside = F.col("rk") <= F.col("top_n")
    out = each.groupBy("top_n").agg(F.sum(F.when(inside, 1).otherwise(0)).alias("shown"), F.sum(F.when(inside & (F.col(label) == 1), 1).otherwise(0)).alias("hits"), F.avg(F.col(label).cast("double")).alias("base"))
    p = F.col("hits") / F.greatest(F.col("shown"), F.lit(1))
    return out.select("top_n", "shown", "hits", p.alias("p_at_n"), (p / F.when(F.col("base") != 0, F.col("base"))).alias("lift"))
