"""Exact positions, ranks and quantiles of whole tables, without a task that sees all rows.

A table is dealt into ranges of the order by Spark's sampler, sorted there and cut; what
is collected is a count (and sums) for each range, and a row's position is its place in its
range after all ranges before.  Ranks with ties and quantiles need no rows at all: values
are counted first, so that a value of any share of the rows is one row of what is sorted.

Defined results: nulls take no rank and no part in quantiles; NaN stands above all numbers;
equal values share their average rank; rows that are equal in the whole order of
``numbered`` get different positions in any order; without values quantiles
are null in the one row there is without keys, one value is every quantile; null keys are a
key; an empty table gives no rows else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import cut

_PLACE = (1 << 33) - 1


def in_order(df: DataFrame, *order: str | Column) -> DataFrame:
    """df in ranges of the order, sorted and cut; ``_at`` rises along the order, its upper bits number the range."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))


def _task() -> Column:
    return F.shiftright("_at", 33)


def _bases(ranged: DataFrame, **sums: Column) -> DataFrame:
    """_task and, for each name, the sum over all ranges before: a row for each range."""
    found = sorted(ranged.groupBy(_task().alias("_task")).agg(*(F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items())).collect())
    rows, total = [], [0] * len(sums)
    for task, *more in found:
        rows.append((task, *total))
        total = [a + b for a, b in zip(total, more)]
    kinds = ", ".join(f"{n} {'double' if any(isinstance(x, float) for x in total) else 'long'}" for n in sums)
    return ranged.sparkSession.createDataFrame(rows, f"_task long, {kinds}")


def with_places(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with ``name``, each row's position from 1 in the order, and ``_task``, the number of its range; a task has one range, in order."""
    ranged = in_order(df, *order)
    bases = _bases(ranged, _base=F.count("*"))
    # A row for each range of the order: its number of partitions is the bound.
    return ranged.withColumn("_task", _task()).join(F.broadcast(bases), "_task").withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit(_PLACE)) + 1)


def numbered(df: DataFrame, name: str, *order: str | Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with ``name``, each row's position from 1 in the order, within its keys."""
    out = with_places(df, name, *keys, *order)
    if keys:
        out = _by_key(out, name, keys, 1)
    return out.select(*df.columns, name)


def _by_key(df: DataFrame, name: str, keys: tuple[str, ...], least: int) -> DataFrame:
    """``name`` counted from ``least`` in each key rather than over all."""
    start = df.groupBy(*keys).agg(F.min(name).alias("_start")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_start")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(start, same).withColumn(name, F.col(name) - F.col("_start") + least).select(*df.columns)


def placed(values: DataFrame, column: str, n: str = "n", keys: tuple[str, ...] = ()) -> DataFrame:
    """values (a row for each different value of a key, with its count n) with ``before``: how many rows of the key have smaller values."""
    ranged = in_order(values, *keys, column)
    bases = _bases(ranged, _base=F.sum(n))
    local = Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_task", _task()).withColumn("before", F.coalesce(F.sum(n).over(local), F.lit(0)))
    # A row for each range of the order: its number of partitions is the bound.
    out = out.join(F.broadcast(bases), "_task").withColumn("before", F.col("before") + F.col("_base"))
    if keys:
        out = _by_key(out, "before", keys, 0)
    return out.select(*values.columns, "before")


def counted(df: DataFrame, column: str, keys: tuple[str, ...] = (), **sums: Column) -> DataFrame:
    """keys, column, n and sums for each different value, and ``before``."""
    return placed(df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"), *(c.alias(name) for name, c in sums.items())), column, "n", keys)


def average_ranks(df: DataFrame, column: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with ``name``, the rank from 1 with ties averaged; null for null."""
    ranks = counted(df, column, keys).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(column).alias("_v"), (F.col("before") + (F.col("n") + 1) / 2.0).alias(name))
    same = [F.col(column) == F.col("_v"), *(F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys))]
    return df.join(ranks, same, "left").select(*df.columns, name)


def quantiles(df: DataFrame, column: str, shares: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n and a column for each name and share: exact quantiles, interpolated between neighbours."""
    values = counted(df.withColumn("_v", F.col(column).cast("double")), "_v", keys)
    total = values.groupBy(*keys).agg(F.sum("n").alias("_n")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_n")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    rows = values.join(total, same) if keys else values.join(F.broadcast(total))  # one row

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("_v")))

    out = rows.groupBy(*keys).agg(F.first("_n").alias("n"), *(at(f((F.col("_n") - 1) * F.lit(float(p)))).alias(f"_{i}_{name}") for name, p in shares.items() for i, f in enumerate((F.floor, F.ceil))))
    part = lambda p: (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
    return out.select(*keys, "n", *((F.col(f"_0_{name}") * (1 - part(p)) + F.col(f"_1_{name}") * part(p)).alias(name) for name, p in shares.items()))


def equal_count_bins(df: DataFrame, column: str, q: int, name: str, tie: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with ``name``, a bin from 0 to q - 1 by position, as quantile edges on first-come ranks give it."""
    placed = numbered(df, "_rn", column, tie, keys=keys)
    total = placed.groupBy(*keys).agg(F.count("*").alias("_n")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_n")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    both = placed.join(total, same) if keys else placed.join(F.broadcast(total))  # one row
    return both.withColumn(name, F.greatest(F.ceil((F.col("_rn") - 1) * q / F.greatest(F.col("_n") - 1, F.lit(1))) - 1, F.lit(0)).cast("long")).select(*df.columns, name)


def edge_bins(df: DataFrame, column: str, edges: DataFrame, names: list[str], name: str) -> DataFrame:
    """df with ``name``: how many of the edges (a table of one row) are under the value; none if the value is null."""
    under = sum((F.when(F.col(column) > F.col(e), 1).otherwise(0) for e in names), F.lit(0))
    return df.join(F.broadcast(edges.select(*names))).withColumn(name, F.when(F.col(column).isNotNull(), under)).select(*df.columns, name)  # one row


def threshold_or_top(df: DataFrame, column: str, least: float, k: int, tie: str) -> DataFrame:
    """Rows that reach ``least``, or the k highest where none does."""
    reached = df.where(F.col(column) >= least)
    some = reached.agg((F.count("*") > 0).alias("_some"))
    top = df.orderBy(F.col(column).desc_nulls_last(), tie).limit(k)
    return reached.union(top.join(F.broadcast(some)).where(~F.col("_some")).select(*df.columns))  # one row


def top_percent(df: DataFrame, percents: list[int], name: str, *order: str | Column) -> DataFrame:
    """df's first rows in the order, once for each percentage ``name`` that they fall into; at least one row for each."""
    placed = numbered(df, "_rn", *order)
    total = placed.agg(F.count("*").alias("_n"))
    reach = lambda p: F.greatest(F.lit(1), F.expr(f"(_n * {int(p)}) div 100"))
    rows = placed.join(F.broadcast(total)).where(F.col("_rn") <= reach(max(percents)))  # one row
    each = rows.withColumn(name, F.explode(F.array(*(F.when(F.col("_rn") <= reach(p), F.lit(p)) for p in percents)))).where(F.col(name).isNotNull())
    return each.select(*df.columns, name)
