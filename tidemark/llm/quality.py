"""Quality rules: fixed limits, then robust multivariate outliers by minimum covariance determinant.

Each text's counts become a vector of transformed statistics.  For each language and
source, concentration steps look for the three quarters of the texts whose covariance has
the least determinant: distances under the last mean and covariance, the bin of distance
that holds the wanted share (exact counts by bin, summed before any shuffle), then mean
and covariance of the texts up to there.  There are three starts: the coordinates' spreads
alone, correlations of squashed coordinates, and of directions from the median.  After
TRIAL steps of each, a group goes on with the start of the least determinant until its
determinant falls no further, by SETTLED in the logarithm; groups that have settled take no
part in later steps.  A determinant has a floor, so that every group settles.  A text whose
Mahalanobis distance under the last estimate passes CUTOFF is rejected.

Every variance has a floor, so that a statistic that is constant in most texts neither
makes the matrix singular nor rejects the first text that differs a little.  Groups of
less than LEAST_ROWS texts, five for each statistic, are judged together by language, and
those of languages that are still as small all together; with less than twice as many
texts as statistics, no text is rejected by the method.

Defined results: a null text counts as empty and fails the base rule; null languages and
sources are groups of their own; repeated rows are counted and judged each; an empty table
gives no rows; columns besides id, text, language and source are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textstats
from tidemark.llm.buffers import blocks, text_buffer
from tidemark.llm.shared import apart, map_arrow, with_columns_from_text, written

LEAST_WORDS, MOST_REPEATED = 10, 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics as SQL over the counts, and the least standard deviation that each is given.
STATISTICS = {
    "ln(n_words + 20)": 0.5,
    "(word_chars + 500) / (n_words + 100)": 0.1,
    "ln(1 + n_symbols / (n_words + 5))": 0.04,
    "10 * n_dup_lines / (n_words + 50)": 0.1,
    "n_repeat_words / (n_words + 20)": 0.06,
}
SHARE, TRIAL, LEAST_ROWS, CUTOFF = 0.75, 2, 25, 36.0
#: Fall of a determinant's logarithm that counts as none.
SETTLED = 0.001
#: Distances are told apart by bins of a sixteenth of a power of two; groups whose estimates may be broadcast (some 400 bytes each).
BINS, BROADCAST_GROUPS = 16, 20_000
#: Groups whose estimates one task solves.
SOLVED_GROUPS = 500


def text_counts(df: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row of (doc_id, text, lang, source)."""

    def make(batch):
        raw, offsets = text_buffer(batch.column(3))
        for a, b, part, at in blocks(raw, offsets):
            yield {c: batch.column(i).slice(a, b - a) for i, c in enumerate(("doc_id", "lang", "source"))} | textstats.counts(part, at)

    return map_arrow(df.select(F.col("doc_id").cast("long"), "lang", "source", "text"), make, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _chi2_below(x: float, k: int) -> float:
    """Share of a chi-square law of k degrees below x, by Simpson's rule."""
    n = 2_000
    h = math.sqrt(x) / n
    f = [(i * h) ** (k - 1) * math.exp(-((i * h) ** 2) / 2) for i in range(n + 1)]  # as a law of the root
    return h / 3 * (f[0] + f[-1] + 4 * sum(f[1::2]) + 2 * sum(f[2:-1:2])) / (2 ** (k / 2 - 1) * math.gamma(k / 2))


def consistency(k: int, share: float) -> float:
    """What the covariance of the nearest share of normal vectors is multiplied with to be that of all."""
    low, high = 0.0, 400.0
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_below(mid, k) < share else (low, mid)
    return share / _chi2_below(low, k + 2)


def _attached(rows: DataFrame, small: DataFrame, groups: int) -> DataFrame:
    """Inner join on g: by broadcast if the groups are few enough, else by Catalyst's choice with skewed groups split."""
    return rows.join(F.broadcast(small) if groups <= BROADCAST_GROUPS else small, "g")


def _distance(k: int) -> Column:
    x = [F.col(f"x{i}") - F.col("mean")[i] for i in range(k)]
    terms = [x[i] * x[j] * F.col("inverse")[i * k + j] * (1 if i == j else 2) for i in range(k) for j in range(i, k)]
    return sum(terms[1:], terms[0])


def _moments(x: list[Column], mark: str) -> list[Column]:
    """Sums of the columns, then of their products."""
    k = len(x)
    return [*(F.sum(x[i]).alias(f"{mark}{i}") for i in range(k)), *(F.sum(x[i] * x[j]).alias(f"{mark}{i}_{j}") for i in range(k) for j in range(i, k))]


def _covariances(n: np.ndarray, moments: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances from rows of sums and of sums of products."""
    mean = moments[:, :k] / n[:, None]
    cov = np.zeros((len(n), k, k))
    i, j = np.triu_indices(k)
    cov[:, i, j] = cov[:, j, i] = moments[:, k:] / n[:, None] - mean[:, i] * mean[:, j]
    return mean, cov


def _solver(df: DataFrame, make, schema: str) -> DataFrame:
    """mapInArrow over rows of a group name and numbers: make gets names and a matrix."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.list_(pa.float64()) if "array" in part else pa.string() if "string" in part else pa.int64() if "long" in part else pa.float64() for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for columns in make(batch.column(0).to_pylist(), np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]], 1)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return df.mapInArrow(run, schema)


_ESTIMATE = "g string, start long, mean array<double>, inverse array<double>, determinant double, fall double"


def _starts(moments: DataFrame, k: int) -> DataFrame:
    """Estimates of every start: the median, and three shapes of covariance, from n, medians, spreads and moments of z squashed and of z's direction."""

    def make(g, m):
        n, middle, spread = m[:, 0], m[:, 1 : k + 1], m[:, k + 1 : 2 * k + 1]
        width = k + k * (k + 1) // 2
        shapes = [np.tile(np.eye(k), (len(g), 1, 1))]
        for part in (m[:, 2 * k + 1 : 2 * k + 1 + width], m[:, 2 * k + 1 + width :]):
            cov = _covariances(n, part, k)[1] + 1e-3 * np.eye(k)
            size = np.sqrt(cov[:, range(k), range(k)])
            shapes.append(cov / size[:, :, None] / size[:, None, :])
        for start, shape in enumerate(shapes):
            cov = shape * spread[:, :, None] * spread[:, None, :]
            yield g, [start] * len(g), middle.tolist(), np.linalg.inv(cov).reshape(len(g), -1).tolist(), [np.inf] * len(g), [np.inf] * len(g)

    return _solver(moments, make, _ESTIMATE)


def _solved(moments: DataFrame, floors: list[float], share: float) -> DataFrame:
    """Estimates from the start, the last determinant, n and the moments of x of the nearest texts; a determinant is a logarithm, its fall the distance from the last."""
    k = len(floors)
    factor = consistency(k, share)

    def make(g, m):
        mean, cov = _covariances(m[:, 2], m[:, 3:], k)
        cov = factor * cov + np.diag(np.square(floors))
        size = np.linalg.slogdet(cov)[1]
        yield g, m[:, 0].astype(int).tolist(), mean.tolist(), np.linalg.inv(cov).reshape(len(g), -1).tolist(), size.tolist(), (m[:, 1] - size).tolist()

    return _solver(moments, make, _ESTIMATE)


def robust_estimates(rows: DataFrame, floors: list[float], share: float = SHARE) -> DataFrame:
    """g, mean, inverse, determinant and n of every group of rows (a table of g and x0, x1, ...)."""
    k = len(floors)
    names = [f"x{i}" for i in range(k)]
    middle = [F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias(x) for x in names]
    start = rows.groupBy("g").agg(F.count("*").alias("n"), *middle)
    spread = [F.greatest((F.col(x)[2] - F.col(x)[0]) / 1.349, F.lit(f)) for x, f in zip(names, floors)]
    first = written(start.select("g", "n", *(F.col(x)[1].alias(f"m{i}") for i, x in enumerate(names)), *(c.alias(f"s{i}") for i, c in enumerate(spread))), "start")
    groups = first.count()
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(names)]
    far = F.sqrt(sum((c * c for c in z[1:]), z[0] * z[0]))
    ways = _attached(rows, first.drop("n"), groups).select("g", *(F.tanh(c).alias(f"t{i}") for i, c in enumerate(z)), *(F.when(far > 0, c / far).otherwise(0.0).alias(f"d{i}") for i, c in enumerate(z)))
    ways = ways.groupBy("g").agg(*_moments([F.col(f"t{i}") for i in range(k)], "t"), *_moments([F.col(f"d{i}") for i in range(k)], "d"))
    order = [c for c in first.columns if c != "g"] + [c for c in ways.columns if c != "g"]
    estimate = written(_starts(_attached(ways, first, groups).select("g", *order), k), "estimates")
    by_start = Window.partitionBy("g", "start")
    going, step = F.col("fall") >= SETTLED, 0
    while step < TRIAL or estimate.where(going).limit(1).count():
        moving = estimate.where(going).drop("fall")
        scored = _attached(rows, moving, groups * (3 if step < TRIAL else 1)).select("g", "start", "determinant", *names, F.floor(F.log2(F.greatest(_distance(k), F.lit(1e-6))) * BINS).alias("bin"))
        per_bin = scored.groupBy("g", "start", "bin").agg(F.max("determinant").alias("last"), F.count("*").alias("rows"), *_moments([F.col(x) for x in names], "p"))
        below = F.coalesce(F.sum("rows").over(by_start.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        near = per_bin.withColumn("near", below < F.ceil(F.sum("rows").over(by_start) * share)).where("near")
        sums = [c for c in per_bin.columns if c[0] == "p"]
        moments = near.groupBy("g", "start").agg(F.max("last").alias("last"), F.sum("rows").alias("rows"), *(F.sum(c).alias(c) for c in sums))
        # A group has a few hundred bins, however many texts: a task takes many groups, as Python starts for each task.
        new = _solved(moments.coalesce(max(1, groups // SOLVED_GROUPS)), floors, share)
        if step < TRIAL:
            new = new.withColumn("fall", F.lit(math.inf))
        if step == TRIAL - 1:
            new = new.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("determinant", "start"))).where("place = 1").drop("place")
        if step >= TRIAL:  # a step that makes a determinant larger is not taken
            shape = ["start", "mean", "inverse", "determinant"]
            both = _attached(new, moving.select("g", *(F.col(c).alias(f"last_{c}") for c in shape)), groups)
            new = both.select("g", *(F.when(F.col("fall") < 0, F.col(f"last_{c}")).otherwise(F.col(c)).alias(c) for c in shape), "fall").unionByName(estimate.where(~going))
        estimate, step = written(new, "estimates"), step + 1
    return estimate.drop("start", "fall").join(first.select("g", "n"), "g")


@dataclass
class Rule:
    """Fitted estimates: own (language and source) to mean, inverse and n; groups counts its rows."""

    table: DataFrame
    groups: int
    statistics: dict[str, float]
    cutoff: float

    def applied(self, rows: DataFrame) -> DataFrame:
        """rows (the counts, own) with base_failed, d2 and kept, each row once."""
        k = len(self.statistics)
        passed = rows.withColumn("base_failed", base_failed())
        joined = passed.join(F.broadcast(self.table) if self.groups <= BROADCAST_GROUPS else self.table, "own", "left")
        for i, s in enumerate(self.statistics):
            joined = joined.withColumn(f"x{i}", F.expr(s).cast("double"))
        d2 = F.when(~F.col("base_failed"), _distance(k))
        kept = ~F.col("base_failed") & F.coalesce((F.col("n") < 2 * k) | (F.col("d2") <= self.cutoff), F.lit(True))
        return joined.withColumn("d2", d2).withColumn("kept", kept).drop("mean", "inverse", "determinant", "n", *(f"x{i}" for i in range(k)))


def own_group(lang: Column, source: Column) -> tuple[Column, Column]:
    """A name for language and source together, and for the language; null and empty differ."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return F.concat_ws("\n", name(lang), name(source)), name(lang)


def fitted(counted: DataFrame, statistics: dict[str, float] = STATISTICS, cutoff: float = CUTOFF, least_rows: int = LEAST_ROWS) -> Rule:
    """The rule that all rows of counted (a table of lang, source and the counts) give."""
    own, tongue = own_group(F.col("lang"), F.col("source"))
    good = counted.where(~base_failed()).select(own.alias("own"), tongue.alias("tongue"), *(F.expr(s).cast("double").alias(f"x{i}") for i, s in enumerate(statistics)))
    sizes = good.groupBy("own", "tongue").agg(F.count("*").alias("n"))
    small = F.col("n") < least_rows
    pooled = F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("tongue"))
    plan = written(sizes.withColumn("pooled", pooled).select("own", F.when(~small, F.col("own")).when(F.col("pooled") >= least_rows, F.col("tongue")).otherwise("").alias("g")), "groups")
    groups = plan.count()
    rows = written(good.join(F.broadcast(plan) if groups <= BROADCAST_GROUPS else plan, "own").drop("own", "tongue"), "vectors")
    estimates = robust_estimates(rows, list(statistics.values()))
    return Rule(written(plan.join(estimates, "g").drop("g"), "rule"), groups, statistics, cutoff)


def judged(df: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and d2 (null where the base rule decides) of every row of (doc_id, text, lang, source)."""
    counted = written(text_counts(df), "counts")
    rule = fitted(counted)
    return rule.applied(counted.withColumn("own", own_group(F.col("lang"), F.col("source"))[0])).select("doc_id", *COUNTS, "base_failed", "kept", "d2")


def kept_rows(df: DataFrame) -> DataFrame:
    """The rows of df, with all their columns, that the rules keep."""
    schema = ", ".join(f"{c} long" for c in COUNTS)
    held, back = apart(df)
    lang, source = F.col("lang").alias("own_lang"), F.col("source").alias("own_source")
    seen = written(with_columns_from_text(df.select(*held, lang, source), textstats.counts, schema), "counted")
    rule = fitted(seen.select(F.col("own_lang").alias("lang"), F.col("own_source").alias("source"), *COUNTS))
    return rule.applied(seen.withColumn("own", own_group(F.col("own_lang"), F.col("own_source"))[0])).where("kept").select(*back)


def op2_robust_quality(spark, sf_dir: str) -> DataFrame:
    """Base rules and the method's verdict for all documents."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
