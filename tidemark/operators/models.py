"""Models over sample panels, with Spark's own estimators."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names and beginnings of columns that read the future, never features.
LEAKS = {"label", "toxic", "quality", "gain", "days_to_peak"}
LEAK_PREFIXES = ("fwd_", "ret_after", "peak_", "touch")


def features(columns: list[str]) -> list[str]:
    """Columns that may be features."""
    return [c for c in columns if c not in LEAKS and not c.startswith(LEAK_PREFIXES)]


def prepared(train: DataFrame, test: DataFrame, names: list[str], least: float = 0.6) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with medians of train filled in and population standardisation by train; columns under ``least`` coverage in train are left out."""
    shares = train.agg(*(F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in names)).first()
    kept = [c for c in names if (shares[c] or 0) >= least]
    imputer = Imputer(strategy="median", relativeError=0.0, inputCols=kept, outputCols=[f"f_{c}" for c in kept]).fit(train)
    filled = [imputer.transform(x) for x in (train, test)]
    s = filled[0].agg(*(f(f"f_{c}").alias(f"{n}_{c}") for c in kept for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scaled = [x.withColumns({f"f_{c}": (F.col(f"f_{c}") - s[f"m_{c}"]) / (s[f"s_{c}"] or 1.0) for c in kept}) for x in filled]
    assembler = VectorAssembler(inputCols=[f"f_{c}" for c in kept], outputCol="features")
    return assembler.transform(scaled[0]), assembler.transform(scaled[1]), kept


def logistic(train: DataFrame, label: str, c: float = 0.5, balanced: bool = True):
    """A logistic model with penalty 1 / (c n), classes weighted to equal sums if asked."""
    n, pos = train.agg(F.count("*"), F.sum(F.col(label))).first()
    weight = F.when(F.col(label) == 1, n / (2.0 * max(pos, 1))).otherwise(n / (2.0 * max(n - pos, 1))) if balanced else F.lit(1.0)
    rows = train.withColumn("_w", weight).withColumn("_y", F.col(label).cast("double"))
    return LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w", regParam=1.0 / (c * max(n, 1)), standardization=False).fit(rows)


def probabilities(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def ridge(train: DataFrame, target: str, alpha: float = 10.0):
    """A ridge model with penalty alpha / n."""
    n = max(train.count(), 1)
    return LinearRegression(featuresCol="features", labelCol="_t", regParam=alpha / n, elasticNetParam=0.0, standardization=False).fit(train.withColumn("_t", F.col(target).cast("double")))


def gain_bits(rows: DataFrame, p: str, label: str) -> DataFrame:
    """Bits per row that the probabilities gain over the base rate."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = F.avg(-F.when(F.col(label) == 1, F.ln(q)).otherwise(F.ln(1 - q)))
    b = F.avg(F.col(label).cast("double"))
    base = -(b * F.ln(F.greatest(b, F.lit(1e-12))) + (1 - b) * F.ln(F.greatest(1 - b, F.lit(1e-12))))
    return rows.agg(((base - loss) / F.ln(F.lit(2.0))).alias("bits"))
