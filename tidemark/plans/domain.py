"""The driver's tables as the engine's domain: views, bars, metrics, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import dialect

NAMES = "region nation customer supplier part orders lineitem events documents labels pages".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """A query over the driver's tables and the domain's, planned by Catalyst as one statement."""
    statement = dialect.spark_text(query)
    for name in NAMES:
        if name in statement:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(statement)


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """bars, user_bars, daily, caps, tickers or samples."""
    return sql(spark, sf_dir, f"SELECT * FROM {name}")
