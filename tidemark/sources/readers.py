"""Landing-zone readers with fixed schemas.  Nothing here infers a schema or asks a network."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import normalize_epoch

KLINE = T.StructType([T.StructField(n, T.StringType() if n in ("open_time", "close_time") else T.DoubleType()) for n in ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_base", "taker_quote", "ignore")])
METRICS = T.StructType([T.StructField(n, T.StringType() if n in ("create_time", "symbol") else T.DoubleType()) for n in ("create_time", "symbol", "sum_open_interest", "sum_open_interest_value", "count_toptrader_long_short_ratio", "sum_toptrader_long_short_ratio", "count_long_short_ratio", "sum_taker_long_short_vol_ratio")])
FUNDING = T.StructType([T.StructField("calc_time", T.StringType()), T.StructField("interval_hours", T.DoubleType()), T.StructField("last_funding_rate", T.DoubleType())])
#: Rows of an archive member that become one batch.
_BATCH = 50_000
_LEAST_FIELDS = 11


def zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """archive_lines of all zip files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    return archive_lines(files.select("path", "content"))


def zipped(files: DataFrame) -> DataFrame:
    """(path, body) as (path, content): each body as the only member of an archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for body in batch["body"]:
                with zipfile.ZipFile(data := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("data.csv", body)
                out.append(data.getvalue())
            yield pd.DataFrame({"path": batch["path"], "content": out})

    return files.select("path", "body").mapInPandas(run, "path string, content binary")


def _member_lines(content: bytes | None) -> Iterator[tuple[int, str]]:
    """Numbered lines of the first .csv member; none of an archive that is no archive or is damaged before it can be read through."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            member = next((m for m in z.namelist() if m.endswith(".csv")), None)
            if member is None or z.testzip() is not None:
                return
            with z.open(member) as f:
                yield from enumerate(io.TextIOWrapper(f, "utf-8-sig", errors="replace"))
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
        return


def archive_lines(files: DataFrame) -> DataFrame:
    """path, line_no, fields of every line of the first .csv member of each archive (path, content); a file is read by one task, in batches.

    Lines of less than eleven fields are dropped, and a first line that doesn't begin with a
    digit.  A damaged archive gives no lines and doesn't end the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                for i, raw in _member_lines(content):
                    fields = raw.rstrip("\r\n").split(",")
                    if len(fields) < _LEAST_FIELDS or (i == 0 and not fields[0][:1].isdigit()):
                        continue
                    rows.append((name, i, fields))
                    if len(rows) >= _BATCH:
                        yield pd.DataFrame(rows, columns=["path", "line_no", "fields"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "line_no", "fields"])

    return files.mapInPandas(run, "path string, line_no long, fields array<string>")


def klines(lines: DataFrame, dedupe: bool = True) -> DataFrame:
    """Typed bars from zip_lines: times in milliseconds row by row, numbers or null, rows without times dropped; of a time's rows the first stays."""
    names = KLINE.fieldNames()
    typed = lines.select("path", "line_no", *(F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)))
    out = typed.select("path", "line_no", normalize_epoch("open_time").alias("ts_ms"), normalize_epoch("close_time").alias("close_ms"), *(F.col(n).try_cast("double").alias(n) for n in names if n not in ("open_time", "close_time", "ignore")))
    out = out.where("ts_ms IS NOT NULL AND close_ms IS NOT NULL").withColumn("symbol", F.regexp_extract("path", r"([A-Z0-9]+)-[0-9a-z]+-\d{4}-\d{2}", 1))
    if dedupe:
        w = Window.partitionBy("symbol", "ts_ms").orderBy("path", "line_no")
        out = out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Five-minute metrics from CSV with or without a header, which has no time and so falls out; times in milliseconds; of a time's rows the last stays."""
    raw = spark.read.schema(METRICS).csv(path).withColumn("_file", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())
    out = raw.withColumn("ts_ms", normalize_epoch("create_time")).where("ts_ms IS NOT NULL")
    w = Window.partitionBy("symbol", "ts_ms").orderBy(F.col("_file").desc(), F.col("_at").desc())
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_at", "_file", "create_time")


def hourly(df: DataFrame) -> DataFrame:
    """Rows on the hour."""
    return df.where("ts_ms % 3600000 = 0")


def funding(spark: SparkSession, path: str) -> DataFrame:
    """Funding rates; a header, where there is one, falls out as it has no time."""
    raw = spark.read.schema(FUNDING).csv(path)
    return raw.withColumn("ts_ms", normalize_epoch("calc_time")).where("ts_ms IS NOT NULL").drop("calc_time")


def bars(spark: SparkSession, path: str, symbols: list[str] | None = None, first_month: str | None = None, last_month: str | None = None) -> DataFrame:
    """Bars partitioned by symbol and ym: filters become partition pruning."""
    df = spark.read.parquet(path)
    if symbols:
        df = df.where(F.col("symbol").isin(symbols))
    if first_month:
        df = df.where(F.col("ym") >= first_month)
    if last_month:
        df = df.where(F.col("ym") <= last_month)
    return df


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, gzip included; broken lines are kept apart in _corrupt_record if the schema has it."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modification time of every file below, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of every file below."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verified(found: DataFrame, expected: DataFrame) -> DataFrame:
    """name, state: done, missing, needs_verify (no expected checksum) or bad."""
    both = expected.join(found, "name", "left")
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("sha256").isNull(), "needs_verify").when(F.col("actual") == F.col("sha256"), "done").otherwise("bad")
    return both.select("name", state.alias("state"))
