"""What the operators share of Spark: tables of the corpus, the shared folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.buffers import blocks, text_buffer

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one of our own where that is unset and all runs on this machine (tests)."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark's setting by which a query's shuffle files go when the query has ended: once a table stands, nothing reads them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that this session wrote and nobody has dropped.
_tables: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no more than its tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make gives, written; tables written on the way there are deleted once it stands."""
    before = len(_tables)
    out = written(make(), name)
    _delete(spark, _tables[before:-1])
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        folders = {path.rsplit("/", 1)[0] for path in df.inputFiles()}
        _delete(df.sparkSession, [path for path in _tables if any(folder.endswith(path.rsplit("/", 1)[1]) for folder in folders)])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    for path in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        _tables.remove(path)


def apart(df: DataFrame, text: str = "text") -> tuple[list[Column], list[Column]]:
    """Columns that hold a row of any column names beside new ones: ``row`` without the text, and the text; and what gives the row back."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text]
    back = [F.col(text) if c == text else F.col("row")[c].alias(c) for c in df.columns]
    return [F.struct(*rest).alias("row"), F.col(text)], back


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow over batches of at most BATCH_BYTES (a setting of the session, made here), so that few texts are held at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


#: Bytes of rows that go to Python at once.
BATCH_BYTES = "8m"


def map_arrow(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[dict[str, object]]], schema: str) -> DataFrame:
    """mapInArrow with a function that yields dicts of columns for each batch."""
    names = [part.split()[0] for part in schema.split(",")]
    kinds: list[pa.DataType] = [_ARROW[part.split()[1]] for part in schema.split(",")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for columns in make(batch):
                    yield pa.RecordBatch.from_arrays([_array(columns[n], k) for n, k in zip(names, kinds)], names)

    return map_batches(df, run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values.cast(kind)
    return pa.array(values, kind)


def with_columns_from_text(df: DataFrame, make: Callable, added: str, text: str = "text") -> DataFrame:
    """All rows and columns of df, and the added long or binary columns: make(bytes, offsets) of the text column's blocks, as a dict."""
    names = [part.split()[0] for part in added.split(",")]
    kinds = [_ARROW[part.split()[1]] for part in added.split(",")]
    schema = StructType([*df.schema.fields, *StructType.fromDDL(added).fields])
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                raw, offsets = text_buffer(batch.column(at))
                for a, b, part, by_text in blocks(raw, offsets):
                    new = make(part, by_text)
                    rows = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*rows.columns, *(_array(new[n], k) for n, k in zip(names, kinds))], [*rows.schema.names, *names])

    return map_batches(df, run, schema)


def crc32_mod(column: str | Column, n: int) -> Column:
    """crc32 of a number as text, modulo n."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % n


def repeat_rows(values: pa.Array, times: np.ndarray) -> pa.Array:
    return values.take(pa.array(np.repeat(np.arange(len(values)), times)))
