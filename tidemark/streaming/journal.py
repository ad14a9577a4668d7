"""A journal of records in the shared folder: an append-only log, snapshots, and replay from any point of a crash.

Each append is a folder of JSON lines of its own, there as a whole or not at all; logs of
others, cut off anywhere, may lie beside them.  A record's value is that of its highest
sequence number, its deadline the latest of all, so that replaying an entry twice changes
nothing.  Compaction writes a snapshot of all that stands, and only once it is complete
deletes what it holds: whoever reads between sees entries twice and gets the same state.

Defined results: lines that aren't whole entries with a record and a sequence number are
counted and passed over; of entries with one record and number the greater value stays; a
null deadline is none; an empty or missing folder has no records.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "record string, seq long, value string, until_ms long"
_BROKEN = "_broken"


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    files, at = _place(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _place(spark, path)
    files.delete(at, True)


def _complete(spark: SparkSession, folder: str) -> list[str]:
    """Snapshots that stand, oldest first."""
    return [n for n in _names(spark, f"{folder}/snapshot") if "_SUCCESS" in _names(spark, f"{folder}/snapshot/{n}")]


def append(entries: DataFrame, folder: str) -> None:
    """Adds entries (record, seq, value, until_ms) to the log."""
    entries.select(F.to_json(F.struct("record", "seq", "value", "until_ms"))).write.text(f"{folder}/log/{uuid.uuid4().hex}")


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with ``entry``, null where the line is broken."""
    whole = F.from_json(line, f"{ENTRY}, {_BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    good = whole.isNotNull() & whole[_BROKEN].isNull() & whole["record"].isNotNull() & whole["seq"].isNotNull()
    return lines.withColumn("entry", F.when(good, whole.dropFields(_BROKEN)))


def merged(entries: DataFrame, *keys: str) -> DataFrame:
    """A record's entry with the highest number, and the latest deadline of all."""
    last = F.max(F.struct("seq", "value"))
    return entries.groupBy(*keys, "record").agg(last.alias("_last"), F.max("until_ms").alias("until_ms")).select(*keys, "record", "_last.seq", "_last.value", "until_ms")


def _lines(spark: SparkSession, folder: str, logs: list[str]) -> DataFrame:
    if not logs:
        return spark.createDataFrame([], "value string")
    return spark.read.text([f"{folder}/log/{n}" for n in logs])


def _standing(spark: SparkSession, folder: str, logs: list[str]) -> DataFrame:
    entries = parsed(_lines(spark, folder, logs)).where("entry IS NOT NULL").select("entry.*")
    for n in _complete(spark, folder)[-1:]:
        entries = entries.unionByName(spark.read.parquet(f"{folder}/snapshot/{n}"))
    return merged(entries)


def replayed(spark: SparkSession, folder: str) -> DataFrame:
    """record, seq, value and until_ms of all records: the last snapshot and the log."""
    return _standing(spark, folder, _names(spark, f"{folder}/log"))


def broken(spark: SparkSession, folder: str) -> int:
    """Lines of the log that are no whole entries; empty lines don't count."""
    lines = parsed(_lines(spark, folder, _names(spark, f"{folder}/log")))
    return lines.where(F.col("entry").isNull() & (F.trim("value") != "")).count()


def compact(spark: SparkSession, folder: str) -> None:
    """One snapshot instead of the last one and the logs that are there now; logs that are added meanwhile stay."""
    logs, before = _names(spark, f"{folder}/log"), _names(spark, f"{folder}/snapshot")
    number = int(before[-1]) + 1 if before else 1
    _standing(spark, folder, logs).write.parquet(f"{folder}/snapshot/{number:012d}")
    for n in before:
        _delete(spark, f"{folder}/snapshot/{n}")
    for n in logs:
        _delete(spark, f"{folder}/log/{n}")
