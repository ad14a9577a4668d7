"""Structured Streaming: bars, deduplication, quota windows, sessions, and the pause machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars of (symbol, ts, event_id, value); rows later than the watermark are left out."""
    order = F.struct("ts", "event_id")
    grouped = events.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    return grouped.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum("value").alias("volume"), F.count("*").alias("trades")).select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume", "trades")


def deduplicated(rows: DataFrame, keep_for: str = "3 hours") -> DataFrame:
    """Each (symbol, ts) once within the watermark."""
    return rows.withWatermark("ts", keep_for).dropDuplicatesWithinWatermark(["symbol", "ts"])


def quota(hits: DataFrame, width: str = "5 minutes", slide: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Hits of each egress in sliding windows."""
    return hits.withWatermark("ts", late).groupBy("egress", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("hits")).select("egress", F.col("w.start").alias("start"), "hits")


def episodes(signals: DataFrame, gap: str = "48 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of signals: a gap longer than ``gap`` ends one."""
    return signals.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("top")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "top")


def clean_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes with a bid over zero and an ask no lower."""
    return quotes.where((F.col("bid") > 0) & (F.col("ask") >= F.col("bid")))


PAUSE_OUT = "domain string, until_ms long, probes int, state string"
PAUSE_STATE = "until_ms long, probes int"


def pauses(events: DataFrame, cooldown_ms: int = 300_000) -> DataFrame:
    """The pause machine of each domain over (domain, at_ms, kind, until_ms).

    A ban only ever extends the pause; after its end one probe goes out, which clears it
    or, if it fails, starts the cooldown; a success before the end is of no effect.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until, probes = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["at_ms", "kind"])
        for at, kind, ban in zip(rows["at_ms"], rows["kind"], rows["until_ms"]):
            if kind == "ban":
                until, probes = max(until, int(ban)), 0
            elif at >= until and until:
                if kind == "ok":
                    until, probes = 0, 0
                elif kind == "fail":
                    until, probes = int(at) + cooldown_ms, probes + 1
        state.update((until, probes))
        yield pd.DataFrame([(key[0], until, probes, "paused" if until else "open")], columns=["domain", "until_ms", "probes", "state"])

    return events.groupBy("domain").applyInPandasWithState(step, PAUSE_OUT, PAUSE_STATE, "update", GroupStateTimeout.NoTimeout)


def to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns its result, written below folder: for tests and ``--once`` rounds.

    A batch that runs twice writes its own place again.  Of complete results the last stays.
    """
    spark: SparkSession = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/begin")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'begin' if mode == 'complete' else number}")

    query: StreamingQuery = stream.writeStream.foreachBatch(save).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/*")
