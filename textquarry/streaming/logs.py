"""Streams of events and files: windows with a watermark, limits per key, and watched folders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textquarry.operators.analytics import tumbling


def windowed_counts(stream: DataFrame, minutes: int = 15, late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, value) of a stream; events later than ``late`` are left out."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return tumbling(timed, minutes)


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, started, ended, n) of sessions ended by a gap."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    per = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return per.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def first_deliveries(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark (a cache with a time to live)."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def rate_limited(stream: DataFrame, per_minute: int = 60) -> DataFrame:
    """(event_id, allowed): a token bucket per user, filled at ``per_minute`` and holding as much.

    The state of a user is two numbers. Events of a batch are taken in order of time; one that is older
    than the last seen fills nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(per_minute), None)
        rows = []
        for pdf in [pd.concat(list(batches)).sort_values(["ts", "event_id"])]:
            for event, ts in zip(pdf["event_id"], pdf["ts"]):
                now = ts.timestamp()
                if last is not None:
                    tokens = min(float(per_minute), tokens + max(0.0, now - last) * per_minute / 60.0)
                last = max(now, last or now)
                ok = tokens >= 1.0
                tokens -= ok
                rows.append((event, ok))
        state.update((tokens, last))
        yield pd.DataFrame(rows, columns=["event_id", "allowed"])

    timed = stream.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "event_id bigint, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def watch_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of files as they appear in a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def ingest_stream(files: DataFrame, table_path: str, checkpoint: str):
    """Parse files of a stream into a parquet table, all that is there now; started and returned."""
    from textquarry.sources.readers import parse_files

    def write(batch: DataFrame, number: int) -> None:
        parse_files(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
