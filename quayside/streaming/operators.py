"""Structured Streaming: de-duplicating ingest, status folding, circuit breaking, windowed counts.

The state logic is shared with the batch operators, so a stream's end state equals the batch result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quayside.operators.sequences import Breaker

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def file_stream(spark, path: str, schema: str = EVENT, files_per_batch: int = 1) -> DataFrame:
    """New parquet files of a folder, a few at a time; the checkpoint is the durable cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, keys: list[str], at: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first row of every natural key; keys are forgotten once the watermark has passed."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, key: str, at: str = "ts", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), key).agg(F.count("*").alias("n")).select("window.start", key, "n")


def status_fold(stream: DataFrame) -> DataFrame:
    """user_id, last_at, status after each batch: a later error fails, else a purchase is a reply, else sent.

    The state is three times a key, whatever the order in which events come.
    """

    at = F.col("ts").cast("double")
    latest = lambda kind: F.coalesce(F.max(F.when(F.col("event_type") == kind, at)), F.lit(0.0))
    times = stream.groupBy("user_id").agg(F.max(at).alias("last_at"), latest("error").alias("error"), latest("purchase").alias("reply"))
    status = F.when(F.col("error") > F.col("reply"), "failed").when(F.col("reply") > 0, "replied").otherwise("sent")
    return times.select("user_id", "last_at", status.alias("status"))


def breaker(stream: DataFrame) -> DataFrame:
    """user_id, state, until after each batch, of accounts whose failures open a breaker.

    Within a batch events are taken in order of time; the state is the breaker's level, end and recent failures.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Breaker(*state.get) if state.exists else Breaker()
        seen = pd.concat(list(frames)).sort_values(["at", "event_id"])
        now = "closed"
        for at, kind in zip(seen["at"], seen["event_type"], strict=True):
            now = held.see(float(at), kind == "error")
        state.update((held.level, float(held.until), [float(x) for x in held.failures]))
        yield pd.DataFrame({"user_id": [key[0]], "state": [now], "until": [float(held.until)]})

    rows = stream.select("user_id", "event_id", F.col("ts").cast("double").alias("at"), "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(fold, "user_id long, state string, until double", "level int, until double, failures array<double>", "update", GroupStateTimeout.NoTimeout)


def run_once(frame: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """All that is there now into a memory table, then stop."""
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
