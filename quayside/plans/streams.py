"""The streaming operators run to the end of the events table, as a stream of its files.

Each run keeps its checkpoint in the shared folder of spark.checkpoint.dir and reads its result from a written
table, so nothing depends on the driver's memory.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.plans.registry import Tables, query
from quayside.streaming import operators as ops


def stream(t: Tables) -> DataFrame:
    """events as a stream; its time is taken as UTC."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    # a file source takes a folder or a pattern, so the table's name is given as one
    rows = ops.file_stream(t._spark, f"{t._folder}/events.parque[t]", schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(t: Tables, frame: DataFrame, complete: bool = False) -> DataFrame:
    """All rows that the stream puts out until its input ends; with complete, of each update batch as well."""
    root = t._spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if t._spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quayside-")
    place = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/out/n={number}")

    writer = frame.writeStream.outputMode("update" if complete else "append").foreachBatch(put)
    writer.option("checkpointLocation", f"{place}/cursor").trigger(availableNow=True).start().awaitTermination()
    return t._spark.read.schema(T.StructType([*frame.schema, T.StructField("batch", T.IntegerType())])).parquet(f"{place}/out/*")


@query("STM01", "STM02", sql="SELECT event_id, user_id, event_type FROM events")
def stream_ingest(t: Tables) -> DataFrame:
    """De-duplicated by natural key within the watermark; batches rewritten by number, so a retry repeats nothing."""
    return finished(t, ops.ingest(stream(t), ["event_id"], delay="40 days")).select("event_id", "user_id", "event_type")


@query("STM05", "STM04", sql="SELECT user_id, CASE WHEN max(ts) FILTER (event_type = 'error') > coalesce(max(ts) FILTER (event_type = 'purchase'), TIMESTAMP '1970-01-01') THEN 'failed' WHEN bool_or(event_type = 'purchase') THEN 'replied' ELSE 'sent' END AS status FROM events GROUP BY 1")
def stream_status_fold(t: Tables) -> DataFrame:
    """The last state of every key after the stream has ended."""
    rows = finished(t, ops.status_fold(stream(t)), complete=True)
    return rows.groupBy("user_id").agg(F.max_by("status", "batch").alias("status"))


@query("STM12", "STM13", "STM14")
def stream_breaker(t: Tables) -> DataFrame:
    rows = finished(t, ops.breaker(stream(t)), complete=True)
    return rows.groupBy("user_id").agg(F.max_by(F.struct("state", "until"), "batch").alias("s")).select("user_id", "s.state", "s.until")
