"""What the training-data operators share: tables, the shared scratch folder, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of one Arrow batch; long texts would fill memory in batches counted by rows alone.
ARROW_BYTES = 16 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_BYTES at most, unless the session has set a limit of its own."""
    if spark.conf.get(_LIMIT, None) is None:
        spark.conf.set(_LIMIT, str(ARROW_BYTES))


def give_back() -> None:
    """Return freed memory to the system at a task's end: workers are used again by later stages."""
    gc.enable()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local session without that setting (tests) gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quayside-"))
    return _own[0]


#: The tables that the run in this context has written and not removed; a run of its own has a list of its own.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def run_of_tables() -> Iterator[list[str]]:
    """Within it, written() notes its tables in the list that is given; what is left in it at the end the run around it gets."""
    held: list[str] = []
    token = _made.set(held)
    try:
        yield held
    finally:
        _made.reset(token)
        around = _made.get()
        if around is not None:
            around += held


def few(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df marked for broadcast if it is counted to have at most so many rows; it should be thin, and written before."""
    return F.broadcast(df) if df.count() <= most else df


def release(spark: SparkSession, made: list[str], keep: int = 0, first: int = 0) -> None:
    """Remove these tables but for the first `first` and the last `keep`; nothing may read them later."""
    for path in made[first : len(made) - keep]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        made.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = _made.get()
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Elements that running() takes together.
TOGETHER = 256


def running(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """array<kind> gathered while a position runs over the items.

    step(position, item) gives (the next position, the element, whether it is gathered). An array that grows element by
    element is copied each time, so the items go in chunks and the cost stays near linear.
    """
    none = F.array().cast(f"array<{kind}>")
    last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / TOGETHER).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * TOGETHER + 1, TOGETHER))

    def one(held: Column, x: Column) -> Column:
        at, element, wanted = step(held["at"], x)
        return F.struct(at.cast("long").alias("at"), F.when(wanted, F.concat(held["out"], F.array(element))).otherwise(held["out"]).alias("out"))

    def chunk(done: Column, part: Column) -> Column:
        begun = F.struct(F.element_at(done, -1)["at"].alias("at"), none.alias("out"))
        return F.concat(done, F.array(F.aggregate(part, begun, one)))

    start = F.array(F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")))
    return F.aggregate(chunks, start, chunk, lambda done: F.flatten(F.transform(done, lambda x: x["out"])))
