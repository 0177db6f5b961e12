"""Writers: separated files, JSON, site and address reports, and a keyed store as snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators.merges import last_writer_wins


def write_separated(rows: DataFrame, path: str, separator: str = ";", mode: str = "overwrite") -> None:
    """One separated file a partition, with a header; a reader that needs a byte-order mark adds it on download."""
    rows.write.mode(mode).option("sep", separator).option("header", True).csv(path)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def site_report(hits: DataFrame) -> DataFrame:
    """host, high, medium, low: each site's addresses by confidence, best first."""
    ordered = hits.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "email", "confidence"))).alias("h"))
    listed = lambda level: F.array_join(F.transform(F.filter("h", lambda x: x["confidence"] == level), lambda x: x["email"]), ", ").alias(level)
    return ordered.select("host", *[listed(x) for x in ("high", "medium", "low")])


def address_report(sites: DataFrame) -> DataFrame:
    """One row for each address of a site's list."""
    return sites.select("host", F.explode("hits").alias("h")).select("host", "h.*")


def run_report(offers: DataFrame) -> DataFrame:
    """Counters of a discovery run in one row."""
    qualified = F.col("status") == "qualified"
    return offers.agg(F.count("*").alias("offers"), F.count_if(qualified).alias("qualified"), F.count_distinct(F.when(qualified, F.col("seller"))).alias("sellers"))


def save_keyed(spark, rows: DataFrame, path: str, keys: list[str], version: list[str]) -> DataFrame:
    """Rows merged into the newest snapshot under path, the last writer of a key winning; a new snapshot is written.

    Snapshots are never overwritten, so a failed job leaves the one before as it was.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = [int(f.getPath().getName()[1:]) for f in fs.listStatus(hadoop) if f.getPath().getName()[1:].isdigit()] if fs.exists(hadoop) else []
    done = [n for n in numbers if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}/_SUCCESS"))]
    merged = last_writer_wins(spark.read.parquet(f"{path}/v{max(done)}"), rows, keys, version) if done else last_writer_wins(rows.limit(0), rows, keys, version)
    out = f"{path}/v{max(numbers, default=0) + 1}"
    merged.write.parquet(out)
    return spark.read.parquet(out)
