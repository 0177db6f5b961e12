"""Line dedup by distinct-site spread, in native expressions.

Every line (blanks at its ends cut off) is known by two hashes of it, 96 bits together. Per line a HyperLogLog
sketch of the sites that carry it is merged by aggregation, so a line that a third of the documents share
arrives as one small sketch a task. A line whose estimate lies near the threshold is counted exactly. Lines on
at least `min_sites` sites are boilerplate: each is kept in the document of smallest id that has it, at its first
place, and removed everywhere else.

Defined results: null text stays null with no lines; blank lines are never removed; a null site is no site; rows
alike in id, site and text are treated alike; a null id comes after all others; an empty table gives no rows;
other columns are passed on by dedup() and never mixed up with those made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import table, written

MIN_SITES = 10
#: Precision of the sketches, and how many standard errors (1.04 / sqrt(2**k) each) count as near.
SKETCH_K, NEAR = 12, 4.0
BLANKS = " \t\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed(docs: DataFrame, id_column: str, text_column: str, site_column: str) -> DataFrame:
    """docs as a struct _row, with _key known by id, site and text."""
    key = F.xxhash64(F.col(id_column).cast("long"), F.col(site_column), F.col(text_column))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"), F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_text"), F.col(site_column).cast("string").alias("_site"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """h, g, first: lines on at least min_sites sites, and where each is kept."""
    place = F.struct(F.col("_id").isNull().alias("last"), "_id", "_key", "at")
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_agg("_site", F.lit(SKETCH_K)).alias("sketch"), F.min(place).alias("first"))
    estimate = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0))
    margin = NEAR * 1.04 / 2 ** (SKETCH_K / 2) * min_sites + 1
    # one row for each line, of which few pass: written once, read for the far and the near ones
    spread = spread.select("h", "g", "first", estimate.alias("sites")).where(F.col("sites") >= min_sites - margin)
    spread = written(spread, "spread")
    far = spread.where(F.col("sites") > min_sites + margin)
    near = spread.where(F.col("sites") <= min_sites + margin)
    counted = lines.join(near.select("h", "g"), ["h", "g"], "left_semi").where("_site is not null").select("h", "g", "_site").distinct()
    exact = counted.groupBy("h", "g").count().where(F.col("count") >= min_sites).select("h", "g")
    return far.select("h", "g", "first").union(near.join(exact, ["h", "g"]).select("h", "g", "first"))


def dedup(docs: DataFrame, min_sites: int = MIN_SITES, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source") -> DataFrame:
    """_row (the input row), kept_text, n_lines, n_removed."""
    rows = keyed(docs, id_column, text_column, site_column)
    cut = F.transform(split_lines(F.col("_text")), lambda x: F.btrim(x, F.lit(BLANKS)))
    marked = F.transform(cut, lambda x, i: F.when(x != "", F.struct(i.alias("at"), F.xxhash64(x).alias("h"), F.hash(x).alias("g"))))
    lines = rows.select("_key", "_id", "_site", F.explode(F.array_compact(marked)).alias("x")).select("_key", "_id", "_site", "x.at", "x.h", "x.g")
    lines = written(lines, "lines")
    common = written(boilerplate(lines, min_sites), "boilerplate")
    found = lines.join(common, ["h", "g"]).where("not (_key = first._key and at = first.at)")
    gone = found.groupBy(F.col("_key").alias("_k"), F.col("_id").alias("_i")).agg(F.collect_set("at").alias("gone"))
    # by hash and id, so that rows of one hash do not lose each other's lines
    joined = rows.join(gone, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i")), "left").withColumn("_lines", split_lines(F.col("_text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    return joined.select(
        "_row",
        F.when(F.col("_text").isNull() | F.col("gone").isNull(), F.col("_text")).otherwise(kept).alias("kept_text"),
        F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
