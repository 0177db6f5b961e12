"""Connected components over a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import release, run_of_tables, written


def _round(edges: DataFrame, small: bool) -> DataFrame:
    """One star step: each node's links are hung on the smallest node it can see.

    small: only links to smaller nodes move (small star), else only those to larger ones (large star).
    The smallest neighbour is a partial aggregate, then joined back, so a hub's links are never in one list.
    """
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.join(least, "u")
    if not small:
        moved = moved.where("v > u")
    out = moved.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    if small:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (u, v: of any type with an order), root being the smallest that can be reached.

    Alternating large-star and small-star steps, each written to the shared folder, until a step changes no link.
    Links with a null end, loops and repeats are left out; no links give no rows.
    """
    spark = links.sparkSession
    with run_of_tables() as made:
        edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        n = edges.count()
        while n:
            last, before = edges, n
            edges = written(_round(_round(last, False), True), "links")
            n = edges.count()
            # both hold distinct links: as many, and none that was not there, is the same state
            settled = n == before and edges.join(last, ["u", "v"], "left_anti").isEmpty()
            release(spark, made, keep=1)
            if settled:
                break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.selectExpr("u as node", "v as root").union(roots.selectExpr("node", "node as root"))
