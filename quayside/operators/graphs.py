"""Closure over links: connected components by star steps, chains of references by pointer jumping.

Both run in rounds; each round is cut off by a checkpoint in the folder that the session names in spark.checkpoint.dir,
so that a lost executor costs one round at most.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint. A session without a folder for it gets one of its own if it is local (tests), else an error."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if context.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quayside-"))
    return df.checkpoint()


def hung_on_least(links: DataFrame, downwards: bool) -> DataFrame:
    """One star step: of every node u with its neighbours v, some neighbours hang on the least of them all.

    Downwards, these are the smaller neighbours and the node itself; else the larger ones. A node's least neighbour is a
    partial aggregate, so a node that a third of the links have arrives as one row a task.
    """
    seen = links if downwards else links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("w")).withColumn("w", F.least("u", "w"))
    hung = seen.join(least, "u").where(F.lit(True) if downwards else F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("w").alias("b"))
    if downwards:
        hung = hung.union(least.select("u", "w"))
    return hung.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()


def connected(links: DataFrame) -> DataFrame:
    """node, root for every node of links (u, v), root being the smallest node that it is connected with.

    Null ends, loops and repeated links do not matter; no links give no rows.
    """
    now = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    many = now.count()
    while many:
        after = cut(hung_on_least(hung_on_least(now, False), True))
        same = after.count() == many and after.join(now, ["u", "v"], "left_anti").isEmpty()
        now, many = after, after.count()
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def chain_ends(references: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """references (old, new; one row an old key) with new the end of each chain: a -> b -> c gives a -> c and b -> c.

    Pointers are doubled: a chain of n references takes log2(n) rounds. Null ends and references to itself are left out;
    references that lead round in a circle have no end and are an error.
    """
    now = cut(references.where(f"`{old}` <> `{new}`").select(F.col(old).alias("old"), F.col(new).alias("new")))
    rounds = now.count().bit_length() + 1
    for _ in range(rounds):
        next_ = now.select(F.col("old").alias("_at"), F.col("new").alias("_next"))
        now = cut(now.join(next_, F.col("new") == F.col("_at"), "left").select("old", F.coalesce("_next", "new").alias("new")))
        if now.join(now.select(F.col("old").alias("new")), "new", "left_semi").isEmpty():
            return now.select(F.col("old").alias(old), F.col("new").alias(new))
    raise ValueError("the references lead round in a circle")
