"""Keyed merges: the supplier table as it is, and arrivals made from it by a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators import merges as ops
from quayside.plans.registry import Tables, query

#: Current: two thirds of suppliers, some names blank. Arriving: every second supplier with another balance.
CURRENT = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal END AS balance, 2020 + s_suppkey % 4 AS year FROM supplier WHERE s_suppkey % 3 <> 0"
NEW = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'new ' || s_name END AS name, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_acctbal + 1 END AS balance, 2021 + s_suppkey % 3 AS year FROM supplier WHERE s_suppkey % 2 = 0"
WITH = f"WITH c AS ({CURRENT}), n AS ({NEW})"


def sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    k, name, balance = F.col("s_suppkey"), F.col("s_name"), F.col("s_acctbal")
    current = t.supplier.where(k % 3 != 0).select(k.alias("id"), F.when(k % 5 == 0, "").otherwise(name).alias("name"), F.when(k % 4 != 0, balance).alias("balance"), (2020 + k % 4).alias("year"))
    new = t.supplier.where(k % 2 == 0).select(k.alias("id"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("new "), name)).alias("name"), F.when(k % 10 != 0, balance + 1).alias("balance"), (2021 + k % 3).alias("year"))
    return current, new


@query("UPS01", "UPS16", sql=f"{WITH} SELECT * FROM c UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM c)")
def merge_insert_or_ignore(t: Tables) -> DataFrame:
    return ops.insert_or_ignore(*sides(t), ["id"], ["year"])


@query("UPS02", "UPS06", "UPS07", "UPS08", "UPS24", "TRN07", sql=f"{WITH} SELECT id, CASE WHEN n.id IS NOT NULL AND (c.id IS NULL OR n.year >= c.year) THEN n.name ELSE c.name END AS name, CASE WHEN n.id IS NOT NULL AND (c.id IS NULL OR n.year >= c.year) THEN n.balance ELSE c.balance END AS balance, CASE WHEN n.id IS NOT NULL AND (c.id IS NULL OR n.year >= c.year) THEN n.year ELSE c.year END AS year FROM c FULL JOIN n USING (id)")
def merge_last_writer(t: Tables) -> DataFrame:
    """Newer or equal years win."""
    return ops.last_writer_wins(*sides(t), ["id"], ["year"])


@query("UPS03", "UPS21", sql=f"{WITH} SELECT id, coalesce(nullif(c.name, ''), nullif(n.name, ''), c.name, n.name) AS name, coalesce(c.balance, n.balance) AS balance, coalesce(c.year, n.year) AS year FROM c FULL JOIN n USING (id)")
def merge_fill_blank(t: Tables) -> DataFrame:
    return ops.fill_blank_only(*sides(t), ["id"], ["year"])


@query("UPS04", "UPS05", "UPS22", "TRN04", sql=f"{WITH} SELECT id, CASE WHEN coalesce(c.year = 2023, false) THEN c.name ELSE coalesce(nullif(n.name, ''), c.name, n.name) END AS name, CASE WHEN coalesce(c.year = 2023, false) THEN c.balance ELSE coalesce(n.balance, c.balance) END AS balance, CASE WHEN coalesce(c.year = 2023, false) THEN c.year ELSE coalesce(n.year, c.year) END AS year FROM c FULL JOIN n USING (id)")
def merge_overwrite(t: Tables) -> DataFrame:
    """Arriving values unless blank; rows marked as set by hand (here those of 2023) stay."""
    return ops.overwrite_unless_blank(*sides(t), ["id"], ["year"], F.col("_c.year") == 2023)


@query("UPS09", "HLP11", sql=f"{WITH} SELECT id, min(year) AS first_seen, max(year) AS last_seen, arg_max(balance_text, year * 2 + side) AS score, arg_max(name, year * 2 + side) AS decision FROM (SELECT id, name, year, 0 AS side, coalesce(CAST(balance AS VARCHAR), '') AS balance_text FROM c UNION ALL SELECT id, name, year, 1, coalesce(CAST(balance AS VARCHAR), '') FROM n) GROUP BY 1")
def merge_evidence(t: Tables) -> DataFrame:
    shape = lambda df: df.select("id", F.col("year").alias("first_seen"), F.col("year").alias("last_seen"), F.coalesce(F.col("balance").cast("string"), F.lit("")).alias("score"), F.col("name").alias("decision"))
    current, new = sides(t)
    return ops.evidence(shape(current), shape(new), ["id"])


@query("UPS10", sql="""
    WITH c AS (SELECT n_regionkey AS k, list_sort(list(DISTINCT n_nationkey)) AS items FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1), n AS (SELECT n_regionkey AS k, list_sort(list(DISTINCT n_nationkey)) AS items FROM nation WHERE n_nationkey % 3 = 0 GROUP BY 1)
    SELECT k, array_to_string(list_concat(coalesce(c.items, []), list_filter(coalesce(n.items, []), lambda x: NOT list_contains(coalesce(c.items, []), x))), ',') AS items FROM c FULL JOIN n USING (k)""")
def merge_append(t: Tables) -> DataFrame:
    """Items appended to a list if absent."""
    key = F.col("n_regionkey").alias("k")
    current = t.nation.where("n_nationkey % 2 = 0").groupBy(key).agg(F.array_sort(F.collect_set("n_nationkey")).alias("items"))
    new = t.nation.where("n_nationkey % 3 = 0").select(key, "n_nationkey")
    return ops.append_to_list(current, new, ["k"], "items", "n_nationkey").select("k", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("UPS11", "TRN08", "TRN12", "TRN23", sql=f"{WITH} SELECT id, CASE WHEN c.year = 2021 THEN 'processing' WHEN n.id IS NOT NULL THEN 'queued' ELSE 'finished' END AS status FROM c FULL JOIN n USING (id)")
def merge_by_state(t: Tables) -> DataFrame:
    """A row under way keeps its state; any other starts again when it is enqueued."""
    current, new = sides(t)
    joined = current.select("id", "year").join(new.select("id", F.lit(True).alias("queued")), "id", "full")
    return joined.select("id", F.when(F.col("year") == 2021, "processing").when(F.col("queued"), "queued").otherwise("finished").alias("status"))


@query("UPS13", "HLP07", sql="SELECT o_custkey, count(DISTINCT o_orderpriority) AS contents FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def idempotency_conflicts(t: Tables) -> DataFrame:
    return ops.conflicting_keys(t.orders, "o_custkey", "o_orderpriority")


@query("UPS17", "UPS25", "TRN02", "TRN03", "TRN15", "RDM04", "RDM05", sql="SELECT o_orderkey, (o_orderstatus = 'F') AS restored FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def soft_delete(t: Tables) -> DataFrame:
    """Rows of deleted parents go; restored ones are marked."""
    gone = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(gone, "o_custkey", "left_anti").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("restored"))


@query("UPS19", "TRN05", sql="SELECT s_suppkey, s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AS irrelevant FROM supplier")
def group_flag(t: Tables) -> DataFrame:
    """All members of a group with a flagged one."""
    flagged = t.supplier.where("s_acctbal < 0").select("s_nationkey").distinct().withColumn("hit", F.lit(True))
    return t.supplier.join(flagged, "s_nationkey", "left").select("s_suppkey", F.coalesce("hit", F.lit(False)).alias("irrelevant"))


@query("UPS20", "TXT93", sql="SELECT coalesce(m.canonical, l_suppkey) AS l_suppkey, count(*) AS n FROM lineitem LEFT JOIN (SELECT s_suppkey, arg_max(s_suppkey, s_acctbal * 1000000 - s_suppkey) OVER (PARTITION BY s_nationkey) AS canonical FROM supplier) m ON m.s_suppkey = l_suppkey GROUP BY 1")
def duplicate_merge(t: Tables) -> DataFrame:
    """Duplicates of a group re-keyed to the one of greatest balance, in a relation that refers to them."""
    best = t.supplier.groupBy("s_nationkey").agg(F.max_by("s_suppkey", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("canonical"))
    mapping = t.supplier.join(best, "s_nationkey").select("s_suppkey", "canonical")
    return ops.rekey(t.lineitem, "l_suppkey", mapping, "s_suppkey", "canonical").groupBy("l_suppkey").agg(F.count("*").alias("n"))
