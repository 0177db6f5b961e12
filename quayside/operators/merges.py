"""Keyed merges as pure functions of two snapshots: current rows and arriving rows give the new rows.

A keyed merge is a union, then one aggregate by key, so a key's rows are reduced before the shuffle. Every
function is idempotent: merging the same arrivals again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(c: Column, kind: str) -> Column:
    return F.nullif(c, F.lit("")) if kind == "string" else c


def insert_or_ignore(current: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New keys only; of several arrivals of a key the first by order."""
    columns = [c for c in current.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
    return current.unionByName(first.join(current.select(*keys).distinct(), keys, "left_anti"))


def last_writer_wins(current: DataFrame, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of the greatest version; at equal versions the arriving one."""
    columns = [c for c in current.columns if c not in keys]
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*version, "_new")).alias("_r")).select(*keys, "_r.*")


def _pair(current: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Both sides' rows of each key as structs _c and _n, one row a key; of several arrivals the last by order."""
    columns = [c for c in current.columns if c not in keys]
    arriving = new.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_n"))
    return current.select(*keys, F.struct(*columns).alias("_c")).join(arriving, keys, "full"), [(c, t) for c, t in current.dtypes if c not in keys]


def fill_blank_only(current: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A value that is there is never overwritten; '' and null are blank, and stay '' where both sides are blank."""
    joined, columns = _pair(current, new, keys, order)
    pick = lambda c, t: F.coalesce(blank_to_null(F.col(f"_c.{c}"), t), blank_to_null(F.col(f"_n.{c}"), t), F.col(f"_c.{c}"), F.col(f"_n.{c}"))
    return joined.select(*keys, *[pick(c, t).alias(c) for c, t in columns])


def overwrite_unless_blank(current: DataFrame, new: DataFrame, keys: list[str], order: list[str], manual: Column | None = None) -> DataFrame:
    """Arriving values win unless blank; a row whose condition `manual` (over _c) holds keeps what it has."""
    joined, columns = _pair(current, new, keys, order)
    held = F.coalesce(manual, F.lit(False)) if manual is not None else F.lit(False)
    fresh = lambda c, t: F.coalesce(blank_to_null(F.col(f"_n.{c}"), t), F.col(f"_c.{c}"), F.col(f"_n.{c}"))
    return joined.select(*keys, *[F.when(held, F.col(f"_c.{c}")).otherwise(fresh(c, t)).alias(c) for c, t in columns])


def evidence(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """first_seen is kept, last_seen moves on, score and decision come from the latest sight."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = F.struct("last_seen", "_new")
    return both.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("score", latest).alias("score"), F.max_by("decision", latest).alias("decision"))


def append_to_list(current: DataFrame, new: DataFrame, keys: list[str], listed: str, item: str) -> DataFrame:
    """Items of the arrivals, sorted, appended to the list of their key if they are not in it."""
    items = new.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("_items"))
    none = F.array().cast(dict(current.dtypes)[listed])
    joined = current.select(*keys, listed).join(items, keys, "full")
    return joined.select(*keys, F.array_union(F.coalesce(listed, none), F.coalesce("_items", none)).alias(listed))


def conflicting_keys(rows: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Idempotency keys used for different contents."""
    return rows.groupBy(key).agg(F.count_distinct(fingerprint).alias("contents")).where("contents > 1")


def rekey(rows: DataFrame, key: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Keys of duplicates replaced by the canonical key; mapping has one row for each old key."""
    joined = rows.join(mapping.select(F.col(old).alias("_old"), F.col(new).alias("_canonical")), rows[key] == F.col("_old"), "left")
    return joined.withColumn(key, F.coalesce("_canonical", key)).drop("_old", "_canonical")
