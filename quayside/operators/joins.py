"""Join shapes that Spark has no single operator for, as equi joins that scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Pairs that a slice of sliced_join() makes, about.
PAIRS = 2_000_000


def sliced_join(left: DataFrame, right: DataFrame, on: list[str], pairs: int = PAIRS) -> DataFrame:
    """left and right joined on equal columns, where the pairs are many more than the rows.

    Pairs are counted by key first. A key's left rows are dealt to slices of about so many pairs, its right rows go to every slice,
    and there are as many partitions as slices fill: more pairs are more tasks, not longer ones, as bytes of input would have it.
    """
    sizes = left.groupBy(on).agg(F.count("*").alias("_left")).join(right.groupBy(on).agg(F.count("*").alias("_right")), on)
    sizes = sizes.withColumn("_pairs", F.col("_left") * F.col("_right"))
    partitions = (sizes.agg(F.sum("_pairs")).first()[0] or 0) // pairs + 1
    slices = sizes.select(*on, F.least("_left", F.ceil(F.col("_pairs") / pairs)).alias("_slices"))
    dealt = left.join(slices, on).withColumn("_slice", F.pmod(F.xxhash64(*left.columns), "_slices")).drop("_slices")
    copied = right.join(slices, on).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))).drop("_slices")
    on = [*on, "_slice"]
    return dealt.repartition(partitions, *on).join(copied.repartition(partitions, *on), on).drop("_slice")


def domain_suffixes(host: Column) -> Column:
    """The host and every parent domain of it: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def suffix_flag(rows: DataFrame, host: str, listed: DataFrame, domain: str, flag: str) -> DataFrame:
    """rows with a boolean: whether the host is a listed domain or below one.

    The host is exploded into its suffixes and matched by equality, so there is no nested loop; the marker is
    joined back on the host's distinct values.
    """
    hosts = rows.select(F.col(host).alias("_host")).where(F.col(host).isNotNull()).distinct()
    hit = hosts.select("_host", F.explode(domain_suffixes(F.col("_host"))).alias("_suffix"))
    blocked = hit.join(listed.select(F.lower(F.col(domain)).alias("_suffix")).distinct(), "_suffix", "left_semi").select("_host").distinct()
    marked = blocked.withColumn(flag, F.lit(True))
    return rows.join(marked, rows[host] == marked["_host"], "left").drop("_host").withColumn(flag, F.coalesce(flag, F.lit(False)))


def suffix_anti_join(rows: DataFrame, host: str, listed: DataFrame, domain: str) -> DataFrame:
    return suffix_flag(rows, host, listed, domain, "_listed").where(~F.col("_listed")).drop("_listed")


def marker(keys: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """Distinct keys with a true flag, for EXISTS as a left join."""
    return keys.select(*columns).distinct().withColumn(flag, F.lit(True))


def with_marker(rows: DataFrame, keys: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """rows with a boolean column: whether keys has an equal key."""
    return rows.join(marker(keys, columns, flag), columns, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """One row a key: that with the greatest order struct. A partial aggregate, so no key's rows meet unreduced."""
    kept = columns or [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*kept), F.struct(*order)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, "_best.*")


def latest_overlap(rows: DataFrame, key: str, tokens: Column, other: str) -> DataFrame:
    """For each row the latest other one (greatest key) that shares a token, and the number of tokens they share.

    Each token is reduced to its two latest rows before the join, the second for the row that is the latest itself, so
    a frequent token does not emit its pairs. Rows that share nothing are left out.
    """
    sets = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.array_distinct(tokens).alias("_tokens"))
    each = sets.select("_key", F.explode("_tokens").alias("_token"))
    first = each.groupBy("_token").agg(F.max("_key").alias("_first"))
    second = each.join(first, "_token").where("_key < _first").groupBy("_token").agg(F.max("_key").alias("_second"))
    latest = first.join(second, "_token")  # a token of one row alone matches nothing
    met = each.join(latest, "_token").withColumn("_other", F.when(F.col("_key") < F.col("_first"), F.col("_first")).otherwise(F.col("_second")))
    best = met.groupBy("_key").agg(F.max("_other").alias("_other"))
    theirs = sets.select(F.col("_key").alias("_other"), F.col("_tokens").alias("_theirs"))
    shared = F.size(F.array_intersect("_tokens", "_theirs")).cast("long")
    return best.join(sets, "_key").join(theirs, "_other").select(F.col("_key").alias(key), F.col("_other").alias(other), shared.alias("shared"))
