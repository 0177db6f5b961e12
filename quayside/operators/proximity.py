"""Values of a text that stand near certain words: each match with the text around it, at any length and in any number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Matches whose places are added up together; an array that grows match by match is copied each time.
TOGETHER = 128


def match_places(text: Column, pattern: str) -> Column:
    """array of struct(at, value) of the pattern's matches, at counted from 0."""
    hits, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(hits.alias("hit"), F.slice(parts, 1, F.greatest(F.size(hits), F.lit(0))).alias("part"))
    kind = "array<struct<at:int,value:string>>"
    ends = lambda held, x: F.struct((held["to"] + F.length(x["part"]) + F.length(x["hit"])).alias("to"), F.concat(held["out"], F.array(F.struct((held["to"] + F.length(x["part"])).alias("at"), x["hit"].alias("value")))).alias("out"))
    none = lambda to: F.struct(to.alias("to"), F.array().cast(kind).alias("out"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(both) - 1, F.lit(0)) / TOGETHER).cast("int")), lambda i: F.slice(both, i * TOGETHER + 1, TOGETHER))
    grown = F.aggregate(chunks, F.array(none(F.lit(0))), lambda done, c: F.concat(done, F.array(F.aggregate(c, none(F.element_at(done, -1)["to"]), ends))))
    return F.flatten(F.transform(grown, lambda g: g["out"]))


def near_words(rows: DataFrame, text: str, patterns: list[str], words: list[str], barred: list[str] = (), unless: list[str] = (), required: list[str] = (), margin: int = 180, key: str = "doc_id") -> DataFrame:
    """key, value, at, context for each value that matches a pattern and has one of the words within `margin` characters.

    A value whose surroundings have a barred word and none of `unless` is left out, and so is one without a required word, if
    there are any. Of a value that occurs more often the first such place counts. Words are compared in lower case.
    """
    found = None
    plain = rows.select(key, F.coalesce(text, F.lit("")).alias("_text"))
    for pattern in patterns:
        one = plain.select(key, "_text", F.explode(match_places(F.col("_text"), pattern)).alias("m"))
        around = F.substr("_text", F.greatest(F.col("m.at") - margin, F.lit(0)) + 1, F.least(F.col("m.at"), F.lit(margin)) + F.length("m.value") + margin)
        one = one.select(key, "m.at", "m.value", F.trim(F.regexp_replace(around, r"(?U)\s+", " ")).alias("context"))
        found = one if found is None else found.union(one)
    low = F.lower("context")
    any_of = lambda xs: F.exists(F.array(*map(F.lit, xs)), lambda w: F.contains(low, w)) if xs else F.lit(False)
    good = any_of(words) & ~(any_of(list(barred)) & ~any_of(list(unless))) & (any_of(list(required)) if required else F.lit(True))
    return found.where(good).groupBy(key, "value").agg(F.min_by(F.struct("at", "context"), "at").alias("x")).select(key, "value", "x.at", "x.context")


def first_places(found: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """The first `most` values of each text; for reports."""
    return found.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("at", "value"))).where(F.col("rank") <= most)
