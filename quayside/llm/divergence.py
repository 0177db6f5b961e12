"""Source divergence audit: how far each source's words lie from those of the other sources of its language.

Plain relations. Matches of the term pattern are exploded and counted for each (lang, source, term); a language keeps
the terms of at least `least_docs` documents. Its sources are crossed with these terms, so that a term which a source
never uses counts zero there; smoothed shares of a thousand million become whole numbers, and a self-join on language
and term sums each pair's divergence. Windows rank the pairs, and the terms that a source uses more than its language.

All arithmetic is in whole numbers: shares by decimals of 38 digits; (p - q)^2 is 10^18 at most, and its sum over a
language's terms below 2 * 10^18, since shares add up to 10^9 before one is added to each.

Defined results: null text, lang and source are read as ''; a row is a document, so repeated rows and rows of one id
count each; a group without terms still gets its pairs (value 0 where the language keeps no term); ties rank by the
item's UTF-8 bytes; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.llm.common import few, table, written

#: Letters, once A to Z are lower-cased, and all that is not ASCII. It says what a term has, as the class of all that it
#: has not ([^\x00-\x40\x5B-\x60\x7B-\x7F]+) takes Java's matcher six times as long.
TERM = r"[a-z\x{80}-\x{10FFFF}]+"
LEAST_DOCS, TOP = 3, 200
SHARES = 1_000_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts in which a group's terms are ranked first, and over which a language's terms meet its sources.
PARTS = 32


def term_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents): counted where they stand before anything is shuffled."""
    read = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    text = read(text_column)
    # an ASCII text is lower-cased as a whole, others A to Z only
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    terms = F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))
    rows = docs.select(read(lang_column).alias("lang"), read(source_column).alias("source"), terms.alias("terms"))
    twice = F.array(F.struct(F.lit(0).alias("once"), F.col("terms").alias("of")), F.struct(F.lit(1).alias("once"), F.array_distinct("terms").alias("of")))
    each = rows.select("lang", "source", F.explode(twice).alias("x")).select("lang", "source", "x.once", F.explode("x.of").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / (total + terms)), exactly."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", whole(n + 1) * F.lit(SHARES), whole(total + terms))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = written(term_counts(docs, text_column, lang_column, source_column), "terms")
    read = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    groups = docs.select(read(lang_column).alias("lang"), read(source_column).alias("source")).distinct()
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    vocabulary = written(vocabulary.select("lang", "term", "lang_n"), "vocabulary")
    kept = written(counts.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]), "kept")

    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    sizes = written(sizes.select("lang", "source", F.monotonically_increasing_id().alias("number"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")), "sizes")
    pairs = pair_values(vocabulary, kept, sizes)
    ranked = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return pairs.union(top_terms(kept, sizes, top))


def pair_values(vocabulary: DataFrame, kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language), value. Sources go by their number until they are named again."""
    # crossed in parts, so that no language is met in one task; a list of sources that is short is broadcast
    places = sizes.where("terms > 0").select("lang", "number", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    zeros = vocabulary.withColumn("part", F.pmod(F.hash("term"), F.lit(PARTS))).join(few(places), ["lang", "part"]).select("lang", "term", "number", F.lit(0).cast("long").alias("n"))
    counted = kept.join(few(sizes.select("lang", "source", "number")), ["lang", "source"]).select("lang", "term", "number", "n")
    # by language and term from here on: neither the sums nor the self-join deals the rows again
    dense = zeros.union(counted).repartition("lang", "term")
    dense = dense.groupBy("lang", "term", "number").agg(F.sum("n").alias("n")).join(few(sizes.select("number", "total", "terms")), "number")
    dense = dense.select("lang", "term", "number", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    other = dense.select("lang", "term", F.col("number").alias("other"), F.col("p").alias("q"))
    # two sources meet once in a term, which gives the sums of both directions
    met = dense.join(other, ["lang", "term"]).where("number < other")
    both = met.groupBy("number", "other").agg(F.sum(distance(F.col("p"), F.col("q"))).alias("there"), F.sum(distance(F.col("q"), F.col("p"))).alias("back"))
    way = lambda a, b, value: F.struct(F.col(a).alias("number"), F.col(b).alias("other"), F.col(value).alias("value"))
    sums = both.select(F.explode(F.array(way("number", "other", "there"), way("other", "number", "back"))).alias("x")).select("x.*")
    names = sizes.select("lang", "source", "number")
    every = names.join(few(names.select("lang", F.col("source").alias("item"), F.col("number").alias("other"))), "lang").where("number <> other")
    return every.join(sums, ["number", "other"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def top_terms(kept: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """The terms whose share in the group exceeds that in the language, by divergence, to rank `top`."""
    sized = kept.join(few(sizes), ["lang", "source"])
    shared = sized.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    above = shared.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    # a group's first in each part, then the first of these: no task ranks all terms of a large group
    first = F.row_number().over(W.partitionBy("lang", "source", F.pmod(F.hash("item"), F.lit(PARTS))).orderBy(*order))
    above = above.withColumn("rank", first).where(F.col("rank") <= top).drop("rank")
    ranked = above.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
