"""Language identification by Bayesian evidence fusion.

The log-posterior of a language is the sum of: the text's tempered log-likelihood under hashed byte trigrams;
the log-likelihood of the declared (markup) language; that of the address suffix; and the log-prior of the host.
The trigram model is fitted on at most SAMPLE labelled rows a language, chosen by hash. Declaration and suffix
likelihoods and host priors come from grouped counts over all rows, by the language that the text alone suggests;
host priors are smoothed towards those of their suffixes, these towards the whole. Hosts, declared values and suffixes are
joined, never collected, and none is left out. Texts are scored once; what is joined are rows of one number a language. Every label is a language; the driver and each worker hold the trigram
table, 128 KB a language, and rows carry one number a language, so memory and time grow with the labels.

A document is kept if its best language has a posterior of MIN_POSTERIOR or more and its text has letters.
Defined results: a null or letterless text has no text evidence and is rejected; null declaration, host or address
is no evidence, a null host having the whole's prior; ties go to the language first by name; repeated rows are
rows; with no labelled rows or an empty table there are no languages, and every row is rejected with a null one;
other columns are not looked at, and what `keep` names is passed on in _row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.llm.common import small_batches, table, written
from quayside.llm.hashing import LOWER, blocks

SAMPLE, BUCKETS = 500, 1 << 14
MIN_POSTERIOR = 0.5
#: Neighbouring trigrams say much the same: a text counts as at most this many independent ones.
EFFECTIVE = 60.0
SMOOTHING = 20.0

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the byte trigrams within a row that hold a letter; A-Z lower-cased."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low = LOWER[data].astype(np.uint32)
    letter = LETTER[data]
    good = (rows[:-2] == rows[2:]) & (letter[:-2] | letter[1:-1] | letter[2:])
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64)
    return bucket[good], rows[:-2][good]


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages by name, log-probabilities by language and bucket) from columns label, text."""
    hashed = labelled.where("label is not null and text is not null").withColumn("h", F.xxhash64("text"))
    # a share of the hashes small enough to hold a little over the sample, so few texts move; copies count once
    labels = hashed.groupBy("label").agg(F.approx_count_distinct("h").alias("n"))
    sizes = {r.label: r.n for r in labels.collect()}
    share = lambda n: int(min(1.0, 2.0 * sample / n) * 2**31)
    if not sizes:
        return [], np.zeros((0, BUCKETS))
    limit = F.try_element_at(F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, share(max(n, 1)))]), F.col("label"))
    few = hashed.where(F.pmod("h", F.lit(2**31)) < limit).groupBy("label", "h").agg(F.first("text").alias("text"))
    picked = few.withColumn("n", F.row_number().over(W.partitionBy("label").orderBy(F.pmod("h", F.lit(2**31)), "h"))).where(F.col("n") <= sample).select("label", "text")

    def run(batches):
        for batch in batches:
            for label in set(batch.column(0).to_pylist()):
                counts = np.zeros(BUCKETS, dtype=np.int64)
                mine = batch.filter(pc.equal(batch.column(0), label))
                for _, _, data, offsets in blocks(mine.column(1), 1 << 18):
                    counts += np.bincount(trigrams(data, offsets)[0], minlength=BUCKETS)
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), pa.string()), pa.array(some), pa.array(counts[some])], ["label", "bucket", "n"])

    found = picked.mapInArrow(run, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.label for r in found})
    place = {label: i for i, label in enumerate(languages)}
    counts = np.full((len(languages), BUCKETS), 0.5)
    for r in found:
        counts[place[r.label], r.bucket] += r.n
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True))


def text_evidence(model, n_languages: int):
    """An Arrow UDF: text -> tempered log-likelihoods, empty where the text has no letters."""

    @F.arrow_udf("array<double>")
    def likelihoods(texts: pa.Array) -> pa.Array:
        table_ = model.value
        out: list = []
        for first, end, data, offsets in blocks(texts, 1 << 18):
            bucket, row = trigrams(data, offsets)
            n = np.bincount(row, minlength=end - first).astype(float)
            sums = np.stack([np.bincount(row, weights=table_[j][bucket], minlength=end - first) for j in range(n_languages)]) if n_languages else np.zeros((0, end - first))
            scaled = sums * np.where(n > EFFECTIVE, EFFECTIVE / np.maximum(n, 1), 1.0)
            out += [scaled[:, i].tolist() if n[i] else [] for i in range(end - first)]
        return pa.array(out, pa.list_(pa.float64()))

    return likelihoods


def declared_in(html: Column) -> Column:
    """The language that a page's html tag declares, without region, or null."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html(?=[\s>])[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label of a host that has several."""
    return F.nullif(F.regexp_extract(host, r"\.([A-Za-z]{2,})$", 1), F.lit(""))


def evidence_key(declared: Column, host: Column, address: Column, text: Column) -> Column:
    """What the evidence of a row is known by: rows alike in all of it have the same result."""
    return F.struct(F.xxhash64(declared, host, address, text).alias("h"), F.hash(text, address, host, declared).alias("g"))


def identify(docs: DataFrame, declared: Column | None = None, host: Column | None = None, address: Column | None = None, text: Column | None = None, label: Column | None = None, keep: Column | None = None, sample: int = SAMPLE, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """_row (the value of keep for each row), _key, language, posterior, kept.

    text, label (to fit the text model), declared language, host and address (its suffix counts) are columns of docs. keep
    should be thin, such as an id: texts are read once to be scored and take no part in what follows. Without it,
    _row is null. _key is evidence_key(), by which rows can be found again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    null = F.lit(None).cast("string")
    text = F.col("text") if text is None else text
    pick = lambda c: (null if c is None else c).cast("string")
    row = null if keep is None else keep
    key = evidence_key(pick(declared), pick(host), pick(address), text)
    languages, logs = fit(docs.select(pick(label if label is not None else declared).alias("label"), text.alias("text")), sample)
    if not languages:
        return docs.select(row.alias("_row"), key.alias("_key"), null.alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("kept"))
    n = len(languages)
    evidence = text_evidence(spark.sparkContext.broadcast(logs), n)
    # a column that only the scoring reads, then none of the text: one number a language goes on
    thin = docs.select(
        row.alias("_row"), key.alias("_key"), pick(declared).alias("_declared"), pick(host).alias("_host"), suffix_of(pick(address if address is not None else host)).alias("_suffix"), evidence(text).alias("_ll")
    )
    rows = written(thin, "scored")
    guesses = rows.where(F.size("_ll") > 0).select("_host", "_suffix", "_declared", (F.array_position("_ll", F.array_max("_ll")) - 1).cast("int").alias("guess"))
    spread = written(guesses.groupBy("_host", "_suffix", "_declared", "guess").agg(F.count("*").alias("k")), "languages")
    said, unsaid = _weighted(spread, "_declared", n)
    ends, unended = _weighted(spread, "_suffix", n)
    prior, whole = host_priors(spread, n)
    # many rows share these, so each combination is joined once and then met by its rows
    asked = rows.select("_host", "_declared", "_suffix").distinct()
    joined = asked.join(prior, "_host", "left").join(said, "_declared", "left").join(ends, "_suffix", "left")
    zero = F.array(*[F.lit(0.0)] * n)
    parts = [F.coalesce(F.col("_prior"), F.array(*[F.lit(math.log(x)) for x in whole])), _said("_declared", unsaid, zero), _said("_suffix", unended, zero)]
    beside = F.array(*[sum((p[j] for p in parts[1:]), parts[0][j]) for j in range(n)])
    joined = joined.select(F.xxhash64("_host", "_declared", "_suffix").alias("_h"), "_host", "_declared", "_suffix", beside.alias("_beside"))
    met = rows.withColumn("_h", F.xxhash64("_host", "_declared", "_suffix")).alias("r").join(
        joined.alias("j"), (F.col("r._h") == F.col("j._h")) & F.col("r._host").eqNullSafe(F.col("j._host")) & F.col("r._declared").eqNullSafe(F.col("j._declared")) & F.col("r._suffix").eqNullSafe(F.col("j._suffix"))
    )
    said_by_text = F.when(F.size("_ll") > 0, F.col("_ll")).otherwise(zero)
    total = F.zip_with("_beside", said_by_text, lambda a, b: a + b)
    scored = met.select("_row", "_key", "_ll", total.alias("_total")).withColumn("_top", F.array_max("_total"))
    posterior = 1 / F.aggregate("_total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    names = F.array(*map(F.lit, languages))
    return scored.select(
        "_row",
        "_key",
        F.element_at(names, F.array_position("_total", F.col("_top")).cast("int")).alias("language"),
        posterior.alias("posterior"),
        ((F.size("_ll") > 0) & (posterior >= min_posterior)).alias("kept"),
    )


def host_priors(spread: DataFrame, n: int) -> tuple[DataFrame, list[float]]:
    """(_host and its log-prior, the whole's prior) from counts k by _host, _suffix and guess.

    A host's counts, under all its suffixes together, are smoothed towards the prior of its suffix, this one towards the
    whole. A host seen with several suffixes is smoothed towards their priors' mean, weighted by its rows.
    """
    whole = [1.0] * n
    for r in spread.groupBy("guess").agg(F.sum("k").alias("k")).collect():
        whole[r.guess] += r.k
    whole = [x / sum(whole) for x in whole]
    by_guess = lambda name: [F.sum(F.when(F.col("guess") == j, F.col("k")).otherwise(0)).alias(f"{name}{j}") for j in range(n)]
    smooth = lambda own, total, back: (own + SMOOTHING * back) / (total + SMOOTHING)
    ends = spread.where("_suffix is not null").groupBy("_suffix").agg(F.sum("k").alias("s_total"), *by_guess("s"))
    ends = ends.select("_suffix", F.array(*[smooth(F.col(f"s{j}"), F.col("s_total"), whole[j]) for j in range(n)]).alias("_back"))
    parts = spread.where("_host is not null").groupBy("_host", "_suffix").agg(F.sum("k").alias("total"), *by_guess("k")).join(ends, "_suffix", "left")
    back = F.coalesce(F.col("_back"), F.array(*map(F.lit, whole)))
    hosts = parts.groupBy("_host").agg(F.sum("total").alias("total"), *[F.sum(f"k{j}").alias(f"k{j}") for j in range(n)], *[F.sum(back[j] * F.col("total")).alias(f"b{j}") for j in range(n)])
    prior = F.array(*[F.log(smooth(F.col(f"k{j}"), F.col("total"), F.col(f"b{j}") / F.col("total"))) for j in range(n)])
    return hosts.select("_host", prior.alias("_prior")), whole


def _weighted(counted: DataFrame, column: str, n: int) -> tuple[DataFrame, list[float]]:
    """(table of each value of the column and its log P(value | language), the same of a value not met), from counts k by guess."""
    seen = counted.where(F.col(column).isNotNull())
    values = seen.select(F.count_distinct(column)).first()[0]
    total = [values + 1.0] * n  # each value, and one for all that were not met, counts one more than seen
    for r in seen.groupBy("guess").agg(F.sum("k").alias("k")).collect():
        total[r.guess] += r.k
    found = seen.groupBy(column).agg(*[F.sum(F.when(F.col("guess") == j, F.col("k")).otherwise(0)).alias(f"k{j}") for j in range(n)])
    logs = F.array(*[F.log((F.col(f"k{j}") + 1.0) / F.lit(total[j])) for j in range(n)])
    return found.select(column, logs.alias(f"{column}_logs")), [-math.log(x) for x in total]


def _said(column: str, unmet: list[float], zero: Column) -> Column:
    """The value's log-likelihoods; none of them counts where it is null."""
    return F.when(F.col(column).isNull(), zero).otherwise(F.coalesce(F.col(f"{column}_logs"), F.array(*map(F.lit, unmet))))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = identify(docs, declared=F.col("lang"), host=F.col("source"), keep=F.col("doc_id"))
    return found.select(F.col("_row").alias("doc_id"), "language", F.round("posterior", 6).alias("posterior"), "kept")


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on web pages, with all kinds of evidence: text, the html tag's language, host and address suffix."""
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    found = identify(pages, declared=declared_in(F.col("html")), host=host_of(F.col("url")), text=bare, keep=F.col("page_id"))
    return found.select(F.col("_row").alias("page_id"), "language", F.round("posterior", 6).alias("posterior"), "kept")
