"""Whose site it is: companies found in a registry by their numbers or their names, and proved by their contacts.

The registry is a table (inn, ogrn, name, site, emails). Names are found by an inverted index of words with weights
by rarity. A record answers a query if it has at least half the weight of the query's words, so it shares one of its
heaviest words, which together with the rest come to half; only these words are looked up, and frequent ones fall out by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.functions import company, mail
from quayside.functions.urls import root_domain
from quayside.operators.graphs import cut

#: How many candidates of a site are looked at, and the least weight of a proof.
BUDGET, ACCEPTED = 6, 60
#: Weight of a word that one record has.
RAREST = 1_000_000


def resolve_by_registration(found: DataFrame, registry: DataFrame) -> DataFrame:
    """host, inn, name, evidence, kind, number of each host, one of whose registration numbers (host, place, kind, value, score) the registry has.

    The number and the record's tax number must pass their checks; of several the highest score decides, then the first place.
    """
    good = found.where(company.valid_registration(F.col("value"))).withColumn("number", company.digits_only(F.col("value")))
    records = registry.where(company.valid_company_id(F.trim("inn"))).select(F.trim("ogrn").alias("number"), F.trim("inn").alias("inn"), "name")
    joined = good.join(records, "number")
    best = F.max_by(F.struct("inn", "name", F.col("kind").alias("evidence"), company.id_kind(F.col("inn")).alias("kind"), "number"), F.struct(F.coalesce("score", F.lit(0)), -F.col("place"), "inn"))
    return joined.groupBy("host").agg(best.alias("x")).select("host", "x.*")


def word_weights(records: DataFrame) -> DataFrame:
    """word, weight: the words of the records (inn, own), by rarity."""
    words = records.select("inn", F.explode("own").alias("word")).distinct()
    return words.groupBy("word").agg(F.call_function("div", F.lit(RAREST).cast("long"), F.count("*")).alias("weight"))


def name_candidates(queries: DataFrame, registry: DataFrame, budget: int = BUDGET) -> DataFrame:
    """host, inn, rank (to `budget`): records that answer a host's queries (host, place, query), earlier queries first.

    Within a query the greater weight comes first, then the shorter name, then the smaller number. Queries are answered in
    rounds, 1, 2, 4 and so on of each host: no record of a later query can rank before those of earlier ones, so a host with
    `budget` candidates is done, and the others go on until their queries end.
    """
    # dealt behind the words, which a checkpoint would else read twice
    records = cut(registry.select("inn", F.length("name").alias("length"), company.name_words(F.col("name")).alias("own")).repartition("inn"))
    asked = queries.repartition("host", "place").select("host", "place", F.explode(company.name_words(F.col("query"))).alias("word")).distinct().join(word_weights(records), "word")
    # a query's words: heaviest first, each with the weight that it and those behind it come to
    heavy = asked.groupBy("host", "place").agg(F.sort_array(F.collect_list(F.struct("weight", "word")), asc=False).alias("words"))  # the words of one query
    total = F.aggregate("words", F.lit(0).cast("long"), lambda n, x: n + x["weight"])
    heavy = cut(heavy.withColumn("total", total).withColumn("n", F.row_number().over(W.partitionBy("host").orderBy("place"))))
    behind = lambda i: F.aggregate(F.slice("words", i + 1, F.size("words")), F.lit(0).cast("long"), lambda n, x: n + x["weight"])
    needed = F.filter(F.transform("words", lambda x, i: F.struct(x["word"].alias("word"), behind(i).alias("behind"))), lambda x: 2 * x["behind"] >= F.col("total"))
    listed = records.withColumn("word", F.explode("own"))
    shared = F.filter("words", lambda x: F.array_contains("own", x["word"]))
    score = F.aggregate("shared", F.lit(0).cast("long"), lambda n, x: n + x["weight"])
    last = heavy.agg(F.max("n")).first()[0] or 0
    found, done, size = None, None, 1
    while size <= last:
        now = heavy.where((F.col("n") >= size) & (F.col("n") < 2 * size))
        now = now if done is None else now.join(done, now["host"].eqNullSafe(done["host"]), "left_anti")
        looked = now.select("host", "place", "words", "total", F.explode(needed).alias("x")).select("host", "place", "words", "total", "x.word")
        # a record is met at each word that it shares, and counts at the heaviest
        met = looked.join(listed, "word").withColumn("shared", shared).where(F.col("word") == F.col("shared")[0]["word"])
        answers = met.withColumn("score", score).where(2 * F.col("score") >= F.col("total"))
        at = answers.select("host", "inn", F.struct("place", (-F.col("score")).alias("score"), "length").alias("at"))
        first = (at if found is None else at.unionByName(found.select("host", "inn", "at"))).groupBy("host", "inn").agg(F.min("at").alias("at"))
        ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("host").orderBy("at", "inn")))
        found = cut(ranked.where(F.col("rank") <= budget))
        done = found.where(F.col("rank") == budget).select("host")
        size *= 2
        left = heavy.where(F.col("n") >= size)
        if left.join(done, left["host"].eqNullSafe(done["host"]), "left_anti").isEmpty():
            break
    if found is None:
        return heavy.join(records, F.lit(False)).select("host", "inn", F.lit(0).alias("rank"))
    return found.select("host", "inn", "rank")


def proof(host: Column, site: Column, emails: Column, known: Column) -> Column:
    return company.ownership(host, site, emails, known, mail.FREE_MAIL_DOMAINS)


def resolve_by_name(queries: DataFrame, known: DataFrame, registry: DataFrame, budget: int = BUDGET) -> DataFrame:
    """host, inn, name, evidence, kind: of each host's candidates the one with the strongest proof, the first of equal ones.

    known: host, known_email (one row a host, may be missing). Candidates without a proof of ACCEPTED or more do not count.
    """
    candidates = name_candidates(queries, registry, budget).join(registry.select("inn", "name", "site", "emails"), "inn").join(known, "host", "left")
    evidence = proof(F.col("host"), F.col("site"), F.col("emails"), F.coalesce("known_email", F.lit("")))
    proved = candidates.withColumn("evidence", evidence).withColumn("weight", company.evidence_weight(F.col("evidence"))).where(F.col("weight") >= ACCEPTED)
    best = proved.groupBy("host").agg(F.max_by(F.struct("inn", "name", "evidence", company.id_kind(F.col("inn")).alias("kind")), F.struct("weight", -F.col("rank"))).alias("x"))
    return best.select("host", "x.*")


def confirmed_backlog(known: DataFrame, registry: DataFrame) -> DataFrame:
    """known (host, inn) whose number is right and whose record the registry proves to be the site's, with the record's name and address.

    own_email is the first of the record's addresses on the site's own domain; no other is ever taken.
    """
    rows = known.where(company.valid_company_id(F.col("inn"))).join(registry.select("inn", "name", "site", "emails"), "inn")
    own = lambda e: root_domain(F.substring_index(F.lower(F.trim(e)), "@", -1)) == root_domain(F.col("host"))
    address = F.try_element_at(F.filter("emails", lambda e: F.contains(e, F.lit("@")) & own(e)), F.lit(1))
    rows = rows.withColumn("evidence", proof(F.col("host"), F.col("site"), F.col("emails"), F.lit("")))
    return rows.where("evidence <> 'none'").select("host", "inn", "name", "evidence", address.alias("own_email"))
