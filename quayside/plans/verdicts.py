"""Verdicts on contacts, hints of pages, clean-up of mail texts, checks of the store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions import company, matching, verdicts
from quayside.functions.messages import visible_text
from quayside.functions.urls import host_of
from quayside.plans.registry import Tables, query
from quayside.plans.relational import HOST_SQL

ADDRESS = r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"
SITE, OTHER = "kirpich.ru", "other.ru"
#: child, its key, parent, its key
RELATIONS = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
)


def told(v: Column) -> list[Column]:
    """A verdict's parts as plain columns."""
    return [F.array_join(v["passed"], ";").alias("passed"), F.array_join(v["failed"], ";").alias("failed"), v["sources"].alias("sources"), v["verified"].alias("verified")]


def listed(*cases: str) -> str:
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), ';')"


ADDRESS_FAILED = listed(
    f"CASE WHEN mx IS NULL THEN '{verdicts.MX_UNCHECKED}' WHEN NOT mx THEN '{verdicts.MX_MISSING}' END",
    f"CASE WHEN NOT own THEN '{verdicts.FOREIGN_DOMAIN}' END",
    f"CASE WHEN NOT ok THEN '{verdicts.SERVER_NO}' END",
    f"CASE WHEN technical THEN '{verdicts.TECHNICAL}' END",
)
ADDRESS_PASSED = listed(
    f"'{verdicts.SYNTAX}'",
    f"CASE WHEN mx THEN '{verdicts.MX_FOUND}' END",
    f"CASE WHEN own THEN '{verdicts.OWN_DOMAIN}' END",
    f"CASE WHEN second THEN '{verdicts.SECOND_SOURCE}' END",
    "CASE WHEN pages > 1 THEN 'встречается на ' || pages || ' страницах' END",
    f"CASE WHEN ok THEN '{verdicts.SERVER_YES}' END",
)


@query("TXT59", sql=f"""
    WITH a AS (SELECT doc_id, source, lower(unnest(regexp_extract_all(text, '{ADDRESS}'))) AS address FROM documents),
    g AS (SELECT address, count(DISTINCT doc_id) AS pages, count(DISTINCT source) > 1 AS second FROM a GROUP BY 1),
    r AS (SELECT *, CASE length(address) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS mx, CASE length(address) % 5 WHEN 0 THEN true WHEN 1 THEN false END AS ok, starts_with(address, 'a') AS technical,
          regexp_extract(split_part(address, '@', 2), '[^.]+[.][^.]+$') = 'example.com' AS own FROM g)
    SELECT address, {ADDRESS_PASSED} AS passed, {ADDRESS_FAILED} AS failed, CASE WHEN second THEN 2 ELSE 1 END AS sources, coalesce(mx, false) AND NOT technical AND coalesce(ok, true) AND (own OR second) AS verified FROM r""")
def address_verdicts(t: Tables) -> DataFrame:
    """Addresses of documents, with documents as pages and sources as second witnesses; servers' answers stand in by length."""
    found = t.documents.select("doc_id", "source", F.explode(F.transform(F.regexp_extract_all("text", F.lit(ADDRESS), F.lit(0)), lambda x: F.lower(x))).alias("address"))
    seen = found.groupBy("address", "doc_id").agg(F.min("source").alias("low"), F.max("source").alias("high"))
    seen = seen.groupBy("address").agg(F.count("*").alias("pages"), (F.min("low") != F.max("high")).alias("second"))
    n, address = F.length("address"), F.col("address")
    mx = F.when(n % 3 == 0, True).when(n % 3 == 1, False)
    accepted = F.when(n % 5 == 0, True).when(n % 5 == 1, False)
    verdict = verdicts.address_verdict(address, F.lit("www.example.com"), mx, F.col("second"), F.col("pages"), accepted, address.startswith("a"), F.lit(False))
    return seen.select("address", verdict.alias("v")).select("address", *told(F.col("v")))


NUMBER_FAILED = listed(
    f"CASE k % 3 WHEN 1 THEN '{verdicts.NOT_IN_REGISTRY}' WHEN 2 THEN '{verdicts.REGISTRY_UNCHECKED}' END",
    f"CASE WHEN own OR alike THEN NULL WHEN k % 4 > 1 AND k % 5 <> 2 THEN '{verdicts.UNKNOWN_OWNER}' ELSE 'контакты «' || name || '» ведут на другой домен — ИНН может принадлежать не владельцу {SITE}' END",
)
NUMBER_PASSED = listed(
    f"'{verdicts.CHECKSUM_YES}'",
    "CASE WHEN k % 3 = 0 THEN 'есть в реестре (' || name || ')' END",
    f"CASE WHEN own THEN '{verdicts.BY_DOMAIN}' WHEN alike THEN '{verdicts.BY_NAME}' END",
    "CASE WHEN pages > 1 THEN 'повторяется на ' || pages || ' страницах' END",
)


@query("TXT60", "TXT61", "TXT62", sql=f"""
    WITH r AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderkey % 3 AS pages, o_orderkey % 7 <> 0 AS good, o_orderkey % 4 = 0 OR o_orderkey % 5 = 0 AS own, o_orderkey % 2 = 0 AS alike,
                 CASE WHEN o_orderkey % 2 = 0 THEN 'ООО Кирпич' ELSE 'ООО Ромашка' END AS name FROM orders)
    SELECT k AS o_orderkey, CASE WHEN good THEN {NUMBER_PASSED} ELSE '' END AS passed, CASE WHEN good THEN {NUMBER_FAILED} ELSE '{verdicts.CHECKSUM_NO}' END AS failed,
           CASE WHEN good AND pages > 1 THEN 2 ELSE 1 END AS sources, good AND k % 3 = 0 AND (own OR alike OR s <> 'F') AS verified FROM r""")
def number_verdicts(t: Tables) -> DataFrame:
    """Verdicts on company numbers for one site; the registry's records are made from the order's key in every mixture."""
    k = F.col("o_orderkey")
    registry = F.when(k % 3 == 0, True).when(k % 3 == 1, False)
    name = F.when(k % 2 == 0, "ООО Кирпич").otherwise("ООО Ромашка")
    site = F.when(k % 4 == 0, f"https://www.{SITE}/about").when(k % 4 == 1, OTHER).otherwise("")
    one = lambda address: F.array(F.lit(address))
    emails = F.when(k % 5 == 0, one(f"a@{SITE}")).when(k % 5 == 1, one("x@mail.ru")).when(k % 5 == 2, one(f"y@{OTHER}")).otherwise(F.array().cast("array<string>"))
    method = F.when(F.col("o_orderstatus") == "F", "llm").otherwise("labeled")
    verdict = verdicts.number_verdict(k % 7 != 0, registry, name, method, F.lit(SITE), F.lit(""), k % 3, site, emails)
    return t.orders.select("o_orderkey", verdict.alias("v")).select("o_orderkey", *told(F.col("v")))


@query("TXT48", sql="SELECT page_id, array_to_string(list_filter([trim(regexp_extract(regexp_extract(html, '(?i)<title[^>]*>([^<]{3,200})</title>', 1), '[^|—–]*$'))], lambda x: length(x) BETWEEN 4 AND 40), ';') AS hints FROM pages")
def page_name_hints(t: Tables) -> DataFrame:
    """Name hints of pages; these pages have titles only, the other kinds are held by unit vectors."""
    return t.pages.select("page_id", F.array_join(verdicts.name_hints(F.col("html")), ";").alias("hints"))


@query("HLP14", sql=f"""
    WITH p AS (SELECT page_id, lower(html) AS h FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(h, '{verdicts.IMAGE}') THEN '{verdicts.MISSING["image"]}' WHEN regexp_matches(h, '<form[^>]*>') AND regexp_matches(h, '{verdicts.FORM_WORDS}') THEN '{verdicts.MISSING["form"]}'
        WHEN contains(h, '.pdf') AND regexp_matches(h, '{verdicts.PDF_WORDS}') THEN '{verdicts.MISSING["pdf"]}' WHEN len(regexp_extract_all(regexp_replace(h, '<[^>]+>', '', 'g'), '[^ \\t\\n\\r\\f\\x0b]+')) < {verdicts.FEW_WORDS} THEN '{verdicts.MISSING["js"]}'
        ELSE '{verdicts.MISSING["no_contacts_page"]}' END AS reason FROM p""")
def missing_reasons(t: Tables) -> DataFrame:
    return t.pages.select("page_id", verdicts.missing_reason(F.col("html")).alias("reason"))


@query("TXT70", "TXT71")
def css_free_texts(t: Tables) -> DataFrame:
    """Pages' sources as broken mail texts, with the page as HTML part."""
    return t.pages.select("page_id", verdicts.without_css(F.regexp_replace("html", "<[^>]*>", "\n"), F.col("html")).alias("text"))


@query("HLP21")
def labelled_truth(t: Tables) -> DataFrame:
    """For each host its pages, and the first valid number behind a label by order of URL: what a model is compared with."""
    found = t.pages.select(host_of(F.col("url")).alias("host"), "url", F.get(company.labelled_ids(visible_text(F.col("html"))), F.lit(0)).alias("number"))
    first = F.min(F.when(F.col("number").isNotNull(), F.struct("url", "number")))
    return found.groupBy("host").agg(F.count("*").alias("pages"), first.alias("x")).select("host", "pages", F.col("x.number").alias("number"), F.coalesce("x.url", F.lit("")).alias("source"))


def orphan_sql(child: str, key: str, parent: str, other: str) -> str:
    return f"SELECT '{child}.{key}' AS relation, count({key}) AS n_rows, count({key}) FILTER (WHERE {key} NOT IN (SELECT {other} FROM {parent} WHERE {other} IS NOT NULL)) AS n_orphans FROM {child}"


@query("RDM33", sql=" UNION ALL ".join(orphan_sql(*r) for r in RELATIONS))
def store_checks(t: Tables) -> DataFrame:
    """Rows of each relation and those whose parent is missing; children are counted by key before the join."""

    def one(child: str, key: str, parent: str, other: str) -> DataFrame:
        keys = getattr(t, child).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
        known = getattr(t, parent).select(F.col(other).alias("key"), F.lit(True).alias("known")).distinct()
        sums = keys.join(known, "key", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("n_orphans"))
        return sums.select(F.lit(f"{child}.{key}").alias("relation"), "n_rows", "n_orphans")

    return reduce(DataFrame.unionByName, [one(*r) for r in RELATIONS])


@query("TXT15", "TXT24", sql=f"""
    WITH a AS (SELECT doc_id, text, regexp_extract(text, '{ADDRESS}') AS address FROM documents), p AS (SELECT *, instr(lower(text), lower(address)) AS pos FROM a WHERE address <> '')
    SELECT doc_id, trim(regexp_replace(substr(text, greatest(1, pos - 90), pos - greatest(1, pos - 90) + length(address) + 90), '\\s+', ' ', 'g')) AS snippet FROM p""")
def address_snippets(t: Tables) -> DataFrame:
    """The text around each document's first address."""
    rows = t.documents.select("doc_id", "text", F.regexp_extract("text", ADDRESS, 0).alias("address")).where("address <> ''")
    return rows.select("doc_id", matching.snippet(F.col("text"), F.col("address")).alias("snippet"))
