"""Text and identity operators on documents, pages, parts and literal vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions import company, mail, matching, messages
from quayside.functions.urls import host_of, root_domain
from quayside.operators import extraction
from quayside.plans.registry import Tables, query
from quayside.plans.relational import HOST_SQL

ADDRESS_SQL = "regexp_extract_all(text, '[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\\.)+[A-Za-z]{2,24}')"


@query("TXT01", "HLP15", sql=f"SELECT page_id, {HOST_SQL} AS host FROM pages")
def page_hosts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", host_of(F.col("url")).alias("host"))


@query("TXT03", "TXT54", sql="SELECT p_partkey, CASE WHEN list_contains(string_split(lower(p_name), ' '), 'red') THEN p_name ELSE p_name || ' red' END AS query FROM part")
def search_queries(t: Tables) -> DataFrame:
    """A suffix is added unless the name says it already."""
    return t.part.select("p_partkey", matching.with_suffix(F.col("p_name"), F.lit("red")).alias("query"))


@query("TXT04", "TXT05", "TXT82", sql="SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_@.+-]+', ' ', 'g')) AS plain FROM documents")
def similarity_texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", messages.similarity_text(F.col("text")).alias("plain"))


@query("TXT07", "TXT47", sql="SELECT p_partkey, unnest([p_name, 'buy ' || p_name, p_name || ' wholesale']) AS query FROM part")
def query_variants(t: Tables) -> DataFrame:
    """Exact, commercial and wholesale variants of a position."""
    name = F.col("p_name")
    variants = F.array_distinct(F.array(name, F.concat(F.lit("buy "), name), F.concat(name, F.lit(" wholesale"))))
    return t.part.select("p_partkey", F.explode(variants).alias("query"))


@query("TXT08", "SRC09", sql="SELECT p_partkey, len(list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9][a-z0-9().,/_+-]*'), lambda x: length(x) > 1))) AS tokens FROM part")
def token_sets(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.size(matching.tokens(F.col("p_name"))).cast("long").alias("tokens"))


@query("TXT09", "TXT10", "TXT12", "SRT09", sql="""
    WITH w AS (SELECT p_partkey, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9][a-z0-9().,/_+-]*'), lambda x: length(x) > 1)) AS seen, ['steel', 'red', 'small'] AS goal FROM part),
    o AS (SELECT p_partkey, CAST(len(list_intersect(goal, seen)) AS DOUBLE) / 3 AS r FROM w)
    SELECT p_partkey, CASE WHEN r >= 0.8 THEN 'exact_match' WHEN r >= 0.55 THEN 'acceptable_analog' WHEN r >= 0.25 THEN 'near_match' ELSE 'unrelated' END AS match, CASE WHEN r >= 0.8 THEN least(1.0::DOUBLE, 0.72::DOUBLE + r * 0.18::DOUBLE) ELSE round_even(r, 3) END AS score,
           CASE WHEN r >= 0.55 THEN 'qualified' ELSE 'unqualified' END AS status FROM o""")
def product_matches(t: Tables) -> DataFrame:
    """Parts as offers for one position: match class, score and qualification."""
    m = matching.product_match(F.lit("steel red small"), F.col("p_name"))
    rows = t.part.select("p_partkey", m.alias("m"))
    return rows.select("p_partkey", "m.match", F.col("m.score").alias("score"), matching.qualification(F.lit("seller_offer"), F.col("m.match"), F.lit(1))["status"].alias("status"))


@query("TXT13", "TXT14", "TXT15", "TXT16", "TXT99", "SRT10", sql="SELECT doc_id, CAST(unnest(list_distinct(list_transform(regexp_extract_all(text, '\\+1 \\([0-9]{3}\\) [0-9]{3}-[0-9]{4}'), lambda x: '+' || regexp_replace(x, '[^0-9]', '', 'g')))) AS VARCHAR) AS phone FROM documents")
def phones_in_texts(t: Tables) -> DataFrame:
    """Telephone numbers of documents in one form."""
    found = F.regexp_extract_all("text", F.lit(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"), F.lit(0))
    return t.documents.select("doc_id", F.explode(F.array_distinct(F.transform(found, lambda x: matching.phone(x)))).alias("phone"))


@query("TXT18", "TXT21", "TXT24", "TXT53", "SET13", "AGG41", sql=f"""
    WITH a AS (SELECT doc_id, unnest(list_distinct(list_transform({ADDRESS_SQL}, lambda x: lower(trim(x, '.,;:!?)»"''<>(«[]{{}}'))))) AS address FROM documents)
    SELECT address, count(*) AS docs, min(doc_id) AS first_doc FROM a GROUP BY 1""")
def addresses_in_texts(t: Tables) -> DataFrame:
    """Valid addresses of documents, counted over them."""
    found = F.transform(F.regexp_extract_all("text", F.lit(mail.ADDRESS), F.lit(1)), lambda x: mail.canonical(x))
    rows = t.documents.select("doc_id", F.explode(F.array_distinct(found)).alias("address")).where(mail.rejection(F.col("address")).isNull())
    return rows.groupBy("address").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query("TXT28", "TXT27", "TXT59", "HLP17", sql=f"""
    WITH a AS (SELECT DISTINCT unnest(list_distinct(list_transform({ADDRESS_SQL}, lambda x: lower(x)))) AS address FROM documents)
    SELECT address, greatest(0, least(100, 25 + 25 - 25 + CASE WHEN regexp_matches(address, '^(?:info|sales|sale|zakaz|zakazy|order|orders|opt|office|mail|shop|market|sbyt|torg|trade|manager|contact|contacts|kontakt|secretary|priemnaya|post|client|clients|otdel|prodaji|prodazhi|supply|zayavka)[.+@]') THEN 10 ELSE 0 END)) AS score FROM a""")
def address_confidence(t: Tables) -> DataFrame:
    """Score of addresses found in text, on no page of their own, with a mail server."""
    found = F.transform(F.regexp_extract_all("text", F.lit(mail.ADDRESS), F.lit(1)), lambda x: F.lower(x))
    rows = t.documents.select(F.explode(found).alias("address")).distinct()
    score, _ = mail.confidence(F.col("address"), F.lit("text"), F.lit("site.ru"), F.lit(True), F.lit(False), F.lit(1), F.lit(False))
    return rows.select("address", score.alias("score"))


@query("TXT29", "TXT43", "HLP12", "HLP13", "TXT100", sql="SELECT page_id, regexp_matches(lower(url), 'contact|contacts|kontakt|kontakty|kontakti|kontaktyi|about|o-kompanii|o-nas|onas|company|firma|requisites|rekvizity|rekvisity|feedback|svyaz|svjaz|obratnaya-svyaz|napisat|write-us|impressum|podderzhka') AS contact FROM pages")
def contact_pages(t: Tables) -> DataFrame:
    return t.pages.select("page_id", mail.is_contact_page(F.col("url"), F.lit(None).cast("string")).alias("contact"))


def weights_sql(start: int, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"{w} * CAST(substr(n, {start + i}, 1) AS INTEGER)" for i, w in enumerate(weights)) + ") % 11 % 10"


@query("TXT30", "TXT31", "TXT33", "TXT34", "HLP01", "HLP20", sql=f"""
    SELECT id, n AS number, CASE WHEN length(n) = 10 THEN {weights_sql(1, company.WEIGHTS_10)} = CAST(substr(n, 10, 1) AS INTEGER) ELSE {weights_sql(1, company.WEIGHTS_11)} = CAST(substr(n, 11, 1) AS INTEGER) AND {weights_sql(1, company.WEIGHTS_12)} = CAST(substr(n, 12, 1) AS INTEGER) END AS valid,
    CASE WHEN length(n) = 10 THEN 'organization' ELSE 'individual' END AS kind
    FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(7700000000 + o_orderkey * 7919 AS VARCHAR) ELSE CAST(500100000000 + o_orderkey * 104729 AS VARCHAR) END AS n FROM orders)""")
def company_numbers(t: Tables) -> DataFrame:
    """Checksums of numbers derived from keys."""
    k = F.col("o_orderkey")
    n = F.when(k % 2 == 0, (F.lit(7700000000) + k * 7919).cast("string")).otherwise((F.lit(500100000000) + k * 104729).cast("string"))
    number = company.digits_only(n)
    return t.orders.select(k.alias("id"), number.alias("number"), company.valid_company_id(number).alias("valid"), company.id_kind(number).alias("kind"))


@query("TXT32", "TXT38", "TXT41", "TXT50", sql="SELECT o_orderkey, (CAST(substr(n, 1, 12) AS BIGINT) % 11 % 10 = CAST(substr(n, 13, 1) AS BIGINT)) AS valid FROM (SELECT o_orderkey, CAST(1027700000000 + o_orderkey * 7 AS VARCHAR) AS n FROM orders)")
def registration_numbers(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", company.valid_registration((F.lit(1027700000000) + F.col("o_orderkey") * 7).cast("string")).alias("valid"))


@query("TXT42", "TXT62", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE greatest(0, least(100, CASE o_orderstatus WHEN 'P' THEN 55 WHEN 'F' THEN 30 ELSE 20 END + 20 + CASE WHEN o_orderkey % 2 = 0 THEN 10 ELSE 0 END + CASE o_orderkey % 3 WHEN 0 THEN 25 WHEN 1 THEN -60 ELSE 0 END)) END AS score FROM orders")
def number_confidence(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    method = F.when(F.col("o_orderstatus") == "P", "labeled").when(F.col("o_orderstatus") == "F", "llm").otherwise("text")
    registry = F.when(k % 3 == 0, True).when(k % 3 == 1, False)
    score, _ = company.id_confidence(method, k % 7 != 0, registry, k % 2 == 0)
    return t.orders.select("o_orderkey", score.alias("score"))


@query("TXT35", "TXT69", "TXT72", "PRJ15", "RDM01")
def page_texts(t: Tables) -> DataFrame:
    """Visible text of pages, an approximation by patterns; operators.extraction has a parser."""
    return t.pages.select("page_id", messages.visible_text(F.col("html")).alias("text"))


@query("TXT25", "TXT26", "TXT36", "TXT37", "TXT39", "TXT40", "TXT44", "TXT45", "HLP18")
def page_contacts(t: Tables) -> DataFrame:
    """Addresses and company numbers of pages by every way of publishing them, merged for each host."""
    pages = t.pages.select(host_of(F.col("url")).alias("host"), "url", "html")
    return extraction.by_site(extraction.from_pages(pages))


@query("TXT49", "TXT51", "TXT60", "HLP09", "HLP10", sql=f"""
    WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), r AS (SELECT *, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS root FROM h)
    SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'site' WHEN page_id % 4 = 1 THEN 'email' WHEN page_id % 4 = 2 AND root NOT IN ('mail.ru') THEN 'domain' ELSE 'none' END AS evidence FROM r""")
def ownership_evidence(t: Tables) -> DataFrame:
    """How a registry record proves that a host is the company's: its site, a contact, its mail's domain, or not at all."""
    rows = t.pages.select("page_id", host_of(F.col("url")).alias("host"))
    k = F.col("page_id") % 4
    site = F.when(k == 0, F.concat(F.lit("https://www."), root_domain(F.col("host")))).otherwise("")
    emails = F.when(k == 1, F.array(F.lit("Known@mail.ru"))).when(k == 2, F.array(F.concat(F.lit("a@"), F.col("host")))).otherwise(F.array(F.lit("x@mail.ru")))
    return rows.select("page_id", company.ownership(F.col("host"), site, emails, F.lit("known@MAIL.ru"), mail.FREE_MAIL_DOMAINS).alias("evidence"))


@query("TXT52", sql="SELECT source, lang AS winner FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, max(n_chars) DESC, lang) AS n FROM documents GROUP BY 1, 2) WHERE n = 1")
def majority_vote(t: Tables) -> DataFrame:
    """The value that most rows of a group say, ties by the strongest row."""
    votes = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("own"))
    return votes.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("n"), -F.col("own"), F.col("lang"))).alias("winner"))


@query("TXT55", "TXT56", "PRJ26", sql="SELECT p_partkey, len(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: length(w) > 2))) AS words, regexp_matches(lower(p_name), '(^|[^a-z0-9])(red|steel)([^a-z0-9]|$)') AS matches FROM part")
def name_words(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.select("p_partkey", F.size(company.name_words(name)).cast("long").alias("words"), company.names_match(name, F.lit("OOO red steel")).alias("matches"))


@query("TXT46", "TXT57", "TXT58", sql="SELECT p_partkey, replace(replace(replace(p_brand, 'Brand', 'бранд'), 'x', 'кс'), '#', '#') AS cyrillic FROM part")
def transliterated(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", company.to_cyrillic(F.col("p_brand")).alias("cyrillic"))


@query("TXT63", sql="SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 11 OR p_size BETWEEN 13 AND 33 THEN 'manufacturer' WHEN p_size = 46 THEN 'wholesale' WHEN p_size = 47 THEN 'retail' WHEN p_size BETWEEN 41 AND 43 THEN 'contractor' ELSE 'other' END AS role FROM part")
def activity_roles(t: Tables) -> DataFrame:
    code = F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".1"))
    return t.part.select("p_partkey", company.activity_role(code).alias("role"))


@query("TXT64")
def trimmed_texts(t: Tables) -> DataFrame:
    """Windows around markers, overlapping ones merged; tested against a plain loop."""
    return t.documents.select("doc_id", extraction.windows_around(F.col("text"), "(?i)license|contact", 350, 6000).alias("kept"))


@query("TXT65", "TXT67", "TXT87", "AGG32", sql="SELECT doc_id, CASE WHEN NOT regexp_matches(source, '^src1') THEN NULL WHEN regexp_matches(text, '(?i)550|551|553') THEN 'hard' ELSE 'soft' END AS bounce FROM documents")
def bounce_kinds(t: Tables) -> DataFrame:
    """Documents of some sources read as bounces."""
    sender = F.when(F.col("source").startswith("src1"), "mailer-daemon@x").otherwise("a@b.ru")
    return t.documents.select("doc_id", messages.bounce_kind(sender, F.lit(""), F.col("text")).alias("bounce"))


@query("TXT66", "JOI24", sql="SELECT c_custkey, lower(c_name) || '@site.ru' AS failed FROM (SELECT c_custkey, replace(c_name, '#', '-') AS c_name FROM customer)")
def failed_recipients(t: Tables) -> DataFrame:
    body = F.concat(F.lit("Hello\n<"), F.replace("c_name", F.lit("#"), F.lit("-")), F.lit("@site.ru>: host said 550"))
    return t.customer.select("c_custkey", F.explode(messages.failed_recipients(body)).alias("failed"))


@query("TXT75")
def own_text(t: Tables) -> DataFrame:
    """Each turn without what it quotes; one that is all quotation stays whole. Tested against a plain loop."""
    own = messages.without_quotes(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.when(F.btrim(own, F.lit(" \t\r\n")) != "", own).otherwise(F.coalesce("text", F.lit(""))).alias("own"))


@query("TXT74", sql="SELECT page_id, regexp_matches(html, '(?i)<img[^>]+src=[^>]*http') AS remote FROM pages")
def remote_images(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.col("html").rlike(r"(?i)<img[^>]+src=[^>]*http").alias("remote"))


@query("TXT76", "HLP08", sql="SELECT item_id, array_to_string(list_filter([CASE WHEN length(s) > 160 THEN 'subject_too_long' END, CASE WHEN len(regexp_extract_all(s, '\\p{Lu}')) > 0.85 * len(regexp_extract_all(s, '\\p{L}')) THEN 'subject_all_caps' END], lambda x: x IS NOT NULL), ',') AS warnings FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN upper(text) ELSE text END AS s FROM benchmark)")
def subject_quality(t: Tables) -> DataFrame:
    text = F.when(F.col("item_id") % 2 == 0, F.upper("text")).otherwise(F.col("text"))
    _, warnings = messages.subject_quality(text)
    return t.benchmark.select("item_id", F.array_join(warnings, ",").alias("warnings"))


@query("TXT77", "TXT86", sql="SELECT doc_id, array_to_string(list_filter([CASE WHEN len(regexp_extract_all(text, '(?i)https?://')) > 5 THEN 'too_many_links' END, CASE WHEN length(text) > 12000 THEN 'large_body' END], lambda x: x IS NOT NULL), ',') AS warnings FROM documents")
def body_quality(t: Tables) -> DataFrame:
    _, warnings = messages.body_quality(F.col("text"), F.lit(True), F.lit(False))
    return t.documents.select("doc_id", F.array_join(warnings, ",").alias("warnings"))


@query("TXT78", "TXT79", "TXT80", "HLP04", "HLP06", sql="SELECT s_suppkey, 'Dear ' || s_name || ' of ' || n_name || ', {{odd}}' AS body, 2 AS level FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def personalised(t: Tables) -> DataFrame:
    template = F.lit("Dear {{ supplier_name }} of {{supplier_city}}, {{odd}}")
    rows = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    body = messages.personalised(template, {"supplier_name": F.col("s_name"), "supplier_city": F.col("n_name")})
    return rows.select("s_suppkey", body.alias("body"), messages.personalisation_level(F.col("s_name"), F.col("n_name"), F.lit(False)).alias("level"))


@query("TXT81")
def similarity_shares(t: Tables) -> DataFrame:
    """Share of each conversation's turns that are much like its first one."""
    return extraction.similarity_share(t.conversations, ["conv_id"], "turn", "text")


@query("TXT83", "TXT84", sql="SELECT event_id, CASE event_type WHEN 'error' THEN 'authentication' WHEN 'purchase' THEN 'provider-throttling' WHEN 'click' THEN 'recipient-invalid' ELSE event_type END AS class FROM events")
def error_classes(t: Tables) -> DataFrame:
    code = F.when(F.col("event_type") == "error", "535").when(F.col("event_type") == "purchase", "451").when(F.col("event_type") == "click", "550").otherwise(F.col("event_type"))
    return t.events.select("event_id", messages.provider_error(code, F.lit(""), F.lit(False), F.lit(False)).alias("class"))


@query("TXT85", "TRN22", sql="SELECT card, CASE WHEN n = 1 THEN 'primary' WHEN pos > 0 THEN 'alternate' ELSE 'skip' END AS choice FROM (SELECT s_nationkey AS card, count(*) AS n, count(*) FILTER (s_acctbal > 0) AS pos FROM supplier GROUP BY 1)")
def contact_choice(t: Tables) -> DataFrame:
    grouped = t.supplier.groupBy(F.col("s_nationkey").alias("card")).agg(F.count("*").alias("n"), F.count_if(F.col("s_acctbal") > 0).alias("pos"))
    return grouped.select("card", F.when(F.col("n") == 1, "primary").when(F.col("pos") > 0, "alternate").otherwise("skip").alias("choice"))


@query("TXT94", "TXT95", "TXT96", sql="SELECT o_custkey, sha256(array_to_string(list_sort(list(o_orderkey)), ',')) AS fingerprint FROM orders GROUP BY 1")
def fingerprints(t: Tables) -> DataFrame:
    """A digest of a set that does not depend on its order."""
    keys = F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",")
    return t.orders.groupBy("o_custkey").agg(F.sha2(keys, 256).alias("fingerprint"))


@query("TXT22", "TXT23", "TXT19", "TXT20")
def hidden_addresses(t: Tables) -> DataFrame:
    """Addresses hidden by hex or words, rebuilt from each supplier's name; the result must be the address itself."""
    address = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@site.ru"))
    worded = F.replace(F.replace(address, F.lit("@"), F.lit(" (at) ")), F.lit("."), F.lit(" [dot] "))
    return t.supplier.select("s_suppkey", address.alias("address"), mail.plain_obfuscation(worded).alias("plain"), mail.repaired(F.replace(address, F.lit("."), F.lit(","))).alias("repaired"), mail.split_addresses(F.concat(address, F.lit("; "), address)).alias("parts"))


