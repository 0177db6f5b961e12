"""Read models, transitions and display projections that the other modules do not cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.functions import mail, matching, status
from quayside.functions.urls import host_of
from quayside.operators.joins import with_marker
from quayside.plans.registry import Tables, query


@query("PRJ14", "JOI08", "RDM01", sql="SELECT e.event_id FROM events e WHERE event_type IN ('view', 'click') OR (event_type = 'error' AND EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.value > 90))")
def visible_messages(t: Tables) -> DataFrame:
    """A visibility rule: some kinds always, others only with evidence, which is joined as a marker."""
    proof = t.events.where("event_type = 'purchase' and value > 90")
    rows = with_marker(t.events, proof, ["user_id"], "proven")
    return rows.where(F.col("event_type").isin("view", "click") | ((F.col("event_type") == "error") & F.col("proven"))).select("event_id")


@query("PRJ16", "PRJ17", sql="SELECT event_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'accepted' WHEN 'signup' THEN 'failed' ELSE 'unknown' END AS label FROM events")
def status_labels(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_type") == "view", "sending").when(F.col("event_type") == "click", "sent").when(F.col("event_type") == "signup", "failed").otherwise(F.col("event_type"))
    return t.events.select("event_id", status.delivery_fact(raw, F.lit(False)).alias("label"))


@query("PRJ18", "HLP02", sql="SELECT c_custkey, substr(lower(c_name), 1, 1) || '***@site.ru' AS masked FROM customer")
def masked(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", status.masked_address(mail.normalised(F.concat(F.lit("  "), F.col("c_name"), F.lit("@Site.ru ")))).alias("masked"))


@query("PRJ19", "SRC23", sql="SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_mktsegment = 'BUILDING' THEN c_mktsegment || ':' || CAST(c_acctbal < 0 AS VARCHAR) END AS registry FROM customer")
def optional_struct(t: Tables) -> DataFrame:
    """A sub-object that is there only if one of its facts is."""
    known = (F.col("c_acctbal") < 0) | (F.col("c_mktsegment") == "BUILDING")
    rows = t.customer.select("c_custkey", F.when(known, F.struct(F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") < 0).alias("debt"))).alias("r"))
    return rows.select("c_custkey", F.when(F.col("r").isNotNull(), F.concat("r.segment", F.lit(":"), F.col("r.debt").cast("string"))).alias("registry"))


@query("PRJ21", "PRJ22", "PRJ23", "RDM08", sql="""
    WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN p > 0 AND f = 0 THEN 'problem' WHEN p > 0 THEN 'attention' WHEN f > 3 THEN 'answered' WHEN f > 0 THEN 'waiting' ELSE 'not_sent' END AS status, (p > 0) AS needs_attention, (p = 0 AND f > 0) AS awaiting FROM c""")
def thread_status(t: Tables) -> DataFrame:
    """One label of several facts, in order of precedence, and the predicates of the list's tabs."""
    c = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    p, f = F.col("p"), F.col("f")
    label = F.when((p > 0) & (f == 0), "problem").when(p > 0, "attention").when(f > 3, "answered").when(f > 0, "waiting").otherwise("not_sent")
    return c.select("o_custkey", label.alias("status"), (p > 0).alias("needs_attention"), ((p == 0) & (f > 0)).alias("awaiting"))


@query("PRJ27", sql="SELECT event_id, CASE date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE CASE WHEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') < 7 THEN 'week' ELSE 'older' END END AS bucket FROM events")
def relative_dates(t: Tables) -> DataFrame:
    days = F.datediff(F.lit("2024-01-30").cast("date"), F.to_date("ts"))
    return t.events.select("event_id", F.when(days == 0, "today").when(days == 1, "yesterday").when(days < 7, "week").otherwise("older").alias("bucket"))


@query("SRC06", "RDM11", "RDM13", "RDM22", sql="SELECT p_partkey, p_name, coalesce(nullif(p_size % 3, 0), 1) AS depth FROM part WHERE p_partkey = 7")
def point_lookup(t: Tables) -> DataFrame:
    """One row by key; the filter reaches the scan."""
    return t.part.where("p_partkey = 7").select("p_partkey", "p_name", F.coalesce(F.nullif(F.col("p_size") % 3, F.lit(0)), F.lit(1)).alias("depth"))


@query("SRC11", "SRC13", "SRC14", sql="SELECT host, min(page_id) AS first FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages) GROUP BY 1")
def first_seen_hosts(t: Tables) -> DataFrame:
    return t.pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.min("page_id").alias("first"))


@query("SRC21", sql="SELECT source, CASE WHEN CAST(substr(source, 4) AS INTEGER) % 3 = 0 THEN true WHEN CAST(substr(source, 4) AS INTEGER) % 3 = 1 THEN false END AS mx, count(*) AS n FROM documents GROUP BY 1")
def tri_state_lookup(t: Tables) -> DataFrame:
    """A dimension looked up by left join: true, false, or null for not known."""
    k = F.substring("source", 4, 9).cast("int")
    known = t.documents.select("source", k.alias("k")).distinct().where("k % 3 < 2").select("source", (F.col("k") % 3 == 0).alias("mx"))
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).join(known, "source", "left").select("source", "mx", "n")


@query("SRC32", "AGG23", sql="SELECT s AS source, count(*) AS pages, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT source AS s, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5 GROUP BY 1")
def merged_pages(t: Tables) -> DataFrame:
    """A landing page and at most four more of a site, merged."""
    first = t.documents.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("r <= 5")
    return first.groupBy("source").agg(F.count("*").alias("pages"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("SRC34", "SRC36", "SRC37", "SRC38", sql="SELECT source AS host, array_to_string(list(doc_id ORDER BY n_chars DESC, doc_id) FILTER (n_chars >= 2000), ', ') AS high, array_to_string(list(doc_id ORDER BY n_chars DESC, doc_id) FILTER (n_chars < 2000 AND n_chars >= 1000), ', ') AS medium, array_to_string(list(doc_id ORDER BY n_chars DESC, doc_id) FILTER (n_chars < 1000), ', ') AS low FROM documents GROUP BY 1")
def site_report(t: Tables) -> DataFrame:
    from quayside.sources.sinks import site_report as report

    n = F.col("n_chars")
    level = F.when(n >= 2000, "high").when(n >= 1000, "medium").otherwise("low")
    hits = t.documents.select(F.col("source").alias("host"), n.alias("score"), F.col("doc_id").alias("email"), level.alias("confidence"))
    return report(hits).select("host", *[F.when(F.col(x) != "", F.col(x)).alias(x) for x in ("high", "medium", "low")])


@query("TXT11", sql="SELECT page_id, regexp_extract(html, '<title>([^<]{1,180})', 1) AS title, contains(lower(html), 'lang=\"fr\"') AS regional FROM pages")
def seller_names(t: Tables) -> DataFrame:
    """The name a page gives itself, and whether a region's mark stands in it."""
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]{1,180})", 1).alias("title"), F.contains(F.lower("html"), F.lit('lang="fr"')).alias("regional"))


HAS_SQL = "len(list_filter({}, lambda w: contains(lower(coalesce(text, '')), w))) > 0"


@query("TXT98", "TXT101", sql=f"""
    SELECT item_id, 'https://s.example/find?q=' || replace(url_encode(coalesce(text, '')), '%20', '+') AS url,
           {HAS_SQL.format(matching.BUYER_MARKERS)} AND NOT {HAS_SQL.format(matching.SELLER_MARKERS)} AS buyer_only FROM benchmark""")
def search_urls(t: Tables) -> DataFrame:
    """The address of a search for each text, and whether only a buyer's words stand in it."""
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    # Spark leaves * and encodes ~, the other way round than the form encoding of the reference
    encoded = F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return t.benchmark.select("item_id", F.concat(F.lit("https://s.example/find?q="), encoded).alias("url"), (has(matching.BUYER_MARKERS) & ~has(matching.SELLER_MARKERS)).alias("buyer_only"))


@query("TXT90", "TRN18", "TRN19", "TRN20", "TRN09", sql="SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND l.n IS NULL THEN 'failed_before_data' WHEN o_orderstatus = 'P' AND l.r > 0 THEN 'resolved' WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'unchanged' END AS resolution FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def reconciliation(t: Tables) -> DataFrame:
    """What evidence says about rows whose outcome is open."""
    proof = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    open_ = F.col("o_orderstatus") == "P"
    label = F.when(open_ & F.col("n").isNull(), "failed_before_data").when(open_ & (F.col("r") > 0), "resolved").when(open_, "unknown").otherwise("unchanged")
    return t.orders.join(proof, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", label.alias("resolution"))


@query("RDM02", "TRN01", sql="SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, max_by(role, turn) AS last_role FROM conversations GROUP BY 1")
def conversations(t: Tables) -> DataFrame:
    """A conversation's turns in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(turns, lambda x: x["role"]), ">").alias("roles"), F.max_by("role", "turn").alias("last_role"))


@query("RDM06", "TRN17", "TRN21", sql="SELECT e.event_id, e.ts FROM events e JOIN (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'error' GROUP BY 1) f ON f.user_id = e.user_id AND e.ts > f.t AND e.event_type = 'signup'")
def superseding_events(t: Tables) -> DataFrame:
    """Events that follow the first failure of their key."""
    first = t.events.where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("t"))
    return t.events.where("event_type = 'signup'").join(first, "user_id").where("ts > t").select("event_id", "ts")


@query("RDM24", "RDM25", "RDM26", "RDM34", "TRN11", "TRN14", sql="SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_nationkey < 5 THEN 0 ELSE 1 END, s_suppkey) AS place FROM supplier WHERE s_acctbal > 0")
def ranked_accounts(t: Tables) -> DataFrame:
    """Active accounts in order of provider rank: places within ranges of keys, each behind the rows of all ranges before it."""
    rank = F.when(F.col("s_nationkey") < 5, 0).otherwise(1)
    # a range holds so many keys at most, so the window's groups are bounded and there are as many of them as the data needs
    rows = t.supplier.where("s_acctbal > 0").select("s_suppkey", rank.alias("rank"), F.floor(F.col("s_suppkey") / 100_000).alias("range"))
    sizes = rows.groupBy("rank", "range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("rank", "range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(W.partitionBy("rank", "range").orderBy("s_suppkey")) + F.col("before")
    return rows.join(before, ["rank", "range"]).select("s_suppkey", place.cast("long").alias("place"))


@query("RDM27", "TRN06", sql="SELECT event_id, user_id, 'event' AS entity, '{\"type\":\"' || event_type || '\",\"user\":' || CAST(user_id AS VARCHAR) || '}' AS details FROM events")
def audit_rows(t: Tables) -> DataFrame:
    """Audit records with their details as JSON."""
    details = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")))
    return t.events.select("event_id", "user_id", F.lit("event").alias("entity"), details.alias("details"))


@query("RDM32", sql="SELECT 'lineitem' AS relation, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def integrity(t: Tables) -> DataFrame:
    """Rows that refer to nothing, by relation."""
    a = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count("*").alias("orphans"))
    b = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count("*").alias("orphans"))
    return a.select(F.lit("lineitem").alias("relation"), "orphans").union(b.select(F.lit("orders").alias("relation"), "orphans"))


@query("HLP05", "HLP16", sql="SELECT s_suppkey, upper(substr(trim(s_name), 1, 12)) AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ',' || s_name || '!' ELSE s_name END AS contacts FROM supplier")
def normalised_suppliers(t: Tables) -> DataFrame:
    """Inputs cut to length; contacts given as a list or as one string."""
    name = F.col("s_name")
    listed = F.when(F.col("s_suppkey") % 2 == 0, F.array(name, F.concat(name, F.lit("!")))).otherwise(F.array(name))
    return t.supplier.select("s_suppkey", F.upper(F.substring(F.trim(name), 1, 12)).alias("name"), F.array_join(listed, ",").alias("contacts"))
