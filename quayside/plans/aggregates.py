"""Grouped, conditional and collapsing aggregates on the analogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions import status
from quayside.plans.registry import Tables, query

#: An order's line flag as the fact of a delivery.
FACT_SQL = "CASE l_returnflag WHEN 'R' THEN 'bounced' WHEN 'A' THEN 'accepted' ELSE 'queued' END"


def fact():
    return status.delivery_fact(F.when(F.col("l_returnflag") == "A", "sent").otherwise("sending"), F.col("l_returnflag") == "R")


@query(
    "AGG20", "AGG21", "AGG22", "AGG23", "AGG24", "AGG25", "AGG26", "AGG32", "JOI29", "PRJ17", "PRJ24", "PRJ25", "RDM12",
    sql=f"""
    WITH lines AS (SELECT l_suppkey, {FACT_SQL} AS fact, count(*) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2),
    facts AS (SELECT l_suppkey, max_by(fact, last) AS latest, CAST(sum(n) AS BIGINT) AS sends, CAST(sum(CASE WHEN fact = 'bounced' THEN n ELSE 0 END) AS BIGINT) AS bounced, CAST(sum(CASE WHEN fact = 'accepted' THEN n ELSE 0 END) AS BIGINT) AS accepted
              FROM (SELECT l_suppkey, fact, n, struct_pack(a := last, b := fact) AS last FROM lines) GROUP BY 1),
    rows AS (SELECT CASE WHEN s_nationkey % 3 <> 0 THEN 'company:' || CAST(s_nationkey AS VARCHAR) ELSE 'supplier:' || CAST(s_suppkey AS VARCHAR) END AS card, s.*, f.* FROM supplier s LEFT JOIN facts f ON l_suppkey = s_suppkey)
    SELECT card, count(*) AS members, max_by(s_name, struct_pack(a := (s_acctbal > 0)::INT, b := coalesce(sends, 0), c := -s_suppkey)) AS name,
           CAST(coalesce(sum(sends), 0) AS BIGINT) AS sends, CAST(coalesce(sum(bounced), 0) AS BIGINT) AS bounced, CAST(coalesce(sum(accepted), 0) AS BIGINT) AS accepted,
           CASE WHEN count(DISTINCT latest) = 0 THEN 'not_sent' WHEN count(DISTINCT latest) = 1 THEN max(latest) ELSE 'mixed' END AS delivery,
           CASE WHEN coalesce(sum(bounced), 0) > 0 THEN 'bounced' WHEN coalesce(sum(accepted), 0) > 0 THEN 'accepted' ELSE 'none' END AS strongest,
           bool_or(coalesce(s_acctbal < 0, false)) AS any_debt, bool_and(s_acctbal > 0) AS all_credit,
           array_to_string(list_sort(list(s_suppkey)), ',') AS suppliers
    FROM rows GROUP BY 1""",
)
def company_cards(t: Tables) -> DataFrame:
    """Host rows collapsed to company cards, delivery facts pre-aggregated before the join."""
    lines = t.lineitem.groupBy("l_suppkey", fact().alias("fact")).agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last"))
    count = lambda name: F.sum(F.when(F.col("fact") == name, F.col("n")).otherwise(0)).alias(name)
    facts = lines.groupBy("l_suppkey").agg(F.max_by("fact", F.struct("last", "fact")).alias("latest"), F.sum("n").alias("sends"), count("bounced"), count("accepted"))
    key = F.when(F.col("s_nationkey") % 3 != 0, F.concat(F.lit("company:"), F.col("s_nationkey").cast("string"))).otherwise(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")))
    rows = t.supplier.join(facts, F.col("l_suppkey") == F.col("s_suppkey"), "left").withColumn("card", key)
    primary = F.struct(F.col("s_acctbal") > 0, F.coalesce("sends", F.lit(0)), -F.col("s_suppkey"))
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    cards = rows.groupBy("card").agg(
        F.count("*").alias("members"),
        F.max_by("s_name", primary).alias("name"),
        total("sends"),
        total("bounced"),
        total("accepted"),
        status.card_label(F.collect_set("latest")).alias("delivery"),
        F.bool_or(F.col("s_acctbal") < 0).alias("any_debt"),
        F.bool_and(F.col("s_acctbal") > 0).alias("all_credit"),
        F.array_join(F.array_sort(F.collect_list("s_suppkey")).cast("array<string>"), ",").alias("suppliers"),
    )
    return cards.withColumn("strongest", status.strongest({k: F.col(k) for k in ("bounced", "accepted")}))


@query("AGG01", "AGG13", "AGG14", sql="SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def status_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("AGG02", "AGG10", "AGG11", sql="SELECT user_id, max(ts) AS last, count(*) FILTER (ts >= TIMESTAMP '2024-01-29 00:00:00') AS recent, min(ts) FILTER (ts >= TIMESTAMP '2024-01-29 00:00:00') AS oldest FROM events GROUP BY 1")
def last_contact_and_budget(t: Tables) -> DataFrame:
    recent = F.col("ts") >= F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last"), F.count_if(recent).alias("recent"), F.min(F.when(recent, F.col("ts"))).alias("oldest"))


@query("AGG03", "RDM21", sql="SELECT o_custkey, bool_or(o_orderstatus = 'P') AS unresolved, bool_and(o_orderstatus <> 'P') AS resolved FROM orders GROUP BY 1")
def flags_per_group(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("unresolved"), F.bool_and(F.col("o_orderstatus") != "P").alias("resolved"))


@query("AGG04", "AGG05", "AGG36", "PRJ04", "RDM29", sql="SELECT s_nationkey, count(DISTINCT nullif(lower(s_name), '')) AS names FROM supplier GROUP BY 1 HAVING count(*) > 1")
def groups_of_several(t: Tables) -> DataFrame:
    grouped = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count_distinct(F.nullif(F.lower("s_name"), F.lit(""))).alias("names"))
    return grouped.where("n > 1").select("s_nationkey", "names")


@query("AGG08", "AGG09", "AGG39", "AGG40", "RDM03", sql="SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase' AND value > 50) AS large, count(DISTINCT user_id) AS users, count(*) FILTER (value IS NULL) AS blank FROM events")
def kpi_tile(t: Tables) -> DataFrame:
    """All counters of a tile in one pass."""
    kind = F.col("event_type")
    return t.events.agg(
        F.count("*").alias("total"),
        F.count_if(kind == "error").alias("errors"),
        F.count_if((kind == "purchase") & (F.col("value") > 50)).alias("large"),
        F.count_distinct("user_id").alias("users"),
        F.count_if(F.col("value").isNull()).alias("blank"),
    )


@query("AGG15", "AGG16", "AGG17", "PRJ20", sql="""
    SELECT user_id, CAST(round_even(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 1) AS DOUBLE) AS mean_value,
    CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN round_even(100.0::DOUBLE * count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type = 'view'), 0) ELSE 0.0 END AS rate,
    CASE WHEN count(*) FILTER (event_type = 'error') > 14 THEN 'blacklisted' WHEN count(*) FILTER (event_type = 'purchase') > 14 THEN 'favorite' ELSE 'none' END AS relation FROM events GROUP BY 1""")
def means_and_rates(t: Tables) -> DataFrame:
    """Mean to one decimal and a percent, half to even; precedence of relations.

    Values become cents, and means tenths, by multiplying before rounding, as SQL does: bround() and the cast to decimal go by a double's
    shortest digits, which for 635.40 / 12 are 52.949999999999996.
    """
    cents = (F.round(F.col("value") * 100) / 100).cast("decimal(18,2)")
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    grouped = t.events.groupBy("user_id").agg((F.sum(cents).cast("double") / F.count("*")).alias("m"), n("purchase").alias("p"), n("view").alias("v"), n("error").alias("e"))
    relation = F.when(F.col("e") > 14, "blacklisted").when(F.col("p") > 14, "favorite").otherwise("none")
    return grouped.select("user_id", (F.rint(F.col("m") * 10) / 10).alias("mean_value"), status.percent(F.col("p"), F.col("v")).alias("rate"), relation.alias("relation"))


@query("AGG18", "AGG38", sql="SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS names, CAST(sum(n_nationkey) AS BIGINT) AS total, max(n_name) AS last FROM nation GROUP BY 1")
def sorted_sets(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"), F.sum("n_nationkey").alias("total"), F.max("n_name").alias("last"))


@query("AGG19", "AGG29", "RDM16", sql=f"SELECT l_orderkey, count(*) FILTER (f = 'accepted') AS accepted, count(*) FILTER (f = 'bounced') AS bounced, count(*) FILTER (f = 'queued') AS queued, count(DISTINCT f) AS kinds FROM (SELECT l_orderkey, {FACT_SQL} AS f FROM lineitem) GROUP BY 1")
def delivery_vector(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", fact().alias("f"))
    return rows.groupBy("l_orderkey").agg(*[F.count_if(F.col("f") == k).alias(k) for k in ("accepted", "bounced", "queued")], F.count_distinct("f").alias("kinds"))


@query("AGG27", "RDM09", "RDM10", sql="""
    SELECT c_custkey, coalesce(o.n, 0) AS orders, o.last AS last_order, coalesce(l.n, 0) AS lines, coalesce(l.returned, 0) AS returned, coalesce(e.n, 0) AS events, coalesce(e.errors, 0) AS errors
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) l ON l.o_custkey = c_custkey
    LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1) e ON e.user_id = c_custkey""")
def company_summary(t: Tables) -> DataFrame:
    """One pre-aggregate for each fact table, left-joined to the dimension."""
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("o_n"), F.max("o_orderdate").alias("last_order"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("k"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    lines = lines.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("l_key")).agg(F.sum("k").alias("l_n"), F.sum("r").alias("returned"))
    e = t.events.groupBy("user_id").agg(F.count("*").alias("e_n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    key = F.col("c_custkey")
    joined = t.customer.join(o, F.col("o_custkey") == key, "left").join(lines, F.col("l_key") == key, "left").join(e, F.col("user_id") == key, "left")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return joined.select("c_custkey", zero("o_n", "orders"), "last_order", zero("l_n", "lines"), zero("returned", "returned"), zero("e_n", "events"), zero("errors", "errors"))


@query("AGG30", sql="""
    WITH c AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS accepted, count(*) FILTER (event_type = 'error') AS unknown, count(*) FILTER (event_type = 'signup' AND value > 98) AS bounced FROM events GROUP BY 1)
    SELECT user_id, total, accepted, unknown, bounced, CASE WHEN bounced > 0 THEN 'hard_bounce' WHEN unknown / total > 0.25 THEN 'permanent_failure_rate' WHEN accepted / total > 0.1 AND unknown > 9 THEN 'delivery_unknown_rate' END AS pause, (total > 0 AND unknown = 0) AS complete FROM c""")
def campaign_funnel(t: Tables) -> DataFrame:
    """Funnel counters of each campaign and the first health threshold that is crossed."""
    kind = F.col("event_type")
    c = t.events.groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(kind == "purchase").alias("accepted"), F.count_if(kind == "error").alias("unknown"), F.count_if((kind == "signup") & (F.col("value") > 98)).alias("bounced")
    )
    rate = lambda name, over: F.when(F.col(name) / F.col("total") > over, 1.0).otherwise(0.0)
    late = F.when((F.col("unknown") > 9), rate("accepted", 0.1)).otherwise(0.0)
    zero = F.lit(0)
    pause = status.pause_reason(zero, F.col("bounced"), rate("unknown", 0.25), late, zero, zero, zero)
    return c.select("*", pause.alias("pause"), ((F.col("total") > 0) & (F.col("unknown") == 0)).alias("complete"))


@query("AGG31", "AGG37", sql="SELECT least(n, 4) AS bucket, count(*) AS groups FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def capped_histogram(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy(F.least("n", F.lit(4)).cast("long").alias("bucket")).agg(F.count("*").alias("groups"))


@query("AGG33", "RDM28", sql="SELECT source, count(*) AS raw, count(*) FILTER (n_chars >= 500) AS visible, count(DISTINCT CASE WHEN n_chars >= 500 THEN lang END) AS langs FROM documents GROUP BY 1")
def snapshot_counts(t: Tables) -> DataFrame:
    visible = F.col("n_chars") >= 500
    return t.documents.groupBy("source").agg(F.count("*").alias("raw"), F.count_if(visible).alias("visible"), F.count_distinct(F.when(visible, F.col("lang"))).alias("langs"))


@query("AGG34", "RDM30", "RDM31", sql="SELECT 'orders' AS relation, o_custkey AS id, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'events', user_id, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'lineitem', l_suppkey, count(*) FROM lineitem GROUP BY 2")
def relation_counts(t: Tables) -> DataFrame:
    """Counts of a key's rows in every relation, tagged."""
    one = lambda df, key, tag: df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).select(F.lit(tag).alias("relation"), "id", "n")
    return one(t.orders, "o_custkey", "orders").union(one(t.events, "user_id", "events")).union(one(t.lineitem, "l_suppkey", "lineitem"))


@query("AGG35", sql="SELECT count(*) AS domains, max(n) AS top, CAST(sum(n) AS BIGINT) AS total, (2 * max(n) >= sum(n)) AS dominated FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def dominant_share(t: Tables) -> DataFrame:
    n = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("domains"), F.max("n").alias("top"), F.sum("n").alias("total"), (2 * F.max("n") >= F.sum("n")).alias("dominated"))


@query("AGG41", "AGG42", "AGG45", sql="SELECT quality, count(*) AS n, count(*) FILTER (toxic = 1) AS wrong, CAST(count(*) FILTER (toxic = 0) AS DOUBLE) / count(*) AS accuracy FROM labels GROUP BY 1")
def label_scores(t: Tables) -> DataFrame:
    right = F.count_if(F.col("toxic") == 0)
    return t.labels.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("wrong"), (right.cast("double") / F.count("*")).alias("accuracy"))


@query("AGG43", sql="SELECT page_id, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '(?i)licen[sc]e')) AS markers, len(regexp_extract_all(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+')) AS emails FROM pages")
def page_metrics(t: Tables) -> DataFrame:
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return t.pages.select("page_id", n("<a ").alias("links"), n("(?i)licen[sc]e").alias("markers"), n(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+").alias("emails"))


@query("AGG44", "TXT97", sql="SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0 OR l_tax > 0 THEN CAST(CAST(l_discount AS DECIMAL(18,2)) + CAST(l_tax AS DECIMAL(18,2)) AS DOUBLE) END AS cost, coalesce(CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) >= 0 THEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) END, -1) AS term_days FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def cost_and_term(t: Tables) -> DataFrame:
    """A sum that is null when nothing is in it; the first valid difference of dates."""
    parts = F.filter(F.array(*[F.col(c).cast("decimal(18,2)") for c in ("l_discount", "l_tax")]), lambda x: x > 0)
    cost = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0).cast("decimal(20,2)"), lambda a, x: (a + x).cast("decimal(20,2)"))).cast("double")
    days = F.datediff("l_shipdate", "o_orderdate").cast("long")
    joined = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", cost.alias("cost"), F.coalesce(F.when(days >= 0, days), F.lit(-1)).alias("term_days"))
