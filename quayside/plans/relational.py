"""Projections, predicates, joins, sorts and set operations on the analogue tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.functions.urls import host_of, root_domain, url_key
from quayside.operators.joins import latest_overlap, latest_per_key, sliced_join, suffix_anti_join, suffix_flag, with_marker
from quayside.plans.registry import Tables, query

#: Domains of the block list in the demonstrations.
BLOCKED = ["example.org", "ththth.example.net", "therha.example.com"]
HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '')"


@query(
    "PRJ01", "PRJ02", "PRJ03", "JOI01", "JOI02", "JOI03", "AGG06",
    sql="""
    SELECT o.o_orderkey, coalesce(c.c_name, '') AS customer, coalesce(n.n_name, '') AS nation, coalesce(r.r_name, 'none') AS region,
           coalesce(l.lines, 0) AS lines, coalesce(l.shipped, 0) AS returned_lines, coalesce(l.parts, 0) AS parts,
           coalesce(nullif(o.o_orderpriority, ''), c.c_mktsegment, '-') AS label
    FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal >= 0
    LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS shipped, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
    """,
)
def request_overview(t: Tables) -> DataFrame:
    """A wide projection over companion tables with defaults, children counted before the join."""
    children = t.lineitem.groupBy("l_orderkey").agg(
        F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("shipped"), F.count_distinct("l_partkey").alias("parts")
    )
    customers = t.customer.where("c_acctbal >= 0")  # the condition of ON: unmatched orders stay
    joined = (
        t.orders.join(customers, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
        .join(children, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    )
    return joined.select(
        "o_orderkey",
        F.coalesce("c_name", F.lit("")).alias("customer"),
        F.coalesce("n_name", F.lit("")).alias("nation"),
        F.coalesce("r_name", F.lit("none")).alias("region"),
        F.coalesce("lines", F.lit(0)).alias("lines"),
        F.coalesce("shipped", F.lit(0)).alias("returned_lines"),
        F.coalesce("parts", F.lit(0)).alias("parts"),
        F.coalesce(F.nullif("o_orderpriority", F.lit("")), "c_mktsegment", F.lit("-")).alias("label"),
    )


@query(
    "PRJ06", "PRJ07", "PRJ12", "SRC05",
    sql="SELECT s_suppkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE lower(s_name || ' ' || n_name || ' ' || CAST(s_suppkey AS VARCHAR)) LIKE '%7%' AND s_acctbal > 0",
)
def text_search(t: Tables) -> DataFrame:
    """Free-text filter over several columns, with optional predicates folded into one."""
    term, floor, nation = "7", 0, None
    searched = F.lower(F.concat_ws(" ", "s_name", "n_name", F.col("s_suppkey").cast("string")))
    wanted = [searched.contains(term)] + ([F.col("s_acctbal") > floor] if floor is not None else []) + ([F.col("s_nationkey") == nation] if nation is not None else [])
    return t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).where(reduce(lambda a, b: a & b, wanted)).select("s_suppkey", "s_name")


@query("PRJ05", "SRT03", sql="SELECT o_orderpriority, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS rank, count(*) AS n FROM orders GROUP BY 1, 2")
def status_rank(t: Tables) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.groupBy("o_orderpriority", rank.alias("rank")).agg(F.count("*").alias("n")).orderBy("rank", "o_orderpriority")


@query("PRJ09", sql="SELECT doc_id, source FROM documents WHERE NOT (lower(source) LIKE 'src1%') AND NOT (lower(source) LIKE 'src2%')")
def prefix_exclusion(t: Tables) -> DataFrame:
    return t.documents.where(~F.lower(F.coalesce("source", F.lit(""))).rlike("^src[12]")).select("doc_id", "source")


@query("PRJ10", "PRJ13", "WIN09", sql="SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' OR (ts >= TIMESTAMP '2024-01-20 06:00:00' AND ts < TIMESTAMP '2024-01-20 18:00:00')")
def day_and_range(t: Tables) -> DataFrame:
    """Typed day and range predicates instead of text prefixes."""
    day = F.to_date("ts") == F.lit("2024-01-15").cast("date")
    window = (F.col("ts") >= F.lit("2024-01-20 06:00:00").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-20 18:00:00").cast("timestamp_ntz"))
    return t.events.where(day | window).select("event_id", "user_id")


@query("PRJ11", sql="SELECT s.s_suppkey, count(*) AS peers FROM supplier s JOIN supplier p ON nullif(s.s_nationkey % 5, 0) IS NOT DISTINCT FROM nullif(p.s_nationkey % 5, 0) AND s.s_nationkey = p.s_nationkey GROUP BY 1")
def null_safe_peers(t: Tables) -> DataFrame:
    """Equality in which null equals null."""
    keyed = t.supplier.select("s_suppkey", "s_nationkey", F.nullif(F.col("s_nationkey") % 5, F.lit(0)).alias("k"))
    # peers are counted once a key; a pair of rows is never made
    sizes = keyed.groupBy(F.col("k").alias("p_k"), F.col("s_nationkey").alias("p_nation")).agg(F.count("*").alias("peers"))
    return keyed.join(sizes, F.col("k").eqNullSafe(F.col("p_k")) & (F.col("s_nationkey") == F.col("p_nation"))).select("s_suppkey", "peers")


@query("JOI04", sql="SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey LEFT JOIN orders o ON o.o_custkey = coalesce(s.s_suppkey, c.c_custkey + 1) GROUP BY 1")
def join_on_coalesced_key(t: Tables) -> DataFrame:
    """A join whose key depends on what an earlier join found; children are counted first."""
    counts = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    first = t.customer.join(t.supplier, F.col("s_suppkey") == F.col("c_custkey"), "left").withColumn("k", F.coalesce("s_suppkey", F.col("c_custkey") + 1))
    return first.join(counts, F.col("o_custkey") == F.col("k"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("JOI05", "JOI06", "JOI07", sql="SELECT r_name, n_name, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def five_way_chain(t: Tables) -> DataFrame:
    """Inner joins over five tables; Catalyst orders them and broadcasts the small ones by their size."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("k"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"))
    joined = lines.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    named = joined.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return named.groupBy("r_name", "n_name").agg(F.sum("k").alias("lines"), F.sum("s").cast("double").alias("total"))


@query("JOI08", sql="SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("JOI09", "AGG07", sql="SELECT user_id, count(*) AS unread FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'purchase' AND r.value > 90) GROUP BY 1")
def anti_join_counts(t: Tables) -> DataFrame:
    """Messages without a read marker, counted for each key."""
    read = t.events.where("event_type = 'purchase' and value > 90").select("user_id")
    return t.events.where("event_type = 'view'").join(read, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("unread"))


@query("JOI10", sql="SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R')")
def anti_join_after_inner(t: Tables) -> DataFrame:
    bad = t.orders.join(t.lineitem.where("l_returnflag = 'R'").select("l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return t.customer.join(bad, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


def hosts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "url", host_of(F.col("url")).alias("host"))


@query("PRJ08", "JOI11", "JOI13", "SRC07", "HLP22", sql=f"SELECT page_id, host FROM (SELECT page_id, {HOST_SQL} AS host FROM pages) p WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('example.org'), ('ththth.example.net'), ('therha.example.com')) b(d) WHERE p.host = d OR ends_with(p.host, '.' || d))")
def suffix_exclusion(t: Tables) -> DataFrame:
    """Pages whose host is no blocked domain and below none: an equi join on the host's suffixes."""
    blocked = t._spark.createDataFrame([(d,) for d in BLOCKED], "domain string")
    return suffix_anti_join(hosts(t).select("page_id", "host"), "host", blocked, "domain")


@query("JOI12", sql=f"SELECT page_id, host, EXISTS (SELECT 1 FROM (VALUES ('example.org'), ('ththth.example.net'), ('therha.example.com')) b(d) WHERE p.host = d OR ends_with(p.host, '.' || d)) AS blocked FROM (SELECT page_id, {HOST_SQL} AS host FROM pages) p")
def suffix_flagging(t: Tables) -> DataFrame:
    blocked = t._spark.createDataFrame([(d,) for d in BLOCKED], "domain string")
    return suffix_flag(hosts(t).select("page_id", "host"), "host", blocked, "domain", "blocked")


@query("JOI14", "JOI17", "JOI18", "RDM19", sql="SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS large, (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) OR c_acctbal < 0) AS gated FROM customer")
def exists_flags(t: Tables) -> DataFrame:
    """EXISTS as marker joins, and their disjunction."""
    key = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    rows = with_marker(t.customer, key.where("o_orderstatus = 'P'"), ["c_custkey"], "pending")
    rows = with_marker(rows, key.where("o_totalprice > 300000"), ["c_custkey"], "large")
    return rows.select("c_custkey", "pending", "large", (F.col("pending") | F.col("large") | (F.col("c_acctbal") < 0)).alias("gated"))


@query("JOI15", "JOI16", "WIN01", "WIN03", "RDM23", sql="SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_order(t: Tables) -> DataFrame:
    """The latest row of each key, ties on id."""
    return latest_per_key(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderstatus"])


@query("JOI15", sql="SELECT user_id FROM (SELECT user_id, max_by(event_type, event_id) AS last FROM events GROUP BY 1) WHERE last = 'error'")
def latest_attempt_failed(t: Tables) -> DataFrame:
    """A two-level correlated top-1 as one pre-aggregate."""
    return t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last")).where("last = 'error'").select("user_id")


@query("JOI19", "JOI20", sql="SELECT a.c_custkey, b.s_suppkey FROM customer a JOIN supplier b ON lower(trim(right(a.c_name, 4))) = lower(trim(right(b.s_name, 4)))")
def normalised_key_join(t: Tables) -> DataFrame:
    """Keys are normalised once, then joined by equality."""
    norm = lambda c: F.lower(F.trim(F.substring(c, -4, 4)))
    a = t.customer.select("c_custkey", norm("c_name").alias("k"))
    return a.join(t.supplier.select("s_suppkey", norm("s_name").alias("k")), "k").select("c_custkey", "s_suppkey")


@query("JOI21", "RDM20", sql="SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_tax > 0.079) OR s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) OR s_acctbal < 0")
def suppressed_by_any(t: Tables) -> DataFrame:
    """Three semi-join branches, united by key."""
    s = t.supplier
    one = s.join(t.lineitem.where("l_tax > 0.079"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    two = s.join(t.nation.where("n_regionkey = 0"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
    return one.union(two).union(s.where("s_acctbal < 0")).select("s_suppkey").distinct()


@query("JOI22", "TXT68", sql=r"""
    WITH tok AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(text, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+'), lambda x: x <> '')) AS token FROM benchmark),
    p AS (SELECT a.item_id AS item_id, b.item_id AS other_id, count(*) AS shared FROM tok a JOIN tok b ON a.token = b.token AND a.item_id <> b.item_id GROUP BY 1, 2)
    SELECT item_id, max(other_id) AS other_id, max_by(shared, other_id) AS shared FROM p GROUP BY 1""")
def token_overlap_pairs(t: Tables) -> DataFrame:
    """For each row the latest other one that shares a token of a header-like list."""
    tokens = F.filter(F.split("text", r"(?U)[\s\x1c-\x1f]+"), lambda x: x != "")
    return latest_overlap(t.benchmark, "item_id", tokens, "other_id")


@query("JOI23", "JOI24", "JOI25", "SRT06", sql="""
    SELECT conv_id, turn, match, rnk FROM (SELECT c.conv_id, c.turn, CASE WHEN o.turn = c.turn - 1 THEN 'exact' ELSE 'domain' END AS match,
    row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY CASE WHEN o.turn = c.turn - 1 THEN 0 ELSE 1 END, o.turn DESC) AS rnk
    FROM conversations c JOIN conversations o ON o.conv_id = c.conv_id AND o.turn < c.turn AND o.role = 'user') WHERE rnk <= 2""")
def ranked_candidates(t: Tables) -> DataFrame:
    """Candidates of each row, exact ones before near ones, then the latest; the two best."""
    c = t.conversations.select("conv_id", "turn")
    o = t.conversations.where("role = 'user'").select("conv_id", F.col("turn").alias("o_turn"))
    exact = F.col("o_turn") == F.col("turn") - 1
    pairs = c.join(o, "conv_id").where("o_turn < turn").withColumn("match", F.when(exact, "exact").otherwise("domain"))
    order = W.partitionBy("conv_id", "turn").orderBy(F.when(exact, 0).otherwise(1), F.col("o_turn").desc())
    return pairs.withColumn("rnk", F.row_number().over(order).cast("long")).where("rnk <= 2").select("conv_id", "turn", "match", "rnk")


@query("JOI26", "JOI27", sql="SELECT e.event_id, coalesce(c.c_name, s.s_name) AS owner FROM events e LEFT JOIN customer c ON e.event_type = 'view' AND c.c_custkey = e.user_id LEFT JOIN supplier s ON e.event_type <> 'view' AND s.s_suppkey = e.user_id")
def polymorphic_owner(t: Tables) -> DataFrame:
    """The owner's table depends on a discriminator."""
    view = F.col("event_type") == "view"
    joined = t.events.join(t.customer, view & (F.col("c_custkey") == F.col("user_id")), "left").join(t.supplier, ~view & (F.col("s_suppkey") == F.col("user_id")), "left")
    return joined.select("event_id", F.coalesce("c_name", "s_name").alias("owner"))


@query("JOI28", sql="SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size = s_nationkey AND list_contains([s_suppkey % 5, s_suppkey % 7], p_partkey % 8)")
def array_membership_join(t: Tables) -> DataFrame:
    """Equality on one key, then membership in a list of the other row.

    Membership is equality with one of the list's distinct values, so no pair is met in vain. The result grows with the square of the
    tables, as asked: its tasks grow in number, not in size.
    """
    p = t.part.select("p_partkey", F.col("p_size").alias("key"), (F.col("p_partkey") % 8).alias("value"))
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("key"), F.explode(F.array_distinct(F.array(F.col("s_suppkey") % 5, F.col("s_suppkey") % 7))).alias("value"))
    return sliced_join(p, s, ["key", "value"]).select("p_partkey", "s_suppkey")


@query("JOI30", "JOI31", "JOI32", sql="SELECT c_custkey, CASE WHEN o.o_custkey IS NULL THEN 'no orders' WHEN o.late IS NULL THEN 'no pending' ELSE 'complete' END AS missing FROM customer LEFT JOIN (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS late FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey")
def missing_companion(t: Tables) -> DataFrame:
    """Which attribute of a row's companion is missing."""
    have = t.orders.groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "P", 1)).alias("late"))
    label = F.when(F.col("o_custkey").isNull(), "no orders").when(F.col("late").isNull(), "no pending").otherwise("complete")
    return t.customer.join(have, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", label.alias("missing"))


@query("JOI34", "TXT88", "TXT89", "TXT92", "RDM18", "TRN16", sql="""
    SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN o.n IS NULL THEN 'no_orders' END, CASE WHEN o.p > 0 THEN 'pending_order' END, CASE WHEN r.n > 2 THEN 'many_returns' END], lambda x: x IS NOT NULL), ',') AS reasons,
           (c_acctbal >= 0 AND o.n IS NOT NULL AND o.p = 0 AND coalesce(r.n, 0) <= 2) AS eligible
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1) r ON r.o_custkey = c_custkey""")
def exclusion_reasons(t: Tables) -> DataFrame:
    """Every gate is one left join on the key; the verdict is whether no gate gave a reason."""
    orders = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    returns = t.orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("r_key")).agg(F.count("*").alias("r"))
    rows = t.customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").join(returns, F.col("r_key") == F.col("c_custkey"), "left")
    gates = [(F.col("c_acctbal") < 0, "negative_balance"), (F.col("n").isNull(), "no_orders"), (F.col("p") > 0, "pending_order"), (F.col("r") > 2, "many_returns")]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in gates]))
    return rows.select("c_custkey", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("eligible"))


@query("SRT01", "SRT02", "SRT04", "RDM15", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def recent_orders(t: Tables) -> DataFrame:
    """Top-k is the feature: the limit is clamped to 1..100."""
    limit = max(1, min(500, 100))
    return t.orders.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(limit).select("o_orderkey", "o_totalprice")


@query("SRT05", "SRT07", "SRT08", sql="SELECT source, arg_max(doc_id, (n_chars >= 500)::INT * 1e15 + n_chars * 1e7 - doc_id) AS best_doc FROM documents GROUP BY 1")
def best_member(t: Tables) -> DataFrame:
    """The best row of a group by a struct of keys."""
    return t.documents.groupBy("source").agg(F.max_by("doc_id", F.struct(F.col("n_chars") >= 500, F.col("n_chars"), -F.col("doc_id"))).alias("best_doc"))


@query("SRT09", "SRT10", "SRT11", "WIN12", sql="SELECT p_brand, p_partkey, rnk FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rnk FROM part) WHERE rnk <= 3")
def top_n_per_group(t: Tables) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")).cast("long")
    return t.part.withColumn("rnk", rank).where("rnk <= 3").select("p_brand", "p_partkey", "rnk")


@query("SRT12", "SRT13", "SRT14", sql="SELECT s_suppkey, s_name, coalesce(n, 0) AS n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def sorted_suppliers(t: Tables) -> DataFrame:
    """Three sort keys, the name in Russian collation order last."""
    n = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    rows = t.supplier.join(n, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.orderBy(F.col("n").desc(), F.collate("s_name", "ru"), "s_suppkey")


@query("SET01", "SET02", sql="SELECT key, kind FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t DESC, source DESC, id DESC) AS rn FROM (SELECT o_custkey AS key, 'order' AS kind, o_orderdate AS t, 0 AS source, o_orderkey AS id FROM orders UNION ALL SELECT user_id, event_type, ts, 1, event_id FROM events)) WHERE rn = 1")
def latest_of_two_sources(t: Tables) -> DataFrame:
    """Two event sources united, the latest of each key."""
    orders = t.orders.select(F.col("o_custkey").alias("key"), F.lit("order").alias("kind"), F.col("o_orderdate").alias("at"), F.lit(0).alias("source"), F.col("o_orderkey").alias("id"))
    events = t.events.select(F.col("user_id").alias("key"), F.col("event_type").alias("kind"), F.col("ts").alias("at"), F.lit(1).alias("source"), F.col("event_id").alias("id"))
    both = orders.unionByName(events)
    return both.groupBy("key").agg(F.max_by("kind", F.struct("at", "source", "id")).alias("kind"))


@query("SET03", "RDM07", sql="SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT -s_suppkey - 1, s_name, 'supplier' FROM supplier")
def aligned_union(t: Tables) -> DataFrame:
    """Two aligned projections; the second gets negative ids."""
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    return a.unionByName(t.supplier.select((-F.col("s_suppkey") - 1).alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind")))


@query("SET04", "UPS01", "UPS15", "UPS18", "UPS23", sql="SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def append_absent(t: Tables) -> DataFrame:
    """Synthetic rows only for keys that the first source lacks."""
    absent = t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", F.lit(-1).alias("quality"))
    return t.labels.select("doc_id", "quality").unionByName(absent)


@query("SET05", "SET06", "SET07", "SET08", sql="""
    SELECT p_partkey, list_has_any(w, ['STEEL', 'steel', 'blue', 'green']) AS overlaps, len(list_filter(['red'], lambda x: NOT list_contains(w, x))) = 0 AS contains, len(list_distinct(list_concat(w, ['new', 'red']))) AS united
    FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def array_sets(t: Tables) -> DataFrame:
    """Overlap, containment and ordered union of lists."""
    words = F.split("p_name", " ")
    lit = lambda *xs: F.array(*map(F.lit, xs))
    return t.part.select(
        "p_partkey",
        F.arrays_overlap(words, lit("STEEL", "steel", "blue", "green")).alias("overlaps"),
        (F.size(F.array_except(lit("red"), words)) == 0).alias("contains"),
        F.size(F.array_union(words, lit("new", "red"))).cast("long").alias("united"),
    )


@query("SET09", "SET10", "SET12", "WIN14", "HLP15", sql=f"""
    SELECT page_id, pos FROM (SELECT page_id, host, row_number() OVER (PARTITION BY k ORDER BY page_id) AS rn, row_number() OVER (PARTITION BY host ORDER BY page_id) AS pos
    FROM (SELECT page_id, {HOST_SQL} AS host, rtrim(regexp_replace(url, '#.*$', ''), '/') AS k FROM pages)) WHERE rn = 1""")
def url_dedup(t: Tables) -> DataFrame:
    """Search results without repeats of a URL, positions counted before the dedup."""
    rows = hosts(t).withColumn("k", url_key(F.col("url")))
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("host").orderBy("page_id")).cast("long"))
    first = rows.groupBy("k").agg(F.min_by(F.struct("page_id", "pos"), "page_id").alias("r"))
    return first.select("r.page_id", "r.pos")


@query("SET11", "TXT02", sql=f"""
    SELECT root, count(*) AS pages, count(DISTINCT host) AS hosts, min(page_id) AS first_page
    FROM (SELECT page_id, host, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS root FROM (SELECT page_id, {HOST_SQL} AS host FROM pages)) GROUP BY 1""")
def root_domains(t: Tables) -> DataFrame:
    """Pages by registrable domain."""
    return hosts(t).groupBy(root_domain(F.col("host")).alias("root")).agg(F.count("*").alias("pages"), F.count_distinct("host").alias("hosts"), F.min("page_id").alias("first_page"))
