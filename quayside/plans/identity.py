"""Duplicate suppliers and their merge over companion tables, derived by the same SQL for the plan and its twin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators import identity
from quayside.plans.registry import Tables, query

#: Companion tables as SQL; braces mark the driver's tables.
SCANNED = {
    "suppliers": """SELECT c_custkey AS id, CAST(c_custkey % 2 AS BIGINT) AS workspace_id, CASE WHEN c_custkey % 7 > 0 THEN c_name ELSE ' ' END AS name, CASE WHEN c_custkey % 3 = 0 THEN concat('h', CAST(c_custkey % 50 AS VARCHAR(9)), '.ru') ELSE '' END AS host,
        CASE WHEN c_custkey % 13 = 12 THEN '' WHEN c_custkey % 4 = 0 THEN concat(' E', CAST(c_custkey % 311 AS VARCHAR(9)), '@x.com') ELSE concat('e', CAST(c_custkey % 311 AS VARCHAR(9)), '@X.com') END AS email,
        CASE WHEN c_custkey % 6 = 0 THEN CAST(7700000000 + c_custkey AS VARCHAR(12)) WHEN c_custkey % 6 = 1 THEN 'n/a' ELSE '' END AS inn, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 40 END AS global_id FROM {customer}""",
    "contacts": "SELECT c_custkey AS supplier_id, concat('e', CAST((c_custkey + 17) % 311 AS VARCHAR(9)), '@x.com') AS email FROM {customer} WHERE c_custkey % 11 = 1",
    "requests": "SELECT DISTINCT o_orderkey % 50 AS request_id, o_custkey AS supplier_id FROM {orders}",
}
KEYED = "min(o_orderkey) AS k, max(o_orderkey) AS m, max(o_orderdate) AS seen FROM {orders} GROUP BY 1, 2"
WHOSE = "o_custkey % 10 AS request_id, o_orderkey % 23 AS supplier_id"
MERGED = {
    "suppliers": """SELECT CAST(n AS BIGINT) AS id, CAST(CASE WHEN n = 21 THEN 2 ELSE 1 END AS BIGINT) AS workspace_id, CASE WHEN n % 4 = 0 OR n = 14 THEN concat('h', CAST(n AS VARCHAR(9)), '.ru') ELSE '' END AS host, concat('c', CAST(n AS VARCHAR(9)), '@x.com') AS email,
        CASE WHEN n = 16 THEN '7700000016' WHEN n = 17 THEN '7700000017' ELSE '' END AS inn FROM (SELECT DISTINCT o_orderkey % 23 AS n FROM {orders}) d""",
    "pairs": 'SELECT DISTINCT o_orderkey % 23 AS "old", o_orderkey % 23 - 1 AS "new" FROM {orders} WHERE o_orderkey % 23 % 4 > 0',
    "mail_threads": f"SELECT k AS id, CAST(1 AS BIGINT) AS workspace_id, request_id, supplier_id, seen AS last_message_at FROM (SELECT {WHOSE}, {KEYED}) d",
    "mail_messages": f"SELECT o_orderkey AS id, {WHOSE}, min(o_orderkey) OVER (PARTITION BY o_custkey % 10, o_orderkey % 23) AS thread_id, concat('u', CAST(o_custkey AS VARCHAR(9))) AS to_email, o_orderstatus AS status, o_orderdate AS created_at FROM {{orders}}",
    "request_suppliers": f"""SELECT request_id, supplier_id, CASE WHEN k % 9 = 0 THEN 'no list' WHEN k % 9 = 1 THEN '' ELSE concat('["p', CAST(k % 5 AS VARCHAR(9)), '","q', CAST(m % 7 AS VARCHAR(9)), '"]') END AS position_keys_json, CASE WHEN k % 3 = 0 THEN '' ELSE concat('r', CAST(k AS VARCHAR(9))) END AS reason,
        CASE WHEN k % 4 > 0 THEN concat('s', CAST(k AS VARCHAR(9))) END AS source, k % 2 AS is_irrelevant, seen AS updated_at FROM (SELECT {WHOSE}, {KEYED}) d WHERE k % 5 < 4""",
    "request_supplier_states": f"SELECT request_id, supplier_id, k % 3 AS mail_account_id, CASE WHEN m % 2 = 0 THEN 'sent' ELSE 'failed' END AS status, m AS last_message_id, CASE WHEN m % 2 = 1 THEN 'x' END AS last_error, seen AS updated_at FROM (SELECT {WHOSE}, {KEYED}) d",
    "request_supplier_ratings": f"SELECT request_id, supplier_id, k % 6 AS rating, date_trunc('year', seen) AS updated_at FROM (SELECT {WHOSE}, {KEYED}) d WHERE k % 2 = 0",
    "search_result_sources": f"SELECT request_id, supplier_id, concat('p', CAST(k % 3 AS VARCHAR(9))) AS position_key, CASE WHEN k % 3 > 0 THEN concat('u', CAST(k AS VARCHAR(9))) ELSE '' END AS url, CASE WHEN k % 2 = 0 THEN concat('t', CAST(k AS VARCHAR(9))) ELSE '' END AS title, seen AS updated_at FROM (SELECT {WHOSE}, {KEYED}) d",
    "supplier_evidence": "SELECT o_orderkey % 23 AS supplier_id, 'phone' AS field_name, concat('v', CAST(o_custkey % 40 AS VARCHAR(9))) AS field_value, o_orderstatus AS source_type, 'x' AS source_url, min(o_orderkey) AS score, max(o_orderdate) AS last_seen_at FROM {orders} GROUP BY 1, 2, 3, 4, 5",
    "blacklist_entries": "SELECT o_orderkey AS id, o_orderkey % 23 AS supplier_id FROM {orders} WHERE o_orderkey % 29 = 0",
    "mail_campaign_targets": "SELECT o_orderkey AS id, o_custkey % 10 AS campaign_id, o_orderkey % 23 AS supplier_id, o_orderstatus AS status FROM {orders}",
    "mail_send_operation_targets": """SELECT k AS id, operation_id, normalized_email, k % 23 AS supplier_id, CASE WHEN k % 2 = 0 THEN k END AS message_id, seen AS updated_at FROM
        (SELECT o_custkey % 10 AS operation_id, concat('m', CAST(CASE WHEN o_orderkey % 23 IN (17, 18, 19) THEN 17 WHEN o_orderkey % 23 IN (14, 15) THEN 14 WHEN o_orderkey % 23 > 20 THEN o_orderkey % 23 ELSE o_orderkey % 23 - o_orderkey % 23 % 4 END AS VARCHAR(9))) AS normalized_email, o_orderkey % 23 AS s, min(o_orderkey) AS k, max(o_orderdate) AS seen FROM {orders} GROUP BY 1, 2, 3) d""",
    "supplier_profiles": """SELECT s AS supplier_id, CASE WHEN s % 4 = 2 THEN '7700000001' ELSE '' END AS inn, CASE WHEN s % 2 = 0 THEN 'organization' END AS kind, concat('r', CAST(s AS VARCHAR(9))) AS region, '' AS role, CASE WHEN s % 4 = 1 THEN '' ELSE concat('+', CAST(s AS VARCHAR(9))) END AS phone, '' AS reason, ' ' AS source,
        concat('["c', CAST(s % 3 AS VARCHAR(9)), '","c', CAST(s % 4 AS VARCHAR(9)), '"]') AS covers_json, s % 5 AS site_unavailable, seen AS updated_at FROM (SELECT o_orderkey % 23 AS s, max(o_orderdate) AS seen FROM {orders} WHERE o_orderkey % 23 <> 12 GROUP BY 1) d""",
    "supplier_inn_sources": "SELECT s AS supplier_id, CASE WHEN s % 4 = 3 THEN 'manual' ELSE 'page' END AS source_type, s AS updated_by, seen AS updated_at FROM (SELECT o_orderkey % 23 AS s, max(o_orderdate) AS seen FROM {orders} GROUP BY 1) d",
}


def plain(derived: dict[str, str]) -> str:
    return ", ".join(f"{name} AS ({sql.replace('{', '').replace('}', '')})" for name, sql in derived.items())


def companions(t: Tables, derived: dict[str, str]) -> dict[str, DataFrame]:
    tables = {"orders": t.orders, "customer": t.customer}
    return {name: t.orders.sparkSession.sql(sql.replace('"', "`") if name == "pairs" else sql, **{k: v for k, v in tables.items() if f"{{{k}}}" in sql}) for name, sql in derived.items()}


@query("TXT91", sql=f"""
    WITH RECURSIVE {plain(SCANNED)},
    r AS (SELECT *, trim(coalesce(host, '')) <> '' AS hosted, row(global_id IS NOT NULL, regexp_full_match(trim(inn), '[0-9]{{10}}|[0-9]{{12}}'), trim(coalesce(name, '')) <> '', -id) AS worth FROM suppliers),
    k AS (SELECT DISTINCT id AS supplier_id, lower(trim(email)) AS address FROM (SELECT id, email FROM suppliers UNION ALL SELECT supplier_id, email FROM contacts) e WHERE trim(email) <> ''),
    x AS (SELECT r.*, k.address FROM k JOIN r ON r.id = k.supplier_id),
    o AS (SELECT workspace_id, address, id FROM x WHERE NOT hosted AND global_id IS NULL),
    t(a, b) AS (SELECT id, id FROM o UNION SELECT t.a, o2.id FROM t JOIN o o1 ON o1.id = t.b JOIN o o2 ON o2.workspace_id = o1.workspace_id AND o2.address = o1.address),
    g AS (SELECT a AS id, min(b) AS grp FROM t GROUP BY 1),
    h AS (SELECT DISTINCT g.grp, x.id AS host_id, x.host, x.global_id, x.worth, coalesce('g' || x.global_id, 's' || x.id) AS company FROM o JOIN g ON g.id = o.id JOIN x ON x.hosted AND x.workspace_id = o.workspace_id AND x.address = o.address),
    f AS (SELECT grp, count(DISTINCT company) AS companies, count(DISTINCT host_id) AS hosts, max(row(worth, host_id, host, global_id)) AS best FROM h GROUP BY 1),
    v AS (SELECT g.id, coalesce(f.companies, 0) AS companies, coalesce(f.hosts, 0) AS hosts, CASE WHEN f.companies = 1 THEN f.best END AS best FROM g LEFT JOIN f ON f.grp = g.grp)
    SELECT v.id AS supplier_id, r.workspace_id, CASE WHEN companies = 0 THEN 'unresolved' WHEN companies = 1 THEN 'candidate' ELSE 'ambiguous' END AS verdict,
           CASE WHEN companies = 0 THEN 'no exact host contact' WHEN companies > 1 THEN 'email maps to multiple company identities' ELSE '' END AS reason, struct_extract(best, 2) AS canonical_id, struct_extract(best, 3) AS host, struct_extract(best, 4) AS global_id, companies, hosts FROM v JOIN r ON r.id = v.id
    UNION ALL SELECT DISTINCT id, workspace_id, 'ambiguous', 'hostless row already linked to global company', NULL, NULL, NULL, 0, 0 FROM x WHERE NOT hosted AND global_id IS NOT NULL""")
def duplicate_scan(t: Tables) -> DataFrame:
    """Rows without a host that are copies of a company's row, could be of several, or of none."""
    c = companions(t, SCANNED)
    return identity.duplicate_scan(c["suppliers"], c["contacts"])


@query("TXT92", sql=f"""
    WITH {plain(SCANNED)}, j AS (SELECT r.request_id, s.* FROM requests r LEFT JOIN suppliers s ON s.id = r.supplier_id)
    SELECT 'request' AS kind, request_id AS id, count(*) AS "rows", count(DISTINCT nullif(lower(trim(inn)), '')) AS numbers, count(DISTINCT global_id) AS companies, count(DISTINCT nullif(lower(trim(host)), '')) AS sites, count(DISTINCT nullif(lower(trim(email)), '')) AS emails FROM j GROUP BY request_id
    UNION ALL SELECT 'company', global_id, count(*), 0, 1, count(DISTINCT nullif(trim(host), '')), 0 FROM suppliers WHERE global_id IS NOT NULL GROUP BY global_id HAVING count(*) > 1""")
def identity_counts(t: Tables) -> DataFrame:
    """How many companies a request's suppliers are, and on how many sites a company has rows."""
    c = companions(t, SCANNED)
    by_request = identity.request_identity(c["requests"], c["suppliers"]).select(F.lit("request").alias("kind"), F.col("request_id").alias("id"), "rows", "numbers", "companies", "sites", "emails")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return by_request.union(identity.several_sites(c["suppliers"]).select(F.lit("company"), "global_id", "suppliers", zero, one, "sites", zero))


def by_place(column: str) -> str:
    return f"list({column} ORDER BY place)"


def filled_sql(column: str) -> str:
    return f"coalesce(list_filter({by_place(column)}, lambda x: trim(CAST(x AS VARCHAR)) <> '')[1], {by_place(column)}[1])"


def latest_sql(column: str) -> str:
    return f"list({column} ORDER BY updated_at DESC, place)[1]"


def lists_sql(column: str) -> str:
    each = f"CASE WHEN json_valid({column}) AND json_type({column}) = 'ARRAY' THEN CAST(json_extract_string({column}, '$[*]') AS VARCHAR[]) ELSE [] END"
    return f"CAST(to_json(list_transform([flatten(list({each} ORDER BY place))], lambda l: list_filter(l, lambda x, i: list_position(l, x) = i))[1]) AS VARCHAR)"


#: relation: key, and its other columns in the twin's own form.
TWINS = {
    "mail_threads": (["workspace_id", "request_id"], {"id": f"{by_place('id')}[1]", "last_message_at": "max(last_message_at)"}),
    "request_suppliers": (["request_id"], {"position_keys_json": lists_sql("position_keys_json"), "reason": filled_sql("reason"), "source": filled_sql("source"), "is_irrelevant": "max(is_irrelevant)", "updated_at": "max(updated_at)"}),
    "request_supplier_states": (["request_id"], {c: latest_sql(c) for c in ("mail_account_id", "status", "last_message_id", "last_error", "updated_at")}),
    "request_supplier_ratings": (["request_id"], {c: latest_sql(c) for c in ("rating", "updated_at")}),
    "search_result_sources": (["request_id", "position_key"], {"url": filled_sql("url"), "title": filled_sql("title"), "updated_at": "max(updated_at)"}),
    "supplier_evidence": (["field_name", "field_value", "source_type", "source_url"], {c: f"{by_place(c)}[1]" for c in ("score", "last_seen_at")}),
    "supplier_profiles": ([], {**{c: filled_sql(c) for c in ("inn", "kind", "region", "role", "phone", "reason", "source")}, "covers_json": lists_sql("covers_json"), "site_unavailable": "max(site_unavailable)", "updated_at": "max(updated_at)"}),
    "supplier_inn_sources": ([], {c: f"list({c} ORDER BY source_type <> 'manual', place)[1]" for c in ("source_type", "updated_by", "updated_at")}),
}


def row_sql(columns: list[str]) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in columns) + ")"


def again_sql(name: str) -> str:
    """The relation with its closed supplier and its place, joined to the chains' ends."""
    return f"SELECT d.*, coalesce(e.new, d.supplier_id) AS now_id, CASE WHEN e.old IS NULL THEN 0 ELSE e.old + 1 END AS place FROM {name} d LEFT JOIN ends e ON e.old = d.supplier_id"


def merged_sql() -> str:
    parts = []
    for name, (key, columns) in TWINS.items():
        # a row that meets no other stays as it is
        whole = {c: f"CASE WHEN count(*) = 1 THEN any_value({c}) ELSE {x} END" for c, x in columns.items()}
        listed = "".join(f", {x} AS {c}" for c, x in whole.items())
        inner = f"SELECT now_id AS supplier_id{''.join(f', {k}' for k in key)}{listed} FROM ({again_sql(name)}) GROUP BY {', '.join(['now_id', *key])}"
        parts.append(f"SELECT '{name}' AS relation, {row_sql(['supplier_id', *key, *columns])} AS value FROM ({inner})")
    for name, columns in (("blacklist_entries", ["id"]), ("mail_campaign_targets", ["id", "campaign_id", "status"])):
        parts.append(f"SELECT '{name}', {row_sql(['now_id', *columns])} FROM ({again_sql(name)})")
    threads = f"SELECT id, first_value(id) OVER (PARTITION BY request_id, now_id ORDER BY place) AS kept FROM ({again_sql('mail_threads')})"
    parts.append(f"SELECT 'mail_messages', {row_sql(['now_id', 'a.id', 'request_id', 'coalesce(h.kept, thread_id)', 'to_email', 'status', 'created_at'])} FROM ({again_sql('mail_messages')}) a LEFT JOIN ({threads}) h ON h.id = a.thread_id")
    moved = f"WITH a AS ({again_sql('mail_send_operation_targets')}), n AS (SELECT *, row_number() OVER w AS n, first_value(message_id) OVER w AS own, first_value(updated_at) OVER w AS seen FROM a WINDOW w AS (PARTITION BY operation_id, normalized_email ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), " \
        "g AS (SELECT operation_id, normalized_email, max(place) AS most, min_by(message_id, place) FILTER (message_id IS NOT NULL) AS filled, min_by(updated_at, place) FILTER (message_id IS NOT NULL) AS filled_at FROM n GROUP BY 1, 2) " \
        f"SELECT 'mail_send_operation_targets' AS relation, {row_sql(['now_id', 'id', 'n.operation_id', 'n.normalized_email', 'coalesce(own, filled)', 'CASE WHEN own IS NULL THEN greatest(seen, filled_at) ELSE seen END'])} AS value FROM n JOIN g ON g.operation_id = n.operation_id AND g.normalized_email = n.normalized_email WHERE n = 1"
    parts.append(f"SELECT relation, value FROM ({moved})")
    return " UNION ALL ".join(parts)


SAFE = """good AS (SELECT p.* FROM pairs p JOIN suppliers a ON a.id = p.old JOIN suppliers b ON b.id = p.new WHERE a.workspace_id = b.workspace_id AND a.host = '' AND NOT (a.inn <> '' AND b.inn <> '' AND a.inn <> b.inn)),
    chain(old, new) AS (SELECT old, new FROM good UNION SELECT c.old, g.new FROM chain c JOIN good g ON g.old = c.new), ends AS MATERIALIZED (SELECT old, new FROM chain WHERE new NOT IN (SELECT old FROM good))"""


def safe_pairs(c: dict[str, DataFrame]) -> DataFrame:
    return identity.judged_pairs(c["pairs"], c["suppliers"]).where("refused is null").select("old", "new")


def columns_of(name: str, df: DataFrame) -> list[str]:
    """In the order of the twin's row."""
    if name in TWINS:
        return ["supplier_id", *TWINS[name][0], *TWINS[name][1]]
    return ["supplier_id", *[c for c in df.columns if c != "supplier_id"]]


@query("UPS20", "TXT93", "TRN05", sql=f"WITH RECURSIVE {plain(MERGED)}, {SAFE} {merged_sql()}")
def merged_suppliers(t: Tables) -> DataFrame:
    """All twelve relations after the safe pairs, chains of three among them, have been merged; a row is written as text."""
    c = companions(t, MERGED)
    found = identity.merge_suppliers({name: c[name] for name in identity.POLICIES}, safe_pairs(c))
    rows = [df.select(F.lit(name).alias("relation"), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in columns_of(name, df)]).alias("value")) for name, df in found.items()]
    return reduce(DataFrame.union, rows)


@query("TXT93", "RDM33", sql=f"""
    WITH RECURSIVE {plain(MERGED)}, {SAFE}, after AS ({merged_sql()}), n AS (SELECT relation, count(*) AS n FROM after GROUP BY 1),
    b AS ({" UNION ALL ".join(f"SELECT '{name}' AS relation, count(*) AS n FROM {name}" for name in identity.POLICIES)})
    SELECT b.relation, b.n AS rows_before, n.n AS rows_after, 0 AS survivors, 0 AS lost, 0 AS altered FROM b JOIN n ON n.relation = b.relation""")
def merge_invariants(t: Tables) -> DataFrame:
    """What a merge must leave: no row of a duplicate, every key under its canonical supplier, messages as they were."""
    c = companions(t, MERGED)
    before, pairs = {name: c[name] for name in identity.POLICIES}, safe_pairs(c)
    return identity.merge_report(before, identity.merge_suppliers(before, pairs), pairs, {"mail_messages": ["to_email", "status", "created_at"]})


@query("UPS20", "HLP07", sql=f"""
    WITH {plain(MERGED)}
    SELECT p.old, p.new, CASE WHEN a.workspace_id <> b.workspace_id THEN 'different workspaces' WHEN a.host <> '' THEN 'not a row of an address alone' WHEN a.inn <> '' AND b.inn <> '' AND a.inn <> b.inn THEN 'different numbers' END AS refused
    FROM pairs p JOIN suppliers a ON a.id = p.old JOIN suppliers b ON b.id = p.new""")
def merge_guards(t: Tables) -> DataFrame:
    """Pairs that may not be merged, and why."""
    c = companions(t, MERGED)
    return identity.judged_pairs(c["pairs"], c["suppliers"])
