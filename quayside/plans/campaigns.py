"""Campaign queries: companion tables are derived from the driver's tables by the same SQL for the plan and its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators.campaigns import campaign_summaries, retry_verdicts
from quayside.plans.registry import Tables, query

#: Companion tables as SQL over orders, lineitem and supplier; braces mark the tables.
DERIVED = {
    "campaigns": "SELECT DISTINCT o_custkey % 10 AS id, o_custkey % 10 AS request_id FROM {orders}",
    "targets": """SELECT o_orderkey AS id, o_custkey % 10 AS campaign_id, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 97 + 1 END AS supplier_id, CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey END AS job_id,
        concat('u', CAST(o_orderkey % 97 + 1 AS VARCHAR(9)), '@x.com') AS normalized_email,
        CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'excluded' WHEN '2' THEN 'waiting' WHEN '3' THEN 'done' ELSE 'eligible' END AS status,
        CASE WHEN o_custkey % 2 = 0 THEN 'suppressed by list' ELSE 'other' END AS exclusion_reason FROM {orders}""",
    "jobs": """SELECT o_orderkey AS id, o_orderkey AS message_id,
        CASE WHEN o_orderkey % 8 = 0 THEN 'sent' WHEN o_orderkey % 8 = 1 THEN 'queued' WHEN o_orderkey % 8 = 2 THEN 'delivery_unknown' WHEN o_orderkey % 8 = 3 THEN 'cancelled' ELSE 'failed' END AS status FROM {orders}""",
    "messages": """SELECT o_orderkey AS id, CAST(1 AS BIGINT) AS workspace_id, o_custkey % 10 AS request_id, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 97 + 1 END AS supplier_id, o_orderkey % 3 + 1 AS mail_account_id,
        CASE WHEN o_orderkey % 7 = 0 THEN 'inbound' ELSE 'outbound' END AS direction, concat('u', CAST(o_orderkey % 89 AS VARCHAR(9)), '@x.com') AS from_email,
        concat('U', CAST(o_custkey % 1499 AS VARCHAR(9)), '@x.com ') AS to_email, CASE WHEN o_orderkey % 5 = 0 THEN 'Undelivered' ELSE 'offer' END AS subject,
        CASE WHEN o_orderkey % 10 = 0 THEN 'no such user' ELSE 'text' END AS body_text, CASE WHEN o_orderkey % 8 = 0 THEN 'sent' WHEN o_orderkey % 8 = 1 THEN 'queued' ELSE 'failed' END AS status,
        o_orderdate AS created_at, CASE WHEN o_orderkey % 8 = 0 THEN o_orderdate END AS sent_at, CASE WHEN o_orderkey % 29 = 0 THEN o_orderkey END AS resend_of_message_id FROM {orders}""",
    "attempts": """SELECT l_orderkey * 100000 + l_linenumber * 10000 + l_partkey % 10000 AS id, l_orderkey AS job_id, l_orderkey AS message_id, l_shipdate AS started_at, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate END AS ended_at,
        CASE WHEN l_suppkey % 50 = 0 THEN 'accepted' WHEN l_returnflag = 'R' AND l_linenumber < 3 THEN 'transient_rejected' WHEN l_suppkey % 51 = 0 THEN 'delivery_unknown' ELSE 'permanent_rejected' END AS outcome,
        CASE WHEN l_suppkey % 17 = 0 THEN 'Spam block' WHEN l_suppkey % 19 = 0 THEN 'suppression' END AS provider_classification, l_partkey % 9 > 0 AS irreversible_reached FROM {lineitem} WHERE l_linenumber < 4""",
    "evidence": """SELECT DISTINCT l_orderkey * 100000 + l_linenumber * 10000 + l_partkey % 10000 AS attempt_id, CASE WHEN l_partkey % 10 = 0 THEN 'connect' ELSE 'rcpt_to' END AS smtp_stage,
        CASE WHEN l_partkey % 7 = 0 THEN 450 ELSE 550 END AS smtp_code, 'safe' AS provider_response_safe FROM {lineitem} WHERE l_linenumber < 4 AND l_partkey % 8 > 0""",
    "accounts": "SELECT s_suppkey AS id, CAST(1 AS BIGINT) AS workspace_id, CASE WHEN s_suppkey % 2 = 1 THEN 'alpha' ELSE 'beta' END AS provider, CASE WHEN s_suppkey % 5 = 4 THEN 'off' ELSE 'connected' END AS status FROM {supplier} WHERE s_suppkey < 10",
    "suppliers": "SELECT s_suppkey AS id, concat('k', CAST(s_suppkey AS VARCHAR(9))) AS external_key, concat('U', CAST(s_suppkey AS VARCHAR(9)), '@x.com') AS email FROM {supplier}",
    "reconciled": """SELECT o_orderkey AS id, o_custkey % 10 AS request_id, o_orderkey % 97 + 1 AS supplier_id, concat('u', CAST(o_orderkey % 97 + 1 AS VARCHAR(9)), '@x.com') AS normalized_recipient, 'gamma' AS provider_type,
        CASE WHEN o_orderkey % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS outcome, o_orderdate AS accepted_at FROM {orders} WHERE o_orderkey % 31 = 0""",
    "blacklist": """SELECT CAST(1 AS BIGINT) AS workspace_id, CASE WHEN s_suppkey % 2 = 0 THEN concat('k', CAST(s_suppkey AS VARCHAR(9))) ELSE concat('email:u', CAST(s_suppkey AS VARCHAR(9)), '@x.com') END AS external_key,
        CASE WHEN s_suppkey % 2 = 0 THEN 'host' ELSE 'email' END AS level, CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS restored_at FROM {supplier} WHERE s_suppkey % 7 = 0""",
    "states": """SELECT o_custkey % 10 AS request_id, o_orderkey % 97 + 1 AS supplier_id, CASE WHEN min(o_orderkey) % 3 = 0 THEN 'replied' ELSE 'failed' END AS status, min(o_orderkey) AS last_message_id,
        CASE WHEN min(o_orderkey) % 4 = 0 THEN 'Bounced' END AS last_error FROM {orders} WHERE o_orderkey % 37 = 0 GROUP BY 1, 2""",
    "retries": "SELECT CAST(1 AS BIGINT) AS workspace_id, o_custkey % 10 AS request_id, concat('u', CAST(o_custkey % 1499 AS VARCHAR(9)), '@x.com') AS normalized_recipient FROM {orders} WHERE o_orderkey % 41 = 0",
    "asked": """SELECT o_orderkey AS "row", CAST(1 AS BIGINT) AS workspace_id, o_custkey % 10 AS request_id, o_orderkey AS original_job_id, o_orderkey AS original_message_id,
        CASE WHEN o_orderkey % 43 = 0 THEN o_orderkey END AS original_attempt_id, CASE WHEN o_orderkey % 6 = 0 THEN 4 WHEN o_orderkey % 23 = 0 THEN 99 WHEN o_orderkey % 25 = 0 THEN 1 ELSE 2 END AS target_account_id FROM {orders} WHERE o_orderkey % 8 > 3""",
}
BOUNCE = "regexp_matches(coalesce({m}.subject, ''), '(?i)undelivered')"
PLAIN = ", ".join(f"{name} AS ({sql.replace('{', '').replace('}', '')})" for name, sql in DERIVED.items())


def companions(t: Tables, *names: str) -> list[DataFrame]:
    spark = t.orders.sparkSession
    tables = {"orders": t.orders, "lineitem": t.lineitem, "supplier": t.supplier}
    text = {name: DERIVED[name].replace('"row"', "`row`") for name in names}
    return [spark.sql(sql, **{k: v for k, v in tables.items() if f"{{{k}}}" in sql}) for sql in text.values()]


@query("AGG28", "STM17", "STM18", "RDM14", sql=f"""
    WITH {PLAIN},
    f AS (SELECT job_id, bool_or(outcome = 'transient_rejected') AS transient, bool_or(outcome = 'accepted') AS took, bool_or(lower(coalesce(provider_classification, '')) LIKE '%spam%' OR lower(coalesce(provider_classification, '')) LIKE '%policy%') AS rejected,
          bool_or(lower(coalesce(provider_classification, '')) IN ('suppression', 'supplier-suppressed')) AS barred FROM attempts GROUP BY 1),
    sent AS (SELECT m.request_id, m.supplier_id, max(row(coalesce(m.sent_at, m.created_at), m.id, a.provider)) AS e FROM messages m JOIN accounts a ON a.id = m.mail_account_id JOIN jobs j ON j.message_id = m.id LEFT JOIN f ON f.job_id = j.id
             WHERE m.direction = 'outbound' AND m.supplier_id IS NOT NULL AND (m.status = 'sent' OR j.status = 'sent' OR f.took) GROUP BY 1, 2),
    settled AS (SELECT request_id, supplier_id, normalized_recipient, max(row(accepted_at, id, provider_type)) AS e FROM reconciled WHERE outcome = 'accepted' GROUP BY 1, 2, 3),
    hard AS (SELECT DISTINCT s.request_id, s.supplier_id FROM states s LEFT JOIN messages m ON m.id = s.last_message_id WHERE s.status = 'failed' AND (lower(coalesce(s.last_error, '')) LIKE '%bounce%' OR ({BOUNCE.format(m="m")} AND m.body_text = 'no such user'))),
    x AS (SELECT t.*, c.request_id, coalesce(j.status, '') AS job, f.job_id AS tried, coalesce(f.transient, false) AS transient, coalesce(f.took, false) AS took, coalesce(f.rejected, false) AS rejected, coalesce(f.barred, false) AS barred, t.status <> 'excluded' AS live,
          settled.e IS NOT NULL AS reconciled, CASE WHEN hard.supplier_id IS NOT NULL THEN t.supplier_id END AS bounced, CASE WHEN t.status <> 'excluded' THEN struct_extract(greatest(sent.e, settled.e), 3) END AS provider
          FROM targets t JOIN campaigns c ON c.id = t.campaign_id LEFT JOIN jobs j ON j.id = t.job_id LEFT JOIN f ON f.job_id = t.job_id LEFT JOIN sent ON sent.request_id = c.request_id AND sent.supplier_id = t.supplier_id
          LEFT JOIN settled ON settled.request_id = c.request_id AND settled.supplier_id = t.supplier_id AND settled.normalized_recipient = t.normalized_email LEFT JOIN hard ON hard.request_id = c.request_id AND hard.supplier_id = t.supplier_id),
    n AS (SELECT campaign_id, request_id, count(*) AS planned, count(*) FILTER (NOT live) AS excluded, count(*) FILTER (live AND provider IS NULL AND job = 'queued') AS queued, count(*) FILTER (live AND provider IS NULL AND job = 'queued' AND status = 'waiting') AS waiting,
          count(*) FILTER (live AND tried IS NOT NULL) AS attempted, count(provider) AS accepted, count(*) FILTER (live AND job = 'sent') AS accepted_in_campaign, count(*) FILTER (live AND reconciled) AS accepted_reconciled,
          count(*) FILTER (live AND provider IS NULL AND job = 'failed' AND NOT transient) AS failed, count(*) FILTER (live AND provider IS NULL AND transient AND job <> 'sent') AS failed_transient,
          count(*) FILTER (live AND provider IS NULL AND job = 'queued' AND transient AND NOT took) AS historical_disputed_transient, count(*) FILTER (live AND provider IS NULL AND job = 'delivery_unknown') AS delivery_unknown,
          count(*) FILTER ((NOT live AND exclusion_reason LIKE 'suppressed%') OR (live AND barred)) AS suppressed, count(*) FILTER (live AND provider IS NULL AND job = 'cancelled') AS cancelled,
          count(*) FILTER (provider IS NULL AND status IN ('eligible', 'waiting') AND job IN ('queued', 'sending', '')) AS remaining, count(*) FILTER (live AND rejected) AS provider_rejection_count, count(DISTINCT bounced) AS hard_bounces FROM x GROUP BY 1, 2),
    p AS (SELECT campaign_id, string_agg(provider || ':' || CAST(k AS VARCHAR), ',' ORDER BY provider) AS providers FROM (SELECT campaign_id, provider, count(*) AS k FROM x WHERE provider IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    a AS (SELECT t.campaign_id, a.outcome, row_number() OVER (PARTITION BY t.campaign_id ORDER BY coalesce(a.ended_at, a.started_at) DESC, a.id DESC) AS n FROM attempts a JOIN targets t ON t.job_id = a.job_id WHERE a.outcome IN ('accepted', 'transient_rejected', 'permanent_rejected', 'uncertain')),
    h AS (SELECT campaign_id, coalesce(min(n) FILTER (outcome <> 'transient_rejected'), count(*) + 1) - 1 AS streak, count(*) FILTER (n <= 10) AS recent, count(*) FILTER (n <= 10 AND outcome = 'transient_rejected') AS transient FROM a GROUP BY 1),
    d AS (SELECT *, greatest(failed, hard_bounces) AS failed_permanent, greatest(attempted, accepted + greatest(failed, hard_bounces) + failed_transient + delivery_unknown) AS done FROM n)
    SELECT d.campaign_id, request_id, planned, excluded, queued, waiting, attempted, accepted, accepted_in_campaign, accepted_reconciled, failed_transient, historical_disputed_transient, delivery_unknown, suppressed, cancelled, remaining, provider_rejection_count, hard_bounces,
           failed_permanent, planned - excluded AS eligible, queued AS queued_provider_neutral, coalesce(providers, '') AS providers, CASE WHEN done > 0 THEN failed_permanent / done ELSE 0.0 END AS permanent_failure_rate, CASE WHEN done > 0 THEN failed_transient / done ELSE 0.0 END AS transient_failure_rate,
           CASE WHEN done > 0 THEN delivery_unknown / done ELSE 0.0 END AS unknown_rate, CASE WHEN done > 0 THEN provider_rejection_count / done ELSE 0.0 END AS provider_rejection_rate, streak, recent, transient
    FROM d LEFT JOIN p ON p.campaign_id = d.campaign_id LEFT JOIN h ON h.campaign_id = d.campaign_id""")
def campaign_counters(t: Tables) -> DataFrame:
    """All counters, rates and health measures of every campaign."""
    found = campaign_summaries(*companions(t, "campaigns", "targets", "jobs", "messages", "attempts", "accounts", "reconciled", "states"))
    pairs = F.transform(F.map_entries("accepted_by_provider"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string")))
    return found.withColumn("providers", F.array_join(F.array_sort(pairs), ",")).drop("accepted_by_provider")


@query("TXT89", "JOI34", "RDM18", "TRN16", sql=f"""
    WITH {PLAIN},
    s AS (SELECT q.*, m.supplier_id, m.mail_account_id, lower(trim(m.to_email)) AS recipient, m.status AS m_status, m.created_at, m.resend_of_message_id, j.status AS j_status, ma.provider AS m_provider, lower(trim(su.external_key)) AS key, m.id IS NOT NULL AS has
          FROM asked q LEFT JOIN (jobs j JOIN messages m ON m.id = j.message_id AND m.direction = 'outbound') ON j.id = q.original_job_id AND m.id = q.original_message_id AND m.workspace_id = q.workspace_id AND m.request_id = q.request_id
          LEFT JOIN accounts ma ON ma.id = m.mail_account_id LEFT JOIN suppliers su ON su.id = m.supplier_id),
    e AS (SELECT a.*, coalesce(a.ended_at, a.started_at) AS at, v.smtp_stage, v.smtp_code, v.provider_response_safe FROM attempts a LEFT JOIN evidence v ON v.attempt_id = a.id),
    k AS (SELECT s."row" AS r, count(*) AS tries, max(row(e.id, e.outcome, e.at, e.irreversible_reached, e.smtp_stage, e.smtp_code, e.provider_response_safe)) FILTER (s.original_attempt_id IS NULL OR e.id = s.original_attempt_id) AS a
          FROM s JOIN e ON s.has AND e.job_id = s.original_job_id AND e.message_id = s.original_message_id GROUP BY 1),
    z AS (SELECT s.*, coalesce(tries, 0) AS tries, a IS NOT NULL AS tried, struct_extract(a, 1) AS own, coalesce(struct_extract(a, 2), '') AS outcome, coalesce(struct_extract(a, 3), s.created_at) AS since, coalesce(struct_extract(a, 4), false) AS irreversible, coalesce(struct_extract(a, 5), '') AS stage, struct_extract(a, 6) AS code, coalesce(struct_extract(a, 7), '') AS safe,
          g.id IS NOT NULL AS goal, coalesce(g.provider, '') AS t_provider, coalesce(g.status, '') AS t_status FROM s LEFT JOIN k ON k.r = s."row" LEFT JOIN accounts g ON g.id = s.target_account_id AND g.workspace_id = s.workspace_id),
    w AS (SELECT m.id AS message, m.request_id, lower(trim(m.to_email)) AS recipient, m.status AS ms, j.status AS js, j.id AS job, coalesce(m.sent_at, m.created_at) AS at FROM messages m LEFT JOIN jobs j ON j.message_id = m.id),
    o AS (SELECT w.*, a.id AS attempt, a.outcome, coalesce(a.ended_at, a.started_at) AS tried FROM w JOIN attempts a ON a.job_id = w.job),
    later AS (SELECT z."row" AS r FROM z JOIN o ON o.request_id = z.request_id AND o.recipient = z.recipient WHERE o.outcome = 'accepted' AND o.attempt <> coalesce(z.own, -1) AND o.tried > z.since UNION SELECT z."row" FROM z JOIN w ON w.request_id = z.request_id AND w.recipient = z.recipient WHERE w.message <> z.original_message_id AND (w.ms = 'sent' OR w.js = 'sent') AND w.at > z.since),
    lost AS (SELECT request_id, recipient FROM w WHERE ms = 'delivery_unknown' OR js = 'delivery_unknown' UNION SELECT request_id, recipient FROM o WHERE outcome = 'delivery_unknown'),
    active AS (SELECT DISTINCT z."row" AS r FROM z JOIN w ON w.request_id = z.request_id AND w.recipient = z.recipient WHERE w.message <> z.original_message_id AND (w.ms IN ('queued', 'sending', 'delivery_unknown') OR w.js IN ('queued', 'sending', 'delivery_unknown'))),
    b AS (SELECT * FROM blacklist WHERE restored_at IS NULL),
    mails AS (SELECT workspace_id, replace(external_key, 'email:', '') AS recipient FROM b WHERE level = 'email' UNION SELECT b.workspace_id, lower(su.email) FROM b JOIN suppliers su ON su.external_key = b.external_key),
    replied AS (SELECT DISTINCT request_id, supplier_id FROM states WHERE status IN ('replied', 'answered')),
    replied_at AS (SELECT DISTINCT r.request_id, lower(trim(su.email)) AS recipient FROM replied r JOIN suppliers su ON su.id = r.supplier_id),
    wrote AS (SELECT DISTINCT z."row" AS r FROM z JOIN messages m ON m.direction = 'inbound' AND m.request_id = z.request_id AND lower(trim(m.from_email)) = z.recipient AND (z.supplier_id IS NULL OR m.supplier_id = z.supplier_id) WHERE NOT {BOUNCE.format(m="m")}),
    v AS (SELECT z.*, list_filter([
        CASE WHEN NOT has THEN 'original_not_found' END, CASE WHEN NOT goal THEN 'target_account_not_found' END, CASE WHEN NOT tried AND original_attempt_id IS NOT NULL THEN 'original_attempt_not_found' END, CASE WHEN NOT tried AND original_attempt_id IS NULL THEN 'original_attempt_missing' END,
        CASE WHEN has AND coalesce(supplier_id, 0) <= 0 THEN 'supplier_not_found' END, CASE WHEN has AND coalesce(m_provider, '') <> 'alpha' THEN 'original_provider_not_alpha' END, CASE WHEN has AND (j_status <> 'failed' OR m_status <> 'failed') THEN 'original_not_terminal_failed' END,
        CASE WHEN has AND resend_of_message_id IS NOT NULL THEN 'original_is_retry' END, CASE WHEN goal AND t_provider <> 'beta' THEN 'target_provider_not_beta' END, CASE WHEN goal AND t_status <> 'connected' THEN 'target_account_not_connected' END, CASE WHEN goal AND has AND target_account_id = mail_account_id THEN 'target_account_is_original' END,
        CASE WHEN tried AND outcome = 'accepted' THEN 'original_accepted' END, CASE WHEN tried AND outcome = 'delivery_unknown' THEN 'original_delivery_unknown' END, CASE WHEN tried AND outcome NOT IN ('accepted', 'delivery_unknown', 'permanent_rejected') THEN 'original_outcome_not_proven_rejection' END,
        CASE WHEN tried AND (stage = '' OR code IS NULL OR safe = '') THEN 'missing_durable_smtp_evidence' END, CASE WHEN tried AND stage NOT IN ('mail_from', 'rcpt_to', 'data_command', 'post_data') THEN 'final_server_response_stage_missing' END, CASE WHEN tried AND (code IS NULL OR code NOT BETWEEN 500 AND 599) THEN 'final_response_not_5xx' END,
        CASE WHEN tried AND NOT irreversible THEN 'non_irreversible_evidence' END, CASE WHEN tries > 1 THEN 'original_disputed' END, CASE WHEN "row" IN (SELECT r FROM later) THEN 'later_accepted_send' END,
        CASE WHEN has AND EXISTS (SELECT 1 FROM reconciled c WHERE c.request_id = z.request_id AND lower(trim(c.normalized_recipient)) = z.recipient AND c.outcome = 'accepted') THEN 'reconciled_accepted' END,
        CASE WHEN EXISTS (SELECT 1 FROM lost WHERE lost.request_id = z.request_id AND lost.recipient = z.recipient) THEN 'delivery_unknown_history' END, CASE WHEN "row" IN (SELECT r FROM active) THEN 'active_delivery_for_recipient' END,
        CASE WHEN has AND (EXISTS (SELECT 1 FROM b WHERE b.workspace_id = z.workspace_id AND b.external_key = z.key) OR EXISTS (SELECT 1 FROM mails WHERE mails.workspace_id = z.workspace_id AND mails.recipient = z.recipient)) THEN 'suppressed' END,
        CASE WHEN EXISTS (SELECT 1 FROM replied x WHERE x.request_id = z.request_id AND x.supplier_id = z.supplier_id) OR EXISTS (SELECT 1 FROM replied_at x WHERE x.request_id = z.request_id AND x.recipient = z.recipient) OR "row" IN (SELECT r FROM wrote) THEN 'answered' END,
        CASE WHEN EXISTS (SELECT 1 FROM retries x WHERE x.workspace_id = z.workspace_id AND x.request_id = z.request_id AND lower(trim(x.normalized_recipient)) = z.recipient) THEN 'retry_already_planned' END], lambda x: x IS NOT NULL) AS reasons FROM z)
    SELECT "row", request_id, supplier_id, array_to_string(reasons, ',') AS blocked_reasons, len(reasons) = 0 AS eligible FROM v""")
def retry_gates(t: Tables) -> DataFrame:
    """Which failed messages may go out again through another provider, with all reasons against it."""
    order = ("asked", "jobs", "messages", "attempts", "evidence", "accounts", "suppliers", "reconciled", "blacklist", "states", "retries")
    found = retry_verdicts(*companions(t, *order), source_provider="alpha", target_provider="beta")
    return found.select("row", "request_id", "supplier_id", F.array_join("blocked_reasons", ",").alias("blocked_reasons"), "eligible")
