"""Contact choice and campaign preflight over companion tables, derived by the same SQL for the plan and its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions import messages
from quayside.operators import contacts
from quayside.plans.identity import SCANNED, plain
from quayside.plans.registry import Tables, query

#: Companion tables as SQL; braces mark the driver's tables.
DERIVED = {
    "people": SCANNED["suppliers"],
    "cards": """SELECT DISTINCT c_custkey % 200 AS card_id, c_custkey % 200 % 7 AS request_id, concat('card ', CAST(c_custkey % 200 AS VARCHAR(9))) AS name, CASE WHEN c_custkey % 200 % 3 = 0 THEN concat('c', CAST(c_custkey % 200 AS VARCHAR(9)), '.ru') ELSE '' END AS host,
        CASE WHEN c_custkey % 200 % 9 = 0 THEN 'answered' ELSE 'none' END AS response_status FROM {customer}""",
    "members": "SELECT c_custkey % 200 AS card_id, c_custkey AS supplier_id FROM {customer} UNION ALL SELECT (c_custkey + 7) % 200, c_custkey FROM {customer} WHERE c_custkey % 50 = 1",
    "listed": """SELECT c_custkey % 200 AS card_id, c_custkey AS place, c_custkey AS supplier_id, CASE WHEN c_custkey % 13 = 5 THEN ' ' ELSE concat(' E', CAST(c_custkey % 311 AS VARCHAR(9)), '@x.com') END AS email, CASE WHEN c_custkey % 4 = 0 THEN concat('p', CAST(c_custkey AS VARCHAR(9)), '.ru') ELSE '' END AS host,
        CASE c_custkey % 8 WHEN 0 THEN 'queued' WHEN 1 THEN 'accepted' WHEN 2 THEN 'failed' WHEN 3 THEN 'delivery_unknown' WHEN 4 THEN 'bounced' WHEN 5 THEN 'not_sent' WHEN 6 THEN '' END AS delivery_status,
        CASE WHEN c_custkey % 37 = 0 THEN 'answered' ELSE 'none' END AS response_status FROM {customer}""",
    "asked": """SELECT o_orderkey AS "row", CAST(1 AS BIGINT) AS workspace_id, CASE WHEN o_orderkey % 19 = 0 THEN 99 ELSE o_custkey % 200 % 7 END AS request_id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS supplier_id,
        CASE WHEN o_orderkey % 31 = 0 THEN 'no address' WHEN o_orderkey % 5 = 0 THEN concat('new', CAST(o_orderkey % 400 AS VARCHAR(9)), '@y.com') ELSE concat('e', CAST(o_custkey % 311 AS VARCHAR(9)), '@X.com ') END AS email,
        CASE WHEN o_orderkey % 2 = 0 THEN concat('a', CAST(o_custkey AS VARCHAR(9)), '.ru') ELSE ' ' END AS host, CASE WHEN o_orderkey % 101 < 60 THEN o_orderkey % 101 ELSE 61 + o_orderkey % 2000 END AS campaign_id, o_orderkey % 9 > 0 AS has_context FROM {orders}""",
    "contacted": "SELECT DISTINCT CAST(1 AS BIGINT) AS workspace_id, o_custkey % 200 % 7 AS request_id, concat('E', CAST(o_custkey % 311 AS VARCHAR(9)), '@x.com') AS email FROM {orders} WHERE o_orderkey % 23 = 0",
    "barred": "SELECT DISTINCT CAST(1 AS BIGINT) AS workspace_id, concat('e', CAST(c_custkey % 311 AS VARCHAR(9)), '@x.com') AS recipient FROM {customer} WHERE c_custkey % 311 % 29 = 0",
    "bounced": "SELECT DISTINCT o_custkey % 200 % 7 AS request_id, o_custkey AS supplier_id FROM {orders} WHERE o_custkey % 43 = 0",
    "unresolved": "SELECT DISTINCT o_custkey % 200 % 7 AS request_id, o_custkey AS supplier_id FROM {orders} WHERE o_custkey % 17 = 0",
    "campaigns": """SELECT DISTINCT campaign_id, CASE WHEN campaign_id % 13 = 12 THEN NULL WHEN campaign_id % 3 = 0 THEN 'Yandex' ELSE 'mail' END AS provider, campaign_id % 11 < 10 AS request_found,
        CASE campaign_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Re: price' WHEN 2 THEN 'PRICE!!!' ELSE 'Price of bricks' END AS subject, CASE campaign_id % 5 WHEN 0 THEN concat('Dear ', chr(123), chr(123), 'supplier_name', chr(125), chr(125), chr(123), chr(123), 'odd', chr(125), chr(125)) WHEN 1 THEN ' ' ELSE concat('Dear ', chr(123), chr(123), ' supplier_name ', chr(125), chr(125)) END AS body
        FROM (SELECT CASE WHEN o_orderkey % 101 < 60 THEN o_orderkey % 101 ELSE 61 + o_orderkey % 2000 END AS campaign_id FROM {orders}) d""",
}
CHOICE = f"""{plain(DERIVED)},
    who AS (SELECT workspace_id, lower(trim(email)) AS mail, id, CASE WHEN global_id IS NOT NULL AND regexp_full_match(trim(inn), '[0-9]{{10}}|[0-9]{{12}}') THEN 'global:' || global_id ELSE 'supplier:' || id END AS identity FROM people WHERE trim(email) <> ''),
    many AS (SELECT workspace_id, mail, count(DISTINCT identity) > 1 AS shared FROM who GROUP BY 1, 2),
    o AS (SELECT DISTINCT ON (card_id, mail) card_id, lower(trim(email)) AS mail, place, supplier_id, host, CASE WHEN response_status = 'answered' THEN 'answered' ELSE coalesce(nullif(delivery_status, ''), 'not_sent') END AS state FROM listed WHERE trim(email) <> '' ORDER BY card_id, mail, place),
    s1 AS (SELECT k.request_id, m.supplier_id, min(k.card_id) AS card FROM members m JOIN cards k ON k.card_id = m.card_id GROUP BY 1, 2), s2 AS (SELECT k.request_id, o.mail, CASE WHEN count(*) = 1 THEN min(k.card_id) END AS card FROM o JOIN cards k ON k.card_id = o.card_id GROUP BY 1, 2),
    f AS (SELECT card_id, bool_or(state = 'answered') AS any_answer, first(row(mail, supplier_id, host) ORDER BY place) FILTER (state = 'not_sent') AS spare FROM o GROUP BY 1),
    r AS (SELECT a.*, lower(trim(a.email)) AS mail, CASE WHEN a.supplier_id IS NOT NULL THEN s1.card ELSE s2.card END AS card FROM asked a LEFT JOIN s1 ON s1.request_id = a.request_id AND s1.supplier_id = a.supplier_id LEFT JOIN s2 ON s2.request_id = a.request_id AND s2.mail = lower(trim(a.email))),
    x AS (SELECT r.*, k.name, trim(coalesce(k.host, '')) AS card_host, coalesce(k.response_status = 'answered', false) OR coalesce(f.any_answer, false) AS answered, f.spare, o.card_id IS NOT NULL AS known, o.supplier_id AS o_supplier, trim(coalesce(o.host, '')) AS o_host, coalesce(o.state, 'not_sent') AS state,
          coalesce(many.shared, false) AS shared, EXISTS (SELECT 1 FROM contacted c WHERE c.workspace_id = r.workspace_id AND c.request_id = r.request_id AND lower(trim(c.email)) = r.mail) AS before, (SELECT min(identity) FROM who w WHERE w.workspace_id = r.workspace_id AND w.mail = r.mail AND w.id = r.supplier_id) AS identity_group
          FROM r LEFT JOIN cards k ON k.card_id = r.card LEFT JOIN f ON f.card_id = r.card LEFT JOIN o ON o.card_id = r.card AND o.mail = r.mail LEFT JOIN many ON many.workspace_id = r.workspace_id AND many.mail = r.mail),
    y AS (SELECT *, CASE WHEN shared AND supplier_id IS NULL THEN 'skipped' WHEN answered THEN 'skipped' WHEN state = 'not_sent' THEN 'primary' WHEN spare IS NOT NULL THEN 'alternate' ELSE 'skipped' END AS decision FROM x),
    choices AS (SELECT "row", workspace_id, request_id, mail AS requested_email, supplier_id AS requested_supplier_id, CASE decision WHEN 'primary' THEN CASE WHEN known THEN o_supplier ELSE supplier_id END WHEN 'alternate' THEN struct_extract(spare, 2) END AS supplier_id,
          CASE decision WHEN 'primary' THEN mail WHEN 'alternate' THEN struct_extract(spare, 1) END AS email,
          CASE WHEN decision = 'skipped' THEN NULL ELSE coalesce(nullif(CASE WHEN decision = 'alternate' THEN CASE WHEN trim(coalesce(struct_extract(spare, 3), '')) <> '' THEN trim(struct_extract(spare, 3)) ELSE card_host END WHEN known THEN CASE WHEN o_host <> '' THEN o_host ELSE card_host END WHEN trim(host) <> '' THEN trim(host) ELSE card_host END, ''), host) END AS host,
          CASE WHEN decision = 'alternate' THEN struct_extract(spare, 2) WHEN known THEN o_supplier ELSE supplier_id END AS selected_supplier_id, CASE WHEN answered THEN 'answered' ELSE state END AS contact_state, decision, decision = 'alternate' AS alternate_selected, shared AS shared_email, shared AND supplier_id IS NULL AS ambiguous_identity,
          CASE WHEN shared AND supplier_id IS NULL THEN ['ambiguous_supplier_identity'] WHEN decision = 'skipped' THEN list_filter(['already_contacted', CASE WHEN before THEN 'same_request_already_contacted' END, CASE WHEN answered THEN 'answered' WHEN state <> 'not_sent' THEN state END], lambda z: z IS NOT NULL) ELSE [] END AS reasons,
          coalesce(name, '') AS company_name, identity_group FROM y)"""
CHECKED = f"""{CHOICE},
    v AS (SELECT a."row", a.campaign_id, a.has_context, lower(trim(a.email)) AS asked_email, regexp_full_match(lower(trim(a.email)), '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') AS valid FROM asked a),
    d AS (SELECT campaign_id, asked_email FROM v WHERE valid GROUP BY 1, 2 HAVING count(*) > 1),
    z AS (SELECT v.*, c.* EXCLUDE ("row"), c.email IS NOT NULL AS sent, d.campaign_id IS NOT NULL AS twice, EXISTS (SELECT 1 FROM barred b WHERE b.workspace_id = c.workspace_id AND b.recipient = coalesce(c.email, c.requested_email)) AS suppressed,
          EXISTS (SELECT 1 FROM bounced b WHERE b.request_id = c.request_id AND b.supplier_id = coalesce(c.selected_supplier_id, c.requested_supplier_id)) AS hard, EXISTS (SELECT 1 FROM unresolved b WHERE b.request_id = c.request_id AND b.supplier_id = coalesce(c.selected_supplier_id, c.requested_supplier_id)) AS open
          FROM v JOIN choices c ON c."row" = v."row" LEFT JOIN d ON v.valid AND d.campaign_id = v.campaign_id AND d.asked_email = v.asked_email),
    q AS (SELECT *, CASE WHEN NOT valid THEN ['invalid_email'] ELSE list_filter(list_concat([CASE WHEN twice THEN 'duplicate' END], reasons, [CASE WHEN suppressed THEN 'suppressed' END, CASE WHEN hard THEN 'hard_bounce' END, CASE WHEN sent AND open THEN 'unresolved_safety_state' END]), lambda t: t IS NOT NULL) END AS why,
          CASE WHEN valid THEN list_filter([CASE WHEN NOT has_context THEN 'missing_supplier_context' END, CASE WHEN shared_email THEN 'shared_email_across_companies' END], lambda t: t IS NOT NULL) ELSE [] END AS warnings FROM z)"""


def companions(t: Tables) -> dict[str, DataFrame]:
    tables = {"orders": t.orders, "customer": t.customer}
    return {name: t.orders.sparkSession.sql(sql.replace('"row"', "`row`"), **{k: v for k, v in tables.items() if f"{{{k}}}" in sql}) for name, sql in DERIVED.items()}


def chosen(c: dict[str, DataFrame]) -> DataFrame:
    return contacts.choose_contacts(c["asked"].drop("campaign_id", "has_context"), c["cards"], c["members"], c["listed"], contacts.identity_groups(c["people"]), c["contacted"])


@query("TXT85", "TRN22", sql=f"""WITH {CHOICE} SELECT * EXCLUDE (reasons), array_to_string(reasons, ',') AS reasons FROM choices""")
def card_contacts(t: Tables) -> DataFrame:
    """Which contact of its company's card each message goes to, or why to none."""
    return chosen(companions(t)).withColumn("reasons", F.array_join("reasons", ","))


@query("TXT86", "TXT87", sql=f"""
    WITH {CHECKED} SELECT campaign_id, "row", requested_email, email, selected_supplier_id, CASE WHEN valid THEN CASE WHEN sent AND contact_state = 'not_sent' THEN 'never_used' ELSE contact_state END END AS contact_state, alternate_selected,
    CASE WHEN valid THEN split_part(coalesce(email, requested_email), '@', 2) ELSE '' END AS domain, CASE WHEN len(why) > 0 THEN 'excluded' ELSE 'eligible' END AS status, array_to_string(why, ',') AS reasons, array_to_string(warnings, ',') AS warnings FROM q""")
def preflight_recipients(t: Tables) -> DataFrame:
    """Each recipient of each campaign: eligible, or excluded for these reasons."""
    c = companions(t)
    found = contacts.checked_recipients(c["asked"], chosen(c), c["barred"], c["bounced"], c["unresolved"])
    return found.select("campaign_id", "row", "requested_email", "email", "selected_supplier_id", "contact_state", "alternate_selected", "domain", "status", F.array_join("reasons", ",").alias("reasons"), F.array_join("warnings", ",").alias("warnings"))


STOPPED = ["invalid_email", "duplicate_recipient", "ambiguous_supplier_identity", "same_request_already_contacted", "duplicate", "suppressed", "hard_bounce", "unresolved_safety_state"]


def some_sql(cases: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in cases.items()) + "], lambda t: t IS NOT NULL)"


@query("TXT86", sql=f"""
    WITH {CHECKED},
    n AS (SELECT campaign_id, count(*) AS planned, count(*) FILTER (len(why) > 0) AS excluded, count(*) FILTER (len(why) = 0) AS eligible, count(*) FILTER (alternate_selected AND valid) AS alternate_selected, count(DISTINCT split_part(requested_email, '@', 2)) FILTER (valid) AS unique_domains,
        count(*) FILTER (valid AND NOT sent AND list_contains(why, 'already_contacted')) AS already_contacted, count(*) FILTER (valid AND NOT sent AND list_contains(why, 'answered')) AS answered, 0 AS no_eligible_email,
        count(*) FILTER (valid AND NOT sent AND len(list_filter(why, lambda t: t NOT IN {tuple(contacts.PLAIN_REASONS)})) > 0) AS errors, count(*) FILTER (valid) AS n_valid,
        bool_or(NOT valid) AS invalid_email, bool_or(twice AND valid) AS duplicate_recipient, bool_or(valid AND NOT sent AND list_contains(why, 'ambiguous_supplier_identity')) AS ambiguous_supplier_identity, bool_or(valid AND NOT sent AND list_contains(why, 'same_request_already_contacted')) AS same_request_already_contacted,
        bool_or(valid AND sent AND twice) AS duplicate, bool_or(valid AND suppressed) AS suppressed, bool_or(valid AND hard) AS hard_bounce, bool_or(valid AND sent AND open) AS unresolved_safety_state, bool_or(valid AND NOT has_context) AS no_context, bool_or(valid AND shared_email) AS shared FROM q GROUP BY 1),
    g AS (SELECT campaign_id, max(k) AS largest FROM (SELECT campaign_id, split_part(requested_email, '@', 2), count(*) AS k FROM q WHERE valid GROUP BY 1, 2) GROUP BY 1),
    e AS (SELECT c.*, c.provider IS NOT NULL AND request_found AS ok, n.* EXCLUDE (campaign_id), coalesce(g.largest, 0) AS largest FROM campaigns c LEFT JOIN n ON n.campaign_id = c.campaign_id LEFT JOIN g ON g.campaign_id = c.campaign_id),
    b AS (SELECT *, list_concat({some_sql({"provider_or_account_unavailable": "provider IS NULL", "request_not_found": "provider IS NOT NULL AND NOT request_found", "campaign_size_out_of_range": "ok AND planned > 200",
        "empty_subject": "ok AND subject = ''", "misleading_reply_subject_without_thread": "ok AND starts_with(subject, 'Re:')", "empty_body": "ok AND trim(body) = ''", "broken_placeholder:odd": "ok AND contains(body, 'odd')", **{x: f"ok AND {x}" for x in STOPPED}})}) AS blocks,
        {some_sql({"campaign_exceeds_daily_budget": "ok AND planned > 100", "subject_all_caps": "ok AND subject = 'PRICE!!!'", "subject_excessive_exclamation": "ok AND subject = 'PRICE!!!'", "many_recipients_same_domain": "ok AND planned >= 10 AND largest >= 0.5 * greatest(n_valid, 1)", "large_campaign_review": "ok AND planned >= 50",
        "provider_policy_warning": "ok AND provider = 'Yandex' AND planned >= 10", "missing_supplier_context": "ok AND no_context", "shared_email_across_companies": "ok AND shared", "some_recipients_skipped": "ok AND already_contacted > 0"})} AS warnings FROM e),
    w AS (SELECT *, CASE WHEN ok AND len(blocks) = 0 AND eligible = 0 THEN ['no_eligible_recipients'] ELSE blocks END AS stops FROM b)
    SELECT campaign_id, CASE WHEN len(stops) > 0 THEN 'BLOCK' WHEN len(warnings) > 0 THEN 'WARNING' ELSE 'PASS' END AS status, planned, eligible, excluded, unique_domains, alternate_selected, already_contacted, answered, no_eligible_email, errors, array_to_string(stops, ',') AS blocks, array_to_string(warnings, ',') AS warnings FROM w""")
def campaign_preflight(t: Tables) -> DataFrame:
    """What stops a campaign or is worth a look before it is sent."""
    c = companions(t)
    recipients = contacts.checked_recipients(c["asked"], chosen(c), c["barred"], c["bounced"], c["unresolved"])
    (s_blocks, s_warnings), (b_blocks, b_warnings) = messages.subject_quality(F.col("subject")), messages.body_quality(F.col("body"), F.lit(True), F.lit(False))
    campaigns = c["campaigns"].select("campaign_id", "provider", "request_found", F.concat(s_blocks, b_blocks).alias("content_blocks"), F.concat(s_warnings, b_warnings).alias("content_warnings"))
    found = contacts.campaign_preflight(campaigns, recipients)
    return found.withColumn("blocks", F.array_join("blocks", ",")).withColumn("warnings", F.array_join("warnings", ","))
