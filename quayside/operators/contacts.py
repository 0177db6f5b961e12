"""Which address of a company a message goes to, and what speaks against a whole campaign before anything is sent.

All rows of all campaigns are decided at once: a card's contacts are reduced to one row a card before they meet the
rows that ask for it, and conditions that hold if something exists are counted or marked by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.campaigns import address

#: States of a contact that are named as the reason for leaving it out, and reasons that are no errors.
NAMED_STATES = ["queued", "accepted", "failed", "delivery_unknown", "bounced", "cancelled"]
PLAIN_REASONS = ["already_contacted", "answered", "no_eligible_email", "same_request_already_contacted", *NAMED_STATES]
STOPS = ["duplicate", "suppressed", "hard_bounce", "unresolved_safety_state"]
EXCLUDED_STOPS = ["suppressed", "hard_bounce", "same_request_already_contacted"]


def identity_groups(suppliers: DataFrame) -> DataFrame:
    """workspace_id, email, supplier_id, identity: rows of one company, by its number and link, are one identity; others their own."""
    linked = F.col("global_id").isNotNull() & F.coalesce(F.trim("inn").rlike("^(?:[0-9]{10}|[0-9]{12})$"), F.lit(False))
    name = F.when(linked, F.concat(F.lit("global:"), F.col("global_id").cast("string"))).otherwise(F.concat(F.lit("supplier:"), F.col("id").cast("string")))
    return suppliers.select("workspace_id", address(F.col("email")).alias("email"), F.col("id").alias("supplier_id"), name.alias("identity")).where("email <> ''")


def contact_state(delivery: Column, response: Column) -> Column:
    return F.when(response == "answered", "answered").otherwise(F.coalesce(F.nullif(delivery, F.lit("")), F.lit("not_sent")))


def choose_contacts(asked: DataFrame, cards: DataFrame, members: DataFrame, contacts: DataFrame, identities: DataFrame, contacted: DataFrame, repeat: bool = False) -> DataFrame:
    """asked with at most one contact for each row: decision (primary, alternate, explicit_repeat, skipped) and reasons.

    asked: row (unique), workspace_id, request_id, supplier_id or null, email, host. cards: card_id, request_id, name, host,
    response_status. members: card_id, supplier_id. contacts: card_id, place, supplier_id, email, host, delivery_status,
    response_status. identities as of identity_groups(). contacted: workspace_id, request_id, email of earlier messages.
    A supplier's card is that of the smallest card_id; without a supplier, the one card that has the address. With
    `repeat` the address that is asked for is taken whatever its state, unless nobody knows whose it is.
    """
    rows = asked.withColumn("requested_email", address(F.col("email"))).drop("email").withColumnRenamed("host", "asked_host")
    wanted = rows.select("row", "workspace_id", "request_id", "requested_email", "supplier_id")
    here = members.join(cards.select("card_id", "request_id"), "card_id")
    by_supplier = here.groupBy("request_id", "supplier_id").agg(F.min("card_id").alias("of_supplier"))
    at = contacts.withColumn("email", address(F.col("email"))).where("email <> ''")
    once = at.groupBy("card_id", "email").agg(F.min_by(F.struct("supplier_id", "host", contact_state(F.col("delivery_status"), F.col("response_status")).alias("state"), "place"), "place").alias("c"))
    by_email = once.join(cards.select("card_id", "request_id"), "card_id").groupBy("request_id", "email").agg(F.when(F.count("*") == 1, F.min("card_id")).alias("of_email"))
    rows = rows.join(by_supplier, ["request_id", "supplier_id"], "left").join(by_email.withColumnRenamed("email", "requested_email"), ["request_id", "requested_email"], "left")
    rows = rows.withColumn("card_id", F.when(F.col("supplier_id").isNotNull(), F.col("of_supplier")).otherwise(F.col("of_email")))

    unused = F.when(F.col("c.state") == "not_sent", F.struct("c.place", "email", "c.supplier_id", "c.host"))
    facts = once.groupBy("card_id").agg(F.min(unused).alias("unused"), F.bool_or(F.col("c.state") == "answered").alias("any_answer"))
    named = cards.select("card_id", F.col("name").alias("card_name"), F.col("host").alias("card_host"), (F.col("response_status") == "answered").alias("card_answered"))
    rows = rows.join(named, "card_id", "left").join(facts, "card_id", "left").join(once.select("card_id", F.col("email").alias("requested_email"), F.col("c").alias("own")), ["card_id", "requested_email"], "left")

    groups = identities.groupBy("workspace_id", "email").agg(F.count_distinct("identity").alias("identities")).withColumnRenamed("email", "requested_email")
    mine = wanted.join(identities.select("workspace_id", F.col("email").alias("requested_email"), "supplier_id", "identity"), ["workspace_id", "requested_email", "supplier_id"]).groupBy("row").agg(F.min("identity").alias("identity_group"))
    before = contacted.select("workspace_id", "request_id", address(F.col("email")).alias("requested_email")).distinct().withColumn("before", F.lit(True))
    rows = rows.join(groups, ["workspace_id", "requested_email"], "left").join(mine, "row", "left").join(before, ["workspace_id", "request_id", "requested_email"], "left")

    shared = F.coalesce(F.col("identities") > 1, F.lit(False))
    ambiguous = shared & F.col("supplier_id").isNull()
    host = F.coalesce(F.nullif(F.trim("asked_host"), F.lit("")), F.nullif(F.trim("card_host"), F.lit("")), F.lit(""))
    listed = F.coalesce(F.nullif(F.trim("own.host"), F.lit("")), F.nullif(F.trim("card_host"), F.lit("")), F.lit(""))
    own = F.struct(F.when(F.col("own").isNotNull(), F.col("own.supplier_id")).otherwise(F.col("supplier_id")).alias("supplier_id"), F.col("requested_email").alias("email"), F.when(F.col("own").isNotNull(), listed).otherwise(host).alias("host"))
    other = F.struct(F.col("unused.supplier_id").alias("supplier_id"), F.col("unused.email").alias("email"), F.coalesce(F.nullif(F.trim("unused.host"), F.lit("")), F.nullif(F.trim("card_host"), F.lit("")), F.lit("")).alias("host"))
    state = F.coalesce(F.col("own.state"), F.lit("not_sent"))
    answered = F.coalesce("card_answered", F.lit(False)) | F.coalesce("any_answer", F.lit(False))
    decision = F.when(ambiguous, "skipped").when(F.lit(repeat), "explicit_repeat").when(answered, "skipped").when(state == "not_sent", "primary").when(F.col("unused").isNotNull(), "alternate").otherwise("skipped")
    chosen = F.when(decision.isin("primary", "explicit_repeat"), own).when(decision == "alternate", other)
    skipped = [
        (F.lit(True), F.lit("already_contacted")),
        (F.coalesce("before", F.lit(False)), F.lit("same_request_already_contacted")),
        (answered, F.lit("answered")),
        (~answered & state.isin(NAMED_STATES), state),
    ]
    why = F.array_compact(F.array(*[F.when(c, x) for c, x in skipped]))
    none = F.array().cast("array<string>")
    reasons = F.when(ambiguous, F.array(F.lit("ambiguous_supplier_identity"))).when(chosen.isNull(), why).otherwise(none)
    return rows.select(
        "row", "workspace_id", "request_id", "requested_email", F.col("supplier_id").alias("requested_supplier_id"),
        chosen["supplier_id"].alias("supplier_id"), chosen["email"].alias("email"), F.when(chosen.isNotNull(), F.coalesce(F.nullif(chosen["host"], F.lit("")), F.col("asked_host"), F.lit(""))).alias("host"),
        F.coalesce(chosen["supplier_id"], F.when(chosen.isNull(), own["supplier_id"])).alias("selected_supplier_id"),
        F.when(answered, "answered").otherwise(state).alias("contact_state"), decision.alias("decision"), (decision == "alternate").alias("alternate_selected"),
        shared.alias("shared_email"), ambiguous.alias("ambiguous_identity"), reasons.alias("reasons"), F.coalesce("card_name", F.lit("")).alias("company_name"), "identity_group",
    )


def email_domain(email: Column) -> Column:
    return F.when(F.contains(email, F.lit("@")), F.substring_index(email, "@", -1)).otherwise("")


def checked_recipients(asked: DataFrame, choices: DataFrame, suppressed: DataFrame, bounced: DataFrame, unresolved: DataFrame, repeat: bool = False) -> DataFrame:
    """One row for each recipient of a campaign: status, reasons and warnings.

    asked as in choose_contacts() with campaign_id and has_context; choices is its result. suppressed: workspace_id, recipient.
    bounced, unresolved: request_id, supplier_id. An address twice in a campaign is a duplicate; one that is no address is excluded.
    """
    plain = address(F.col("email"))
    valid = plain.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
    rows = asked.select("row", "campaign_id", "has_context", valid.alias("valid"), plain.alias("asked_email"))
    twice = rows.where("valid").groupBy("campaign_id", "asked_email").agg((F.count("*") > 1).alias("twice"))
    rows = rows.join(twice, ["campaign_id", "asked_email"], "left").join(choices, "row")
    target = F.coalesce("email", "requested_email")
    rows = rows.withColumn("target", target).withColumn("whose", F.coalesce("selected_supplier_id", "requested_supplier_id"))
    rows = rows.join(suppressed.select("workspace_id", F.col("recipient").alias("target")).distinct().withColumn("suppressed", F.lit(True)), ["workspace_id", "target"], "left")
    for fact, name in ((bounced, "hard_bounce"), (unresolved, "unresolved")):
        rows = rows.join(fact.select("request_id", F.col("supplier_id").alias("whose")).distinct().withColumn(name, F.lit(True)), ["request_id", "whose"], "left")
    yes = lambda name: F.coalesce(name, F.lit(False))
    sent = F.col("email").isNotNull()
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in ((yes("suppressed"), "suppressed"), (yes("hard_bounce"), "hard_bounce"), (sent & yes("unresolved") & ~F.lit(repeat), "unresolved_safety_state"))]))
    own = F.when(yes("twice"), F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>"))
    reasons = F.when(~F.col("valid"), F.array(F.lit("invalid_email"))).otherwise(F.concat(own, F.col("reasons"), flags))
    warnings = F.array_compact(F.array(*[
        F.when(F.col("valid") & c, F.lit(n))
        for c, n in (
            (~yes("has_context"), "missing_supplier_context"),
            (yes("shared_email"), "shared_email_across_companies"),
            (F.col("decision") == "explicit_repeat", "explicit_repeat_enabled"),
            (sent & yes("unresolved") & F.lit(repeat), "manual_resend_after_delivery_unknown"),
        )
    ]))
    found = rows.withColumn("reasons", reasons).withColumn("warnings", warnings).withColumn("chosen", sent)
    stops = F.when(~F.col("valid"), F.array(F.lit("invalid_email"))).when(sent, F.filter("reasons", lambda r: r.isin(STOPS))).otherwise(F.filter("reasons", lambda r: r.isin([*EXCLUDED_STOPS, "ambiguous_supplier_identity"])))
    # what an unsent row's duplicates are told is said once for the campaign
    stops = F.concat(stops, F.when(yes("twice") & F.col("valid"), F.array(F.lit("duplicate_recipient"))).otherwise(F.array().cast("array<string>")))
    return found.select(
        "campaign_id", "row", "requested_email", "email", "selected_supplier_id", F.when(F.col("valid"), F.when(sent & (F.col("contact_state") == "not_sent"), "never_used").otherwise(F.col("contact_state"))).alias("contact_state"),
        "alternate_selected", F.when(F.col("valid"), email_domain(F.coalesce("email", "requested_email"))).otherwise("").alias("domain"), F.when(F.size("reasons") > 0, "excluded").otherwise("eligible").alias("status"), "reasons", "warnings", stops.alias("stops"), "chosen", "valid",
    )


def campaign_preflight(campaigns: DataFrame, recipients: DataFrame, max_recipients: int = 200, max_per_day: int = 100, same_domain: float = 0.5, strict_provider: str = "yandex") -> DataFrame:
    """One row a campaign: counts, blocks and warnings in a fixed order, and PASS, WARNING or BLOCK.

    campaigns: campaign_id, provider or null, request_found, content_blocks and content_warnings (arrays, those of its subject and body).
    recipients as of checked_recipients(). Domains are counted on the addresses that were asked for.
    """
    domains = recipients.where("valid").groupBy("campaign_id", email_domain(F.col("requested_email")).alias("domain")).agg(F.count("*").alias("n"))
    domains = domains.groupBy("campaign_id").agg(F.count_if(F.col("domain") != "").alias("unique_domains"), F.max("n").alias("largest"), F.sum("n").alias("valid"))
    has = lambda name: F.array_contains("reasons", name)
    skipped = F.col("valid") & ~F.col("chosen")
    n = lambda c, name: F.count_if(c).alias(name)
    counts = recipients.groupBy("campaign_id").agg(
        F.count("*").alias("planned"), n(F.col("status") == "excluded", "excluded"), n(F.col("status") == "eligible", "eligible"), n(F.col("alternate_selected") & F.col("valid"), "alternate_selected"),
        n(skipped & has("already_contacted"), "already_contacted"), n(skipped & has("answered"), "answered"), n(skipped & has("no_eligible_email"), "no_eligible_email"),
        n(skipped & F.exists("reasons", lambda r: ~r.isin(PLAIN_REASONS)), "errors"), F.array_distinct(F.flatten(F.collect_set("stops"))).alias("stops"), F.array_distinct(F.flatten(F.collect_set("warnings"))).alias("said"),
    )
    rows = campaigns.join(counts, "campaign_id", "left").join(domains, "campaign_id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    numbers = ["planned", "eligible", "excluded", "unique_domains", "alternate_selected", "already_contacted", "answered", "no_eligible_email", "errors"]
    rows = rows.select(*campaigns.columns, *[zero(c).alias(c) for c in numbers], zero("largest").alias("largest"), zero("valid").alias("valid"), *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("stops", "said")])
    unavailable = F.col("provider").isNull()
    open_ = ~unavailable & F.coalesce("request_found", F.lit(False))
    planned = F.col("planned")
    stopped = lambda name: F.array_contains("stops", name)
    said = lambda name: F.array_contains("said", name)
    names = lambda pairs: F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in pairs]))
    first = names([(unavailable, "provider_or_account_unavailable"), (~unavailable & ~open_, "request_not_found"), (open_ & ((planned == 0) | (planned > max_recipients)), "campaign_size_out_of_range")])
    order = ["invalid_email", "duplicate_recipient", "ambiguous_supplier_identity", "same_request_already_contacted", "duplicate", "suppressed", "hard_bounce", "unresolved_safety_state"]
    blocks = F.concat(first, F.when(open_, F.coalesce("content_blocks", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")), names([(open_ & stopped(x), x) for x in order]))
    rows = rows.withColumn("blocks", F.array_distinct(blocks))
    rows = rows.withColumn("blocks", F.when(open_ & (F.size("blocks") == 0) & (F.col("eligible") == 0), F.array(F.lit("no_eligible_recipients"))).otherwise(F.col("blocks")))
    crowded = (planned >= 10) & (F.col("largest") >= same_domain * F.greatest(F.col("valid"), F.lit(1)))
    warnings = F.concat(
        names([(open_ & (planned > max_per_day), "campaign_exceeds_daily_budget")]),
        F.when(open_, F.coalesce("content_warnings", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")),
        names([
            (open_ & crowded, "many_recipients_same_domain"), (open_ & (planned >= 50), "large_campaign_review"), (open_ & (F.lower("provider") == strict_provider) & (planned >= 10), "provider_policy_warning"),
            *[(open_ & said(x), x) for x in ("missing_supplier_context", "shared_email_across_companies", "explicit_repeat_enabled", "manual_resend_after_delivery_unknown")],
            (open_ & ((F.col("already_contacted") > 0) | (F.col("no_eligible_email") > 0)), "some_recipients_skipped"),
        ]),
    )
    rows = rows.withColumn("warnings", F.array_distinct(warnings))
    status = F.when(F.size("blocks") > 0, "BLOCK").when(F.size("warnings") > 0, "WARNING").otherwise("PASS")
    return rows.select("campaign_id", status.alias("status"), *numbers, "blocks", "warnings")
