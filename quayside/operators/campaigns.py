"""Campaign counters and retry verdicts over companion tables, for all campaigns or candidates at once.

Every fact is one pre-aggregate by its key, left-joined to the rows it speaks about; a condition that holds if some row
exists is a semi join that marks its key. No row looks anything up by itself, and reasons are an array in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.functions.messages import bounce_kind
from quayside.functions.status import masked_address

#: Stages of a transport dialogue after which an answer is final.
FINAL_STAGES = ["mail_from", "rcpt_to", "data_command", "post_data"]
OUTCOMES = ["accepted", "transient_rejected", "permanent_rejected", "uncertain"]


def address(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def accepted_messages(messages: DataFrame, jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Outbound messages that some transport took: by their own state, their job's, or an attempt's outcome."""
    took = attempts.where("outcome = 'accepted'").select(F.col("job_id").alias("j_id")).distinct()
    by_job = jobs.join(took, F.col("id") == F.col("j_id"), "left").groupBy(F.col("message_id").alias("m_id")).agg(F.max((F.col("status") == "sent") | F.col("j_id").isNotNull()).alias("job_took"))
    joined = messages.where("direction = 'outbound'").join(by_job, F.col("id") == F.col("m_id"), "left")
    return joined.where((F.col("status") == "sent") | F.coalesce("job_took", F.lit(False)))


def accepted_provider(targets: DataFrame, messages: DataFrame, jobs: DataFrame, attempts: DataFrame, accounts: DataFrame, reconciled: DataFrame) -> DataFrame:
    """targets (request_id, supplier_id, recipient among their columns) with provider, that of the latest acceptance.

    Messages count for the supplier, reconciled events for the supplier at that recipient.
    """
    at = F.struct(F.coalesce("sent_at", "created_at").alias("at"), "id")
    sent = accepted_messages(messages, jobs, attempts).select("id", "request_id", "supplier_id", "mail_account_id", "sent_at", "created_at")
    sent = sent.join(accounts.select(F.col("id").alias("a_id"), "provider"), F.col("mail_account_id") == F.col("a_id"))
    sent = sent.groupBy("request_id", "supplier_id").agg(F.max(F.struct(at.alias("at"), "provider")).alias("by_message"))
    event = F.struct(F.struct(F.col("accepted_at").alias("at"), "id").alias("at"), F.col("provider_type").alias("provider"))
    events = reconciled.where("outcome = 'accepted'").groupBy("request_id", "supplier_id", F.col("normalized_recipient").alias("recipient")).agg(F.max(event).alias("by_event"))
    joined = targets.join(sent, ["request_id", "supplier_id"], "left").join(events, ["request_id", "supplier_id", "recipient"], "left")
    return joined.withColumn("provider", F.greatest("by_message", "by_event")["provider"]).withColumn("reconciled", F.col("by_event").isNotNull()).drop("by_message", "by_event")


def hard_bounced(states: DataFrame, messages: DataFrame) -> DataFrame:
    """request_id, supplier_id whose state is a failure that bounced for good."""
    last = messages.select(F.col("id").alias("m_id"), "from_email", "subject", "body_text")
    joined = states.where("status = 'failed'").join(last, F.col("last_message_id") == F.col("m_id"), "left")
    hard = F.contains(F.lower(F.coalesce("last_error", F.lit(""))), F.lit("bounce")) | F.coalesce(bounce_kind(F.col("from_email"), F.col("subject"), F.col("body_text")) == "hard", F.lit(False))
    return joined.where(hard).select("request_id", "supplier_id").distinct()


def transient_health(attempts: DataFrame, key: str, window: int = 10) -> DataFrame:
    """key, streak (transient rejections since the last other outcome), recent, transient (among the last `window`)."""
    order = F.struct("at", "id")
    rows = attempts.where(F.col("outcome").isin(OUTCOMES)).withColumn("bad", F.col("outcome") == "transient_rejected")
    other = rows.where("not bad").groupBy(key).agg(F.max(order).alias("other"))
    streak = rows.where("bad").join(other, key, "left").where(F.col("other").isNull() | (order > F.col("other"))).groupBy(key).agg(F.count("*").alias("streak"))
    last = rows.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(F.col("at").desc(), F.col("id").desc()))).where(F.col("n") <= window)
    recent = last.groupBy(key).agg(F.count("*").alias("recent"), F.count_if("bad").alias("transient"))
    return recent.join(streak, key, "left").select(key, F.coalesce("streak", F.lit(0)).alias("streak"), "recent", "transient")


def campaign_summaries(campaigns: DataFrame, targets: DataFrame, jobs: DataFrame, messages: DataFrame, attempts: DataFrame, accounts: DataFrame, reconciled: DataFrame, states: DataFrame) -> DataFrame:
    """One row a campaign: its counters, rates, providers and excluded targets; accepted history outweighs a stale job."""
    kind = F.lower(F.coalesce("provider_classification", F.lit("")))
    facts = attempts.groupBy(F.col("job_id").alias("f_job")).agg(
        F.bool_or(F.col("outcome") == "transient_rejected").alias("transient"),
        F.bool_or(F.col("outcome") == "accepted").alias("took"),
        F.bool_or(kind.contains("spam") | kind.contains("policy")).alias("rejected"),
        F.bool_or(kind.isin("supplier-suppressed", "suppression")).alias("barred"),
    )
    rows = targets.join(campaigns.select(F.col("id").alias("campaign_id"), "request_id"), "campaign_id").withColumn("recipient", F.lower(F.coalesce("normalized_email", F.lit(""))))
    rows = accepted_provider(rows, messages, jobs, attempts, accounts, reconciled)
    rows = rows.join(jobs.select(F.col("id").alias("job_id"), F.col("status").alias("job")), "job_id", "left").join(facts, F.col("job_id") == F.col("f_job"), "left")
    rows = rows.join(hard_bounced(states, messages).withColumn("bounced", F.lit(True)), ["request_id", "supplier_id"], "left")
    live = F.coalesce(F.col("status") != "excluded", F.lit(True))
    job, yes = F.coalesce("job", F.lit("")), lambda name: F.coalesce(name, F.lit(False))
    accepted = live & F.col("provider").isNotNull()
    open_ = live & ~accepted
    n = lambda condition, name: F.count_if(condition).alias(name)
    counts = rows.groupBy("campaign_id").agg(
        F.count("*").alias("planned"),
        n(~live, "excluded"),
        n(open_ & (job == "queued"), "queued"),
        n(open_ & (job == "queued") & (F.col("status") == "waiting"), "waiting"),
        n(live & F.col("f_job").isNotNull(), "attempted"),
        n(accepted, "accepted"),
        n(live & (job == "sent"), "accepted_in_campaign"),
        n(live & F.col("reconciled"), "accepted_reconciled"),
        n(open_ & (job == "failed") & ~yes("transient"), "failed"),
        n(open_ & yes("transient") & (job != "sent"), "failed_transient"),
        n(open_ & (job == "queued") & yes("transient") & ~yes("took"), "historical_disputed_transient"),
        n(open_ & (job == "delivery_unknown"), "delivery_unknown"),
        (n(~live & F.coalesce(F.startswith("exclusion_reason", F.lit("suppressed")), F.lit(False)), "s1") + F.count_if(live & yes("barred"))).alias("suppressed"),
        n(open_ & (job == "cancelled"), "cancelled"),
        n(~accepted & F.col("status").isin("eligible", "waiting") & job.isin("queued", "sending", ""), "remaining"),
        n(live & yes("rejected"), "provider_rejection_count"),
        F.count_distinct(F.when(yes("bounced"), F.col("supplier_id"))).alias("hard_bounces"),
    )
    providers = rows.where(accepted).groupBy("campaign_id", "provider").count()
    # a handful of providers
    providers = providers.groupBy("campaign_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "count")))).alias("accepted_by_provider"))
    of = targets.where("job_id is not null").select("campaign_id", "job_id").distinct()
    tries = attempts.join(of, "job_id").select("campaign_id", "outcome", F.coalesce("ended_at", "started_at").alias("at"), "id")
    joined = campaigns.withColumnRenamed("id", "campaign_id").join(counts, "campaign_id", "left").join(providers, "campaign_id", "left").join(transient_health(tries, "campaign_id"), "campaign_id", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    numbers = [c for c in counts.columns if c not in ("campaign_id", "failed")]
    permanent = F.greatest(zero("failed"), zero("hard_bounces"))
    done = F.greatest(zero("attempted"), zero("accepted") + permanent + zero("failed_transient") + zero("delivery_unknown"))
    rate = lambda part, name: F.when(done > 0, part / done).otherwise(0.0).alias(name)
    return joined.select(
        "campaign_id",
        "request_id",
        *[zero(c).alias(c) for c in numbers],
        permanent.alias("failed_permanent"),
        (zero("planned") - zero("excluded")).alias("eligible"),
        zero("queued").alias("queued_provider_neutral"),
        F.coalesce("accepted_by_provider", F.create_map().cast("map<string,bigint>")).alias("accepted_by_provider"),
        rate(permanent, "permanent_failure_rate"),
        rate(zero("failed_transient"), "transient_failure_rate"),
        rate(zero("delivery_unknown"), "unknown_rate"),
        rate(zero("provider_rejection_count"), "provider_rejection_rate"),
        *[zero(c).alias(c) for c in ("streak", "recent", "transient")],
    )


def suppressed_rows(blacklist: DataFrame, suppliers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(workspace_id, key) and (workspace_id, recipient) that are barred and not restored."""
    barred = blacklist.where("restored_at is null").select("workspace_id", F.col("external_key").alias("key"), "level")
    direct = barred.where("level = 'email'").select("workspace_id", F.regexp_replace("key", "^email:", "").alias("recipient"))
    known = suppliers.select("external_key", F.lower("email").alias("recipient")).join(barred, F.col("external_key") == F.col("key")).select("workspace_id", "recipient")
    return barred.select("workspace_id", "key").distinct(), direct.union(known).where("recipient <> ''").distinct()


def answered_rows(states: DataFrame, suppliers: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(request_id, supplier_id), (request_id, recipient) and (request_id, supplier_id, recipient) with an answer."""
    replied = states.where("status in ('replied', 'answered')").select("request_id", "supplier_id").distinct()
    at = replied.join(suppliers.select(F.col("id").alias("supplier_id"), address(F.col("email")).alias("recipient")), "supplier_id").select("request_id", "recipient").where("recipient <> ''").distinct()
    sender = address(F.col("from_email"))
    person = ~F.startswith(sender, F.lit("mailer-daemon@")) & ~F.startswith(sender, F.lit("postmaster@")) & bounce_kind(F.col("from_email"), F.col("subject"), F.col("body_text")).isNull()
    wrote = messages.where("direction = 'inbound'").where(person).select("request_id", "supplier_id", sender.alias("recipient")).distinct()
    return replied, at, wrote


def retry_verdicts(asked: DataFrame, jobs: DataFrame, messages: DataFrame, attempts: DataFrame, evidence: DataFrame, accounts: DataFrame, suppliers: DataFrame, reconciled: DataFrame, blacklist: DataFrame, states: DataFrame, retries: DataFrame, source_provider: str, target_provider: str) -> DataFrame:
    """asked with recipient_masked, blocked_reasons in their order, and eligible: whether a failed message may go out again.

    asked: row (unique), workspace_id, request_id, original_job_id, original_message_id, original_attempt_id (or null),
    target_account_id. messages has resend_of_message_id.
    """
    m = messages.where("direction = 'outbound'").select(F.col("id").alias("m_id"), F.col("workspace_id").alias("m_workspace"), F.col("request_id").alias("m_request"), "supplier_id", F.col("mail_account_id").alias("m_account"), address(F.col("to_email")).alias("recipient"), F.col("status").alias("m_status"), "created_at", "resend_of_message_id")
    j = jobs.select(F.col("id").alias("j_id"), F.col("message_id").alias("j_message"), F.col("status").alias("j_status"))
    same = (F.col("m_id") == F.col("original_message_id")) & (F.col("m_workspace") == F.col("workspace_id")) & (F.col("m_request") == F.col("request_id"))
    source = asked.join(j, (F.col("j_id") == F.col("original_job_id")) & (F.col("j_message") == F.col("original_message_id"))).join(m, same)
    source = source.join(accounts.select(F.col("id").alias("m_account"), F.col("provider").alias("m_provider")), "m_account", "left").join(suppliers.select(F.col("id").alias("supplier_id"), F.lower(F.trim("external_key")).alias("key")), "supplier_id", "left")
    rows = asked.join(source.select("row", F.lit(True).alias("has_source"), "supplier_id", "m_account", "recipient", "m_status", "created_at", "resend_of_message_id", "j_status", "m_provider", "key"), "row", "left")
    target = accounts.select(F.col("id").alias("target_account_id"), F.col("workspace_id"), F.lit(True).alias("has_target"), F.col("provider").alias("t_provider"), F.col("status").alias("t_status"))
    rows = rows.join(target, ["target_account_id", "workspace_id"], "left")
    tried = attempts.join(evidence.withColumnRenamed("attempt_id", "id"), "id", "left").select("job_id", "message_id", F.struct("id", "outcome", F.coalesce("ended_at", "started_at").alias("at"), "irreversible_reached", "smtp_stage", "smtp_code", "provider_response_safe").alias("try"))
    mine = rows.where("has_source").join(tried, (F.col("job_id") == F.col("original_job_id")) & (F.col("message_id") == F.col("original_message_id")))
    wanted = F.col("original_attempt_id").isNull() | (F.col("try.id") == F.col("original_attempt_id"))
    mine = mine.groupBy("row").agg(F.max(F.when(wanted, F.col("try"))).alias("try"), F.count("*").alias("tries"))
    rows = rows.join(mine, "row", "left").withColumn("recipient", F.coalesce("recipient", F.lit(""))).withColumn("since", F.coalesce("try.at", "created_at"))

    key = rows.where("has_source").select("row", "workspace_id", "request_id", "recipient", "supplier_id", "key", "since", F.col("try.id").alias("own"), F.col("original_message_id").alias("own_message"))

    def mark(name: str, *facts: tuple[DataFrame, list[str], Column | None]) -> None:
        """A column that says whether one of the facts has a row for the key."""
        nonlocal rows
        found = None
        for fact, on, more in facts:
            other = fact.select(*[F.col(c).alias(f"f_{c}") for c in fact.columns])
            met = F.lit(True)
            for c in on:
                met = met & (F.col(c) == F.col(f"f_{c}"))
            some = key.join(other, met if more is None else met & more, "left_semi").select("row")
            found = some if found is None else found.union(some)
        rows = rows.join(found.distinct().withColumn(name, F.lit(True)), "row", "left").withColumn(name, F.coalesce(name, F.lit(False)))

    whose = messages.select(F.col("id").alias("message"), "request_id", address(F.col("to_email")).alias("recipient"), F.col("status").alias("m_state"), F.coalesce("sent_at", "created_at").alias("at"))
    with_job = whose.join(jobs.select(F.col("id").alias("job"), F.col("message_id").alias("message"), F.col("status").alias("j_state")), "message", "left")
    outcomes = with_job.join(attempts.select(F.col("job_id").alias("job"), F.col("id").alias("attempt"), "outcome", F.coalesce("ended_at", "started_at").alias("tried")), "job")
    here, other = ["request_id", "recipient"], F.col("f_message") != F.col("own_message")
    took = outcomes.where("outcome = 'accepted'").select("request_id", "recipient", "attempt", "tried")
    sent = with_job.where("m_state = 'sent' or j_state = 'sent'").select("request_id", "recipient", "message", "at")
    mark("later", (took, here, (F.col("f_attempt") != F.coalesce("own", F.lit(-1))) & (F.col("f_tried") > F.col("since"))), (sent, here, other & (F.col("f_at") > F.col("since"))))
    mark("settled", (reconciled.where("outcome = 'accepted'").select("request_id", address(F.col("normalized_recipient")).alias("recipient")), here, None))
    lost = with_job.where("m_state = 'delivery_unknown' or j_state = 'delivery_unknown'").select(here).union(outcomes.where("outcome = 'delivery_unknown'").select(here))
    mark("lost", (lost, here, None))
    states_now = ["queued", "sending", "delivery_unknown"]
    mark("active", (with_job.where(F.col("m_state").isin(states_now) | F.col("j_state").isin(states_now)).select("request_id", "recipient", "message"), here, other))
    by_key, by_recipient = suppressed_rows(blacklist, suppliers)
    mark("barred", (by_key.where("key <> ''"), ["workspace_id", "key"], None), (by_recipient, ["workspace_id", "recipient"], None))
    replied, at, wrote = answered_rows(states, suppliers, messages)
    # who wrote is met by equality in each case: a row without a supplier, or without an address, asks for less
    nobody, blank = F.col("supplier_id").isNull(), F.col("recipient") == ""
    some = lambda *on: (wrote.select(*on).distinct(), list(on))
    wrote_to = [(wrote, ["request_id", "supplier_id", "recipient"], None), (*some("request_id", "recipient"), nobody & ~blank), (*some("request_id", "supplier_id"), blank), (*some("request_id"), nobody & blank)]
    mark("answered", (replied, ["request_id", "supplier_id"], None), (at, here, None), *wrote_to)
    mark("planned", (retries.select("workspace_id", "request_id", address(F.col("normalized_recipient")).alias("recipient")), ["workspace_id", *here], None))

    has, goal, tried_ = F.coalesce("has_source", F.lit(False)), F.coalesce("has_target", F.lit(False)), F.col("try").isNotNull()
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    outcome, code = text("try.outcome"), F.col("try.smtp_code")
    reasons = [
        (~has, "original_not_found"),
        (~goal, "target_account_not_found"),
        (~tried_ & F.col("original_attempt_id").isNotNull(), "original_attempt_not_found"),
        (~tried_ & F.col("original_attempt_id").isNull(), "original_attempt_missing"),
        (has & (F.coalesce("supplier_id", F.lit(0)) <= 0), "supplier_not_found"),
        (has & (text("m_provider") != source_provider), f"original_provider_not_{source_provider}"),
        (has & ((text("j_status") != "failed") | (text("m_status") != "failed")), "original_not_terminal_failed"),
        (has & F.col("resend_of_message_id").isNotNull(), "original_is_retry"),
        (goal & (text("t_provider") != target_provider), f"target_provider_not_{target_provider}"),
        (goal & (text("t_status") != "connected"), "target_account_not_connected"),
        (goal & has & (F.col("target_account_id") == F.coalesce("m_account", F.lit(0))), "target_account_is_original"),
        (tried_ & (outcome == "accepted"), "original_accepted"),
        (tried_ & (outcome == "delivery_unknown"), "original_delivery_unknown"),
        (tried_ & ~outcome.isin("accepted", "delivery_unknown", "permanent_rejected"), "original_outcome_not_proven_rejection"),
        (tried_ & ((text("try.smtp_stage") == "") | code.isNull() | (text("try.provider_response_safe") == "")), "missing_durable_smtp_evidence"),
        (tried_ & ~text("try.smtp_stage").isin(FINAL_STAGES), "final_server_response_stage_missing"),
        (tried_ & ~F.coalesce(code.between(500, 599), F.lit(False)), "final_response_not_5xx"),
        (tried_ & ~F.coalesce(F.col("try.irreversible_reached"), F.lit(False)), "non_irreversible_evidence"),
        (F.coalesce("tries", F.lit(0)) > 1, "original_disputed"),
        (F.col("later"), "later_accepted_send"),
        (F.col("settled"), "reconciled_accepted"),
        (F.col("lost"), "delivery_unknown_history"),
        (F.col("active"), "active_delivery_for_recipient"),
        (F.col("barred"), "suppressed"),
        (F.col("answered"), "answered"),
        (F.col("planned"), "retry_already_planned"),
    ]
    blocked = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for condition, name in reasons]))
    return rows.select(*asked.columns, "supplier_id", masked_address(F.col("recipient")).alias("recipient_masked"), blocked.alias("blocked_reasons"), (F.size(blocked) == 0).alias("eligible"))
