"""Delivery states, response states and their precedence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Raw transport states and the delivery fact that each stands for.
DELIVERY = {"queued": "queued", "sending": "queued", "sent": "accepted", "failed": "failed", "bounced": "bounced", "delivery_unknown": "unknown", "cancelled": "cancelled"}
#: Strongest first.
STRENGTH = ["bounced", "failed", "unknown", "accepted", "queued"]
STAGES = {"first_10": 10, "next_25": 25, "next_50": 50}


def delivery_fact(raw: Column, bounced: Column) -> Column:
    """A hard bounce overrides whatever the transport said."""
    table = F.create_map(*[F.lit(x) for pair in DELIVERY.items() for x in pair])
    return F.when(bounced, F.lit("bounced")).otherwise(F.coalesce(F.try_element_at(table, raw), F.lit("unknown")))


def card_label(states: Column) -> Column:
    """One distinct state gives itself, several give mixed, none gives not_sent."""
    distinct = F.coalesce(F.array_distinct(F.array_compact(states)), F.array())
    return F.when(F.size(distinct) == 0, "not_sent").when(F.size(distinct) == 1, F.element_at(distinct, 1)).otherwise("mixed")


def response_label(answered: Column, latest_delivery: Column) -> Column:
    """answered is never downgraded; waiting needs an accepted latest delivery."""
    return F.when(answered, "answered").when(latest_delivery == "accepted", "waiting").otherwise("none")


def strongest(counts: dict[str, Column]) -> Column:
    """The first state in order of strength that has a count."""
    out = F.lit("none")
    for name in reversed(STRENGTH):
        if name in counts:
            out = F.when(counts[name] > 0, name).otherwise(out)
    return out


def pause_reason(rejections: Column, hard_bounces: Column, permanent_rate: Column, unknown_rate: Column, streak: Column, recent: Column, transient: Column) -> Column:
    """Ordered thresholds of a campaign's health; null if none is crossed."""
    return (
        F.when(rejections >= 1, "provider_rejection")
        .when(hard_bounces > 0, "hard_bounce")
        .when(permanent_rate > 0.20, "permanent_failure_rate")
        .when(unknown_rate > 0.10, "delivery_unknown_rate")
        .when(streak >= 3, "transient_streak")
        .when((recent >= 10) & (transient >= 5) & (transient / recent >= 0.5), "transient_ratio")
    )


def stage_limit(stage: Column, total: Column) -> Column:
    """Cumulative recipients of a rollout stage: 10, 25, 50, all."""
    out = total
    for name, limit in STAGES.items():
        out = F.when(stage == name, F.least(F.lit(limit), total)).otherwise(out)
    return out


def percent(part: Column, whole: Column) -> Column:
    """Percent rounded half to even, 0 when there is no whole."""
    return F.when(whole > 0, F.bround(100.0 * part / whole)).otherwise(0.0)


def masked_address(address: Column) -> Column:
    """First character of the local part, the domain in full; empty if there is no address."""
    local, domain = F.substring_index(address, "@", 1), F.substring_index(address, "@", -1)
    return F.when(F.contains(F.coalesce(address, F.lit("")), F.lit("@")), F.concat(F.substring(local, 1, 1), F.lit("***@"), domain)).otherwise("")
