"""Duplicate suppliers: which rows are copies of a company's row, and what its relations are once they are merged.

A scan gives each row without a host one verdict. A merge takes pairs of duplicate and canonical rows, closes chains of
them and applies to each relation its policy, a table of rules by column. Rows of suppliers that no pair names are passed
on as they are; only the others are dealt by key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.graphs import chain_ends, connected


def filled(c: Column) -> Column:
    """Not null, and no text of blanks only."""
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def plain_email(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def looks_like_company_id(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("^(?:[0-9]{10}|[0-9]{12})$"), F.lit(False))


def duplicate_scan(suppliers: DataFrame, contacts: DataFrame | None = None) -> DataFrame:
    """supplier_id, workspace_id, verdict, reason, canonical_id, companies, hosts for each row that has no host but an address.

    suppliers: id, workspace_id, name, host, email, inn, global_id. contacts: supplier_id, email, if a row can have more
    addresses than its own. Rows without a host that share an address are of one group, and so on from address to address. A
    row with a host stands for a company, its global_id or itself; different companies are never linked through an
    address. A group that touches no company is unresolved, one company makes its rows candidates for that company's best row
    (linked, with a number, with a name, smallest id), and a group that bridges several is ambiguous. A row that
    is linked to a company already is ambiguous and bridges nothing.
    """
    own = suppliers.select(F.col("id").alias("supplier_id"), "email")
    known = own if contacts is None else own.union(contacts.select("supplier_id", "email"))
    rows = suppliers.select("id", "workspace_id", "global_id", "host", filled(F.col("host")).alias("has_host"), F.struct(F.col("global_id").isNotNull(), looks_like_company_id(F.col("inn")), filled(F.col("name")), -F.col("id")).alias("worth"))
    reached = known.select("supplier_id", plain_email(F.col("email")).alias("email")).where("email <> ''").distinct().join(rows, F.col("supplier_id") == F.col("id"))
    open_ = reached.where("not has_host and global_id is null").select("workspace_id", "email", "id")
    # each address is a star around its smallest row
    groups = open_.join(open_.groupBy("workspace_id", "email").agg(F.min("id").alias("v")), ["workspace_id", "email"])
    roots = connected(groups.select(F.col("id").alias("u"), "v"))
    members = open_.join(roots, F.col("id") == F.col("node"), "left").select("workspace_id", "email", "id", F.coalesce("root", "id").alias("group"))
    company = F.when(F.col("global_id").isNotNull(), F.concat(F.lit("g"), F.col("global_id").cast("string"))).otherwise(F.concat(F.lit("s"), F.col("id").cast("string")))
    hosts = reached.where("has_host").select("workspace_id", "email", F.col("id").alias("host_id"), company.alias("company"), "host", "global_id", "worth")
    met = members.select("workspace_id", "email", "group").distinct().join(hosts, ["workspace_id", "email"])
    best = F.max_by(F.struct(F.col("host_id").alias("id"), "host", "global_id"), "worth").alias("best")
    facts = met.groupBy("group").agg(best, F.count_distinct("company").alias("companies"), F.count_distinct("host_id").alias("hosts"))
    judged = members.select("id", "workspace_id", "group").distinct().join(facts, "group", "left")
    many = F.coalesce("companies", F.lit(0))
    verdict = F.when(many == 0, "unresolved").when(many == 1, "candidate").otherwise("ambiguous")
    reason = F.when(many == 0, "no exact host contact").when(many > 1, "email maps to multiple company identities").otherwise("")
    one = F.when(many == 1, F.col("best"))
    found = judged.select(F.col("id").alias("supplier_id"), "workspace_id", verdict.alias("verdict"), reason.alias("reason"), one["id"].alias("canonical_id"), one["host"].alias("host"), one["global_id"].alias("global_id"), many.alias("companies"), F.coalesce("hosts", F.lit(0)).alias("hosts"))
    linked = reached.where("not has_host and global_id is not null").select("id", "workspace_id").distinct()
    none = F.lit(None).cast("string")
    said = [F.lit("ambiguous"), F.lit("hostless row already linked to global company"), F.lit(None).cast("long"), none, F.lit(None).cast(suppliers.schema["global_id"].dataType), F.lit(0).cast("long"), F.lit(0).cast("long")]
    return found.union(linked.select("id", "workspace_id", *said))


def request_identity(request_suppliers: DataFrame, suppliers: DataFrame) -> DataFrame:
    """request_id, rows, numbers, companies, sites, emails: how many different ones a request's suppliers are."""
    joined = request_suppliers.select("request_id", F.col("supplier_id").alias("id")).join(suppliers, "id", "left")
    distinct = lambda c, name: F.count_distinct(F.when(filled(c), F.lower(F.trim(c.cast("string"))))).alias(name)
    return joined.groupBy("request_id").agg(F.count("*").alias("rows"), *[distinct(F.col(c), n) for c, n in (("inn", "numbers"), ("global_id", "companies"), ("host", "sites"), ("email", "emails"))])


def several_sites(suppliers: DataFrame) -> DataFrame:
    """global_id, suppliers, sites of companies with several rows."""
    linked = suppliers.where("global_id is not null").groupBy("global_id")
    return linked.agg(F.count("*").alias("suppliers"), F.count_distinct(F.when(filled(F.col("host")), F.col("host"))).alias("sites")).where("suppliers > 1")


# ---- merge

#: A rule makes a column's value from the group's rows: its column, and a number that is 0 for the canonical row and grows over its duplicates.
Rule = Callable[[Column, Column], Column]


def kept(c: Column, place: Column) -> Column:
    return F.min_by(c, place)


def first_filled(c: Column, place: Column) -> Column:
    return F.coalesce(F.min_by(c, F.when(filled(c), place)), F.min_by(c, place))


def greatest(c: Column, place: Column) -> Column:
    return F.max(c)


def of_latest(by: str) -> Rule:
    """The value of the row with the latest `by`; of equally late ones the first."""
    return lambda c, place: F.max_by(c, F.struct(F.col(by), -place))


def moved_with(other: str) -> Rule:
    """The first row's value; where its `other` is null and a later row fills it, the greater of the two rows' values."""

    def rule(c: Column, place: Column) -> Column:
        first, filling = F.min_by(c, place), F.min_by(c, F.when(F.col(other).isNotNull(), place))
        return F.when(F.min_by(F.col(other).isNull(), place), F.greatest(first, filling)).otherwise(first)

    return rule


def of_first_with(column: str, value: str) -> Rule:
    """The value of the first row that has this in that column, if one has."""
    return lambda c, place: F.min_by(c, F.struct(~F.coalesce(F.col(column) == value, F.lit(False)), place))


def joined_lists(c: Column, place: Column) -> Column:
    """JSON arrays of texts one behind the other, each element once; what is no such array adds nothing."""
    one = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("place"), one.alias("items"))))
    return F.to_json(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["items"]))))


@dataclass(frozen=True)
class Policy:
    """key: what is unique beside the supplier, or None where rows are only re-keyed. Columns without a rule are kept.

    unique_alone: the key is unique whatever the supplier, so a duplicate's row can meet any other's.
    """

    key: tuple[str, ...] | None = None
    rules: dict[str, Rule] = field(default_factory=dict)
    unique_alone: bool = False


#: The relations of a supplier, and what happens to their columns when suppliers are merged.
POLICIES = {
    "mail_threads": Policy(("workspace_id", "request_id"), {"last_message_at": greatest}),
    "mail_messages": Policy(),
    "request_suppliers": Policy(("request_id",), {"position_keys_json": joined_lists, "reason": first_filled, "source": first_filled, "is_irrelevant": greatest, "updated_at": greatest}),
    "request_supplier_states": Policy(("request_id",), {c: of_latest("updated_at") for c in ("mail_account_id", "status", "last_message_id", "last_error", "updated_at")}),
    "request_supplier_ratings": Policy(("request_id",), {c: of_latest("updated_at") for c in ("rating", "updated_at")}),
    "search_result_sources": Policy(("request_id", "position_key"), {"url": first_filled, "title": first_filled, "updated_at": greatest}),
    "supplier_evidence": Policy(("field_name", "field_value", "source_type", "source_url")),
    "blacklist_entries": Policy(),
    "mail_campaign_targets": Policy(),
    "mail_send_operation_targets": Policy(("operation_id", "normalized_email"), {"message_id": first_filled, "updated_at": moved_with("message_id")}, unique_alone=True),
    "supplier_profiles": Policy((), {**{c: first_filled for c in ("inn", "kind", "region", "role", "phone", "reason", "source")}, "covers_json": joined_lists, "site_unavailable": greatest, "updated_at": greatest}),
    "supplier_inn_sources": Policy((), {c: of_first_with("source_type", "manual") for c in ("source_type", "updated_by", "updated_at")}),
}


def judged_pairs(pairs: DataFrame, suppliers: DataFrame) -> DataFrame:
    """pairs (old, new) with refused: the first reason against merging them, or null. suppliers as in duplicate_scan()."""
    side = lambda end: suppliers.select(F.col("id").alias(end), F.struct("workspace_id", "host", "email", "inn").alias(f"{end}_row"))
    rows = pairs.select("old", "new").join(side("old"), "old", "left").join(side("new"), "new", "left")
    old, new = F.col("old_row"), F.col("new_row")
    refused = (
        F.when(F.col("old") == F.col("new"), "merged with itself")
        .when(old.isNull() | new.isNull(), "a supplier is not there")
        .when(~old["workspace_id"].eqNullSafe(new["workspace_id"]), "different workspaces")
        .when(filled(old["host"]) | (plain_email(old["email"]) == ""), "not a row of an address alone")
        .when(filled(old["inn"]) & filled(new["inn"]) & (F.trim(old["inn"]) != F.trim(new["inn"])), "different numbers")
    )
    return rows.select("old", "new", refused.alias("refused"))


def merge_relation(rows: DataFrame, pairs: DataFrame, policy: Policy) -> DataFrame:
    """rows (supplier_id and others) once each supplier `old` of the closed pairs has become `new`."""
    columns = rows.columns
    named = pairs.select("old", "new").union(pairs.select(F.col("new").alias("old"), "new").distinct())
    joined = rows.join(named, F.col("supplier_id") == F.col("old"), "left")
    again = joined.withColumn("supplier_id", F.coalesce("new", "supplier_id"))
    if policy.key is None:
        return again.select(columns)
    place = F.when(F.col("old") != F.col("new"), F.col("old") + 1).otherwise(0).cast("long")
    touched = again.where("new is not null").withColumn("_place", place)
    rest = again.where("new is null")
    key = list(policy.key) if policy.unique_alone else ["supplier_id", *policy.key]
    if policy.unique_alone:  # rows of suppliers without a pair take part if a duplicate's row has their key
        moved = touched.where("_place > 0").select(*key).distinct()
        touched = touched.union(rest.join(moved, key, "left_semi").withColumn("_place", F.lit(0).cast("long")).select(touched.columns))
        rest = rest.join(moved, key, "left_anti")
    values = [c for c in columns if c not in key]
    # a row that meets no other stays as it is
    one = lambda c: F.when(F.count("*") == 1, F.first(c)).otherwise(policy.rules.get(c, kept)(F.col(c), F.col("_place"))).alias(c)
    merged = touched.groupBy(*key).agg(*[one(c) for c in values])
    return rest.select(columns).union(merged.select(columns))


def merge_suppliers(relations: dict[str, DataFrame], pairs: DataFrame, policies: dict[str, Policy] = POLICIES) -> dict[str, DataFrame]:
    """Every relation after the merge; pairs (old, new) may be chains. Messages move to the thread that theirs is merged into."""
    closed = chain_ends(pairs)
    out = {name: merge_relation(rows, closed, policies[name]) for name, rows in relations.items()}
    if {"mail_threads", "mail_messages"} <= set(relations):
        threads = relations["mail_threads"].select(F.col("id").alias("_was"), "workspace_id", "request_id", "supplier_id").join(closed, F.col("supplier_id") == F.col("old"))
        kept_ids = out["mail_threads"].select(F.col("id").alias("_is"), "workspace_id", "request_id", F.col("supplier_id").alias("new"))
        moved = threads.join(kept_ids, ["workspace_id", "request_id", "new"]).where("_was <> _is").select("_was", "_is")
        columns = out["mail_messages"].columns
        out["mail_messages"] = out["mail_messages"].join(moved, F.col("thread_id") == F.col("_was"), "left").withColumn("thread_id", F.coalesce("_is", "thread_id")).select(columns)
    return out


#: What a merge never changes of a message.
UNCHANGED = ["to_email", "status", "sent_at", "message_id", "provider_message_id", "created_at", "error"]


def merge_report(before: dict[str, DataFrame], after: dict[str, DataFrame], pairs: DataFrame, unchanged: dict[str, list[str]]) -> DataFrame:
    """relation, rows_before, rows_after, survivors (rows that still name a duplicate), lost (keys of the policy, re-keyed, that
    are there no more), altered (rows whose `unchanged` columns differ)."""
    closed = chain_ends(pairs)
    parts = []
    for name, was in before.items():
        now, policy = after[name], POLICIES[name]
        survivors = now.join(closed, F.col("supplier_id") == F.col("old"), "left_semi").agg(F.count("*").alias("survivors"))
        key = ["supplier_id", *(policy.key or ())] if not policy.unique_alone else list(policy.key)
        again = was.join(closed, F.col("supplier_id") == F.col("old"), "left").withColumn("supplier_id", F.coalesce("new", "supplier_id")).select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in key])
        lost = again.join(now.select(*key).distinct(), same, "left_anti").agg(F.count("*").alias("lost"))
        columns = ["id", *unchanged[name]] if name in unchanged else []
        altered = was.select(columns).exceptAll(now.select(columns)).agg(F.count("*").alias("altered")) if columns else was.sparkSession.range(1).select(F.lit(0).cast("long").alias("altered"))
        counts = was.agg(F.count("*").alias("rows_before")).crossJoin(now.agg(F.count("*").alias("rows_after")))  # one row each
        parts.append(counts.crossJoin(survivors).crossJoin(lost).crossJoin(altered).select(F.lit(name).alias("relation"), "*"))
    return reduce(DataFrame.union, parts)
