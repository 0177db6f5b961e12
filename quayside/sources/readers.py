"""Readers: position files, line lists, separated files, search result pages, mail messages, fixture catalogues."""

from __future__ import annotations

import email
import email.policy
import email.utils
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.urls import host_of, root_domain

POSITION = "product string, quantity string, unit string, region string, description string"
#: Companion schemas of the entity tables, one explicit struct each.
SCHEMAS = {
    "suppliers": "id long, workspace_id long, external_key string, name string, email string, host string, created_at timestamp, updated_at timestamp",
    "profiles": "supplier_id long, inn string, kind string, region string, role string, phone string, covers array<string>, site_unavailable boolean",
    "messages": "id long, thread_id long, request_id long, supplier_id long, message_id string, in_reply_to string, references_header string, direction string, from_email string, to_email string, subject string, body_text string, body_html string, status string, created_at timestamp",
    "attempts": "id long, job_id long, account_id long, started_at timestamp, ended_at timestamp, outcome string, irreversible boolean",
    "evidence": "supplier_id long, field string, value string, source_type string, source_url string, score int, decision string, first_seen timestamp, last_seen timestamp",
    "quotes": "id long, request_id long, supplier_id long, price long, currency string, input_hash string, created_at timestamp",
}
RESPONSE = "found string, results struct<grouping:struct<group:array<struct<doc:struct<url:string, title:string, extendedpassage:string, passages:struct<passage:array<string>>, pubDate:string>>>>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table; a known entity gets its schema, so nothing is inferred."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def database(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> DataFrame:
    """A database table over JDBC, read in parallel by ranges of a numeric key; its bounds are asked for if not given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key:
        if bounds is None:
            low, high = spark.read.format("jdbc").option("url", url).option("query", f"SELECT min({key}) AS low, max({key}) AS high FROM {name}").load().first()
            bounds = (int(low or 0), int(high or 0) + 1)
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """value: lines of a text file without # comments and blanks."""
    text = F.trim(F.split("value", "#")[0])
    return spark.read.text(path).select(text.alias("value")).where("value <> ''")


def separated(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    """A separated file with a header; a byte-order mark before the first name is dropped."""
    frame = spark.read.option("sep", separator).option("header", True).csv(path)
    return frame.toDF(*[c.lstrip("﻿") for c in frame.columns])


def hosts_of_results(results: DataFrame, url: str, order: str) -> DataFrame:
    """host, first: hosts in the order in which a result list first names them."""
    rows = results.select(host_of(F.col(url)).alias("host"), F.col(order).alias("o")).where("host <> ''")
    return rows.groupBy("host").agg(F.min("o").alias("first"))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """Positions of JSON request files: a list, an object with `positions`, or one position."""
    raw = spark.read.text(path, wholetext=True).select("value")
    kind = f"array<struct<{', '.join(x.replace(' ', ':') for x in POSITION.split(', '))}>>"
    element = kind[6:-1]
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)).otherwise(
        F.coalesce(F.from_json("value", f"struct<positions:{kind}>")["positions"], F.array(F.from_json("value", element)))
    )
    return raw.select(F.posexplode(listed).alias("ordinal", "p")).select("ordinal", "p.*")


def search_page(pages: DataFrame, xml: str, keyword: str) -> DataFrame:
    """Rows of search result pages in XML: position, url, host, root, title, snippet; docs without a URL are dropped.

    The snippet is the extended passage, else the passages joined.
    """
    parsed = pages.select(F.col(keyword).alias("keyword"), F.from_xml(F.col(xml), RESPONSE).alias("r"))
    rows = parsed.select("keyword", F.posexplode_outer("r.results.grouping.group.doc").alias("n", "d"))
    text = F.coalesce(F.nullif(F.trim("d.extendedpassage"), F.lit("")), F.array_join("d.passages.passage", " "), F.lit(""))
    host = host_of(F.col("d.url"))
    return rows.where("d.url is not null and d.url <> ''").select("keyword", (F.col("n") + 1).alias("position"), F.col("d.url").alias("url"), host.alias("host"), root_domain(host).alias("root_domain"), F.trim("d.title").alias("title"), text.alias("snippet"))


def message_of(raw: bytes) -> dict:
    """The fields of one raw mail message; undecodable parts are replaced, not raised."""
    message = email.message_from_bytes(raw or b"", policy=email.policy.default)
    bodies = {"text/plain": [], "text/html": []}
    for part in message.walk():
        if part.get_content_type() in bodies and not part.is_multipart() and part.get_content_disposition() != "attachment":
            data = part.get_payload(decode=True) or b""
            bodies[part.get_content_type()].append(data.decode(part.get_content_charset() or "utf-8", "replace") if data else "")
    address = lambda name: email.utils.parseaddr(str(message.get(name, "")))[1].lower()
    return {
        "message_id": str(message.get("Message-ID", "")).strip(),
        "in_reply_to": str(message.get("In-Reply-To", "")).strip(),
        "references_header": " ".join(str(message.get("References", "")).split()),
        "from_email": address("From"),
        "to_email": address("To"),
        "subject": str(message.get("Subject", "")),
        "body_text": "\n".join(bodies["text/plain"]),
        "body_html": "\n".join(bodies["text/html"]),
    }


def messages(raw: DataFrame, column: str = "content") -> DataFrame:
    """Raw mail messages (binary) parsed batch by batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([message_of(x) for x in frame[column]], columns=list(message_of(b"")))

    return raw.select(column).mapInPandas(run, ", ".join(f"{k} string" for k in message_of(b"")))


def newer_than_cursor(messages_: DataFrame, cursor: DataFrame) -> DataFrame:
    """Messages beyond each account's cursor; a new validity number starts over."""
    joined = messages_.join(cursor.select("account_id", F.col("uidvalidity").alias("_v"), F.col("last_uid").alias("_u")), "account_id", "left")
    fresh = F.col("_v").isNull() | (F.col("uidvalidity") != F.col("_v")) | (F.col("uid") > F.col("_u"))
    return joined.where(fresh).drop("_v", "_u")


def registry_record(record: Column) -> tuple[Column, Column]:
    """(risks, active) of a registry record struct: the rules that hold, and whether it is in force."""
    rules = {"mass_address": "mass_address", "disqualified": "disqualified_persons", "bankruptcy": "bankruptcy", "unreliable": "unreliable_data", "sanctions": "sanctions"}
    risks = F.array_compact(F.array(*[F.when(record[field].cast("boolean"), F.lit(name)) for field, name in rules.items()]))
    return risks, F.when(record["status"].isNull(), None).otherwise(F.lower(record["status"]).isin("active", "действует", "действующая"))


def finance_years(history: Column) -> Column:
    """Year, revenue and profit of a map year -> struct, years without figures left out, ascending."""
    rows = F.transform(F.map_entries(history), lambda e: F.struct(e["key"].cast("int").alias("year"), e["value"]["revenue"].alias("revenue"), e["value"]["profit"].alias("profit")))
    return F.array_sort(F.filter(rows, lambda r: r["revenue"].isNotNull() | r["profit"].isNotNull()))


def catalogue(fixture: DataFrame) -> dict[str, DataFrame]:
    """A nested fixture (suppliers, positions) as flat tables."""
    suppliers = fixture.select(F.explode_outer("suppliers").alias("s"))
    return {
        "suppliers": suppliers.select("s.host", "s.name", "s.email"),
        "covers": suppliers.select("s.host", F.explode_outer("s.covers").alias("position_key")),
        "positions": fixture.select(F.posexplode_outer("positions").alias("ordinal", "p")).select("ordinal", "p.*"),
    }
