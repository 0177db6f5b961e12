"""Windows, event sequences and batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.functions.messages import cooldown_delay, retry_delay
from quayside.functions.status import stage_limit
from quayside.operators import sequences as ops
from quayside.plans.registry import Tables, query


@query("JOI33", "WIN04", sql="""
    WITH e AS (SELECT * FROM events WHERE event_type IN ('view', 'purchase')),
    r AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e)
    SELECT user_id, min(ts) FILTER (event_type = 'view') AS started, max(ts) FILTER (event_type = 'purchase') AS ended FROM r GROUP BY user_id, run HAVING count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'purchase') > 0""")
def reply_pairs(t: Tables) -> DataFrame:
    """First view, next purchase, then armed again."""
    kind = F.col("event_type")
    return ops.pair_first_then_next(t.events, ["user_id"], ["ts", "event_id"], kind == "view", kind == "purchase", "ts")


@query("WIN02", "SRC10", sql="SELECT l_suppkey, arg_min(l_partkey, l_partkey) AS first_part FROM lineitem GROUP BY 1")
def first_by_key(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.min_by("l_partkey", "l_partkey").alias("first_part"))


@query("WIN05", "WIN15", "SRC24", sql="""
    WITH y AS (SELECT c_nationkey, year(o_orderdate) AS y, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY y DESC) AS rn, lag(n) OVER (PARTITION BY c_nationkey ORDER BY y) AS before FROM y)
    SELECT c_nationkey, y, n, n - before AS change FROM k WHERE rn <= 6""")
def last_years(t: Tables) -> DataFrame:
    """The last six years of each key with the change on the year before."""
    yearly = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"))
    by = W.partitionBy("c_nationkey")
    ranked = yearly.withColumn("rn", F.row_number().over(by.orderBy(F.col("y").desc()))).withColumn("change", F.col("n") - F.lag("n").over(by.orderBy("y")))
    return ranked.where("rn <= 6").select("c_nationkey", "y", "n", "change")


@query("WIN06", "WIN07", "STM17", sql="""
    WITH r AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT user_id, coalesce(min(CASE WHEN NOT bad THEN n END), max(n) + 1) - 1 AS streak, count(*) FILTER (n <= 10) AS recent, count(*) FILTER (n <= 10 AND bad) AS recent_bad FROM r GROUP BY 1""")
def trailing_health(t: Tables) -> DataFrame:
    """Streak of errors at the end, and errors among the last ten."""
    return ops.trailing_health(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type", "error")


@query("WIN08", "STM21", sql="""
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_hour,
    count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS last_day FROM events""")
def rolling_budget(t: Tables) -> DataFrame:
    """Sends of an account in the last hour and day."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = ops.rolling_count(t.events, ["user_id"], seconds, 3600, "last_hour")
    return ops.rolling_count(rows, ["user_id"], seconds, 86400, "last_day").select("event_id", "last_hour", "last_day")


@query("WIN10", "HLP03", "STM13", sql="SELECT user_id, least(max(ts) FILTER (event_type = 'error') + INTERVAL 1 HOUR, min(ts) FILTER (ts >= TIMESTAMP '2024-01-28 00:00:00') + INTERVAL 1 DAY, max(ts) + INTERVAL 45 SECOND) AS wake FROM events GROUP BY 1")
def wake_up(t: Tables) -> DataFrame:
    """The earliest of several due times."""
    recent = F.col("ts") >= F.lit("2024-01-28 00:00:00").cast("timestamp_ntz")
    after = lambda c, text: c + F.expr(f"INTERVAL '{text}'")
    due = [after(F.max(F.when(F.col("event_type") == "error", F.col("ts"))), "1 hour"), after(F.min(F.when(recent, F.col("ts"))), "1 day"), after(F.max("ts"), "45 seconds")]
    return t.events.groupBy("user_id").agg(F.least(*due).alias("wake"))


@query("WIN11", "UPS12", sql="SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS duplicate FROM events")
def first_occurrence(t: Tables) -> DataFrame:
    """The first claim of a key wins; later ones are repeats."""
    by = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t.events.select("event_id", (F.row_number().over(by) > 1).alias("duplicate"))


@query("WIN12", "WIN13", "STM19", sql="""
    SELECT o_custkey, o_orderkey, n AS ordinal, n <= least(CASE o_custkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 25 WHEN 2 THEN 50 ELSE 1000000 END, total) AS eligible
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)""")
def staged_rollout(t: Tables) -> DataFrame:
    """Ordinals within a campaign and whether its stage has come to them."""
    by = W.partitionBy("o_custkey")
    stage = F.element_at(F.array(*map(F.lit, ["first_10", "next_25", "next_50", "all"])), (F.col("o_custkey") % 4 + 1).cast("int"))
    rows = t.orders.withColumn("ordinal", F.row_number().over(by.orderBy("o_orderkey")).cast("long")).withColumn("total", F.count("*").over(by))
    return rows.select("o_custkey", "o_orderkey", "ordinal", (F.col("ordinal") <= stage_limit(stage, F.col("total"))).alias("eligible"))


@query("STM02", "STM03", "UPS14", sql="SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS copies FROM events GROUP BY 1, 2")
def idempotent_ingest(t: Tables) -> DataFrame:
    """Batch twin of the de-duplicating ingest: one row for each natural key."""
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.count("*").alias("copies"))


@query("STM04", "STM05", "STM14", sql="SELECT user_id, max(ts) AS last_at, CASE WHEN bool_or(event_type = 'error') AND max(ts) FILTER (event_type = 'error') > coalesce(max(ts) FILTER (event_type = 'purchase'), TIMESTAMP '1970-01-01') THEN 'failed' WHEN bool_or(event_type = 'purchase') THEN 'replied' ELSE 'sent' END AS status FROM events GROUP BY 1")
def status_fold(t: Tables) -> DataFrame:
    """The state that a log of events leaves; out-of-order events do not matter."""
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    never = F.lit("1970-01-01").cast("timestamp_ntz")
    status = F.when(last("error") > F.coalesce(last("purchase"), never), "failed").when(last("purchase").isNotNull(), "replied").otherwise("sent")
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last_at"), status.alias("status"))


@query("STM06", "STM07", "STM08", "STM16", "RDM17", sql="SELECT user_id, min(event_id) AS due FROM events WHERE event_type IN ('view', 'click') AND ts <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1")
def due_jobs(t: Tables) -> DataFrame:
    """The next due job of every queue; taking the lease is a side effect and not rebuilt."""
    due = F.col("event_type").isin("view", "click") & (F.col("ts") <= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return t.events.where(due).groupBy("user_id").agg(F.min("event_id").alias("due"))


@query("STM09", "STM10", "STM11", "STM15", sql="""
    SELECT user_id, errors, CASE WHEN errors < 12 THEN 'queued' ELSE 'failed' END AS status, CAST(least(900, 10 * 2 ** least(greatest(errors - 1, 0), 30)) AS BIGINT) AS delay, CAST(least(3600, 300 * 2 ** least(errors, 30)) AS BIGINT) AS cooldown
    FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)""")
def retries(t: Tables) -> DataFrame:
    errors = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    n = F.col("errors")
    return errors.select("user_id", "errors", F.when(n < 12, "queued").otherwise("failed").alias("status"), retry_delay(n).alias("delay"), cooldown_delay(n).alias("cooldown"))


@query("STM12", "TRN10")
def circuit_breaker(t: Tables) -> DataFrame:
    """Breaker state after every event: an ordered fold, tested against a plain loop."""
    rows = t.events.select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_id", (F.col("event_type") == "error").alias("failed"))
    return ops.breaker_log(rows, "user_id", "at", "event_id", "failed")


@query("STM20", sql="SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'delivery_unknown' WHEN event_type = 'error' THEN 'queued' ELSE event_type END AS status FROM events")
def crash_recovery(t: Tables) -> DataFrame:
    """What was under way is queued again, or unknown if it may have left."""
    error = F.col("event_type") == "error"
    return t.events.select("event_id", F.when(error & (F.col("value") > 50), "delivery_unknown").when(error, "queued").otherwise(F.col("event_type")).alias("status"))
