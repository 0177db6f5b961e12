"""Ordered operators: pairing, streaks, last-k, rolling budgets, circuit breaker."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Failures in the window that open the breaker; window, open time and cooldown bounds in seconds.
BREAKER_FAILURES, BREAKER_WINDOW, BREAKER_OPEN, COOLDOWN_BASE, COOLDOWN_MOST = 3, 900, 3600, 300, 3600


def pair_first_then_next(rows: DataFrame, keys: list[str], order: list[str], first: Column, then: Column, at: str) -> DataFrame:
    """Each `then` event with the first `first` event since the previous `then`: (keys, started, ended).

    A run is what lies between two `then` events; its number is a running count, so one sort by key does all.
    """
    by = W.partitionBy(*keys).orderBy(*order)
    marked = rows.where(first | then).withColumn("_then", then)
    marked = marked.withColumn("_run", F.coalesce(F.sum(F.col("_then").cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    runs = marked.groupBy(*keys, "_run").agg(F.min(F.when(~F.col("_then"), F.col(at))).alias("started"), F.max(F.when(F.col("_then"), F.col(at))).alias("ended"))
    return runs.where("started is not null and ended is not null").drop("_run")


def trailing_health(rows: DataFrame, keys: list[str], order: list[Column], outcome: str, bad: str, window: int = 10) -> DataFrame:
    """Length of the streak of `bad` at the end of each sequence, and counts of the last `window` outcomes."""
    latest = W.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    ranked = rows.withColumn("_n", F.row_number().over(latest)).withColumn("_bad", F.col(outcome) == bad)
    other = F.min(F.when(~F.col("_bad"), F.col("_n")))
    recent = F.col("_n") <= window
    return ranked.groupBy(*keys).agg(
        (F.coalesce(other, F.max("_n") + 1) - 1).cast("long").alias("streak"),
        F.count_if(recent).alias("recent"),
        F.count_if(recent & F.col("_bad")).alias("recent_bad"),
    )


def rolling_count(rows: DataFrame, keys: list[str], seconds: Column, width: int, name: str) -> DataFrame:
    """How many events of the key lie within `width` seconds up to each one, itself included."""
    return rows.withColumn(name, F.count("*").over(W.partitionBy(*keys).orderBy(seconds).rangeBetween(-width, 0)))


class Breaker:
    """Circuit breaker of one account: enough failures within the window open it, each time for longer.

    A success closes it and resets the level. Used as it stands by the batch fold and by the stream's state.
    """

    def __init__(self, level: int = 0, until: float = 0.0, failures: Iterable[float] = ()):
        self.level, self.until, self.failures = level, until, list(failures)

    def see(self, at: float, failed: bool) -> str:
        """State after the event: open, cooling or closed."""
        if not failed:
            self.level, self.until, self.failures = 0, 0.0, []
            return "closed"
        self.failures = [t for t in self.failures if t > at - BREAKER_WINDOW] + [at]
        if len(self.failures) >= BREAKER_FAILURES:
            self.until, self.failures = at + BREAKER_OPEN, []
            return "open"
        cooldown = min(COOLDOWN_MOST, COOLDOWN_BASE * 2 ** min(self.level, 30))
        self.level += 1
        self.until = max(self.until, at + cooldown)
        return "cooling"


def breaker_log(rows: DataFrame, key: str, at: str, event_id: str, failed: str) -> DataFrame:
    """key, event id, state and until (seconds) after every event, folded in order of time.

    Rows are key, seconds, id, failure; groups are streamed from one sorted partition, none is held in memory.
    """
    dealt = rows.select(key, F.col(at).cast("double").alias("at"), F.col(event_id).alias("event_id"), F.col(failed).alias("failed"))
    dealt = dealt.repartition(key).sortWithinPartitions(key, "at", "event_id")

    def run(frames):
        current, breaker = None, Breaker()
        for frame in frames:
            states, until = [], []
            for k, t, f in zip(frame[key], frame["at"], frame["failed"], strict=True):
                if k != current:
                    current, breaker = k, Breaker()
                states.append(breaker.see(t, bool(f)))
                until.append(breaker.until)
            yield pd.DataFrame({key: frame[key], "event_id": frame["event_id"], "state": states, "until": until})

    kind = dict(rows.dtypes)
    return dealt.mapInPandas(run, f"{key} {kind[key]}, event_id {kind[event_id]}, state string, until double")
