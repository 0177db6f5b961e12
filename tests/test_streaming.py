import datetime as dt
import random

from pyspark.sql import functions as F

from quayside.operators.sequences import Breaker
from quayside.streaming import operators as ops


def write_events(spark, path):
    rng = random.Random(14)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i, start + dt.timedelta(seconds=rng.randrange(40000)), rng.randrange(6), rng.choice(["view", "error", "error", "purchase"]), 1.0) for i in range(300)]
    frame = spark.createDataFrame(rows + rows[:50], ops.EVENT)
    for k in range(3):
        frame.where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(path)
    return rows


def test_streams_end_as_batches(spark, tmp_path):
    rows = write_events(spark, str(tmp_path / "in"))
    source = lambda: ops.file_stream(spark, str(tmp_path / "in"))
    ops.run_once(ops.ingest(source(), ["event_id"], delay="30 days"), "ingested", str(tmp_path / "c1"))
    assert spark.table("ingested").count() == 300
    ops.run_once(ops.status_fold(source()), "folded", str(tmp_path / "c2"), "update")
    last = {}
    for r in spark.table("folded").collect():
        last.setdefault(r.user_id, []).append((r.last_at, r.status))
    for user in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == user]
        latest = lambda kind: max((r[1] for r in mine if r[3] == kind), default=None)
        error, reply = latest("error"), latest("purchase")
        want = "failed" if error and (not reply or error > reply) else "replied" if reply else "sent"
        assert last[user][-1][1] == want


def test_breaker_and_windows_equal_plain_loops(spark, tmp_path):
    rows = write_events(spark, str(tmp_path / "in"))
    everything = lambda: ops.file_stream(spark, str(tmp_path / "in"), files_per_batch=100)
    rows = rows + rows[:50]  # the copies count here
    ops.run_once(ops.breaker(everything()), "broken", str(tmp_path / "c3"), "update")
    got = {r.user_id: (r.state, r.until) for r in spark.table("broken").collect()}
    want = {}
    for user in {r[2] for r in rows}:
        level, until, failures, state = 0, 0.0, [], "closed"
        for at, _, kind in sorted((r[1].timestamp(), r[0], r[3]) for r in rows if r[2] == user):
            if kind != "error":
                level, until, failures, state = 0, 0.0, [], "closed"
                continue
            failures = [f for f in failures if at - f < 900] + [at]
            if len(failures) >= 3:
                until, failures, state = at + 3600, [], "open"
            else:
                until, level, state = max(until, at + min(3600, 300 * 2**level)), level + 1, "cooling"
        want[user] = (state, until)
    assert got == want
    ops.run_once(ops.windowed_counts(everything(), "user_id", delay="30 days"), "counted", str(tmp_path / "c4"), "update")
    counted = {(r.start.replace(tzinfo=dt.timezone.utc).timestamp(), r.user_id): r.n for r in spark.table("counted").select(F.col("start"), "user_id", "n").collect()}
    plain = {}
    for r in rows:
        key = (r[1].timestamp() // 3600 * 3600, r[2])
        plain[key] = plain.get(key, 0) + 1
    assert counted == plain


def test_breaker_states():
    b = Breaker()
    assert [b.see(t, True) for t in (0, 100, 200)] == ["cooling", "cooling", "open"] and b.until == 3800
    assert b.see(300, False) == "closed" and b.until == 0 and b.see(2000, True) == "cooling" and b.until == 2300
