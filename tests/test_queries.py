"""Every query against its SQL twin on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quayside.plans import registry

SMALLEST = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{SMALLEST}/{name}.parquet'")
    return con


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, SMALLEST)
    columns = sorted(frame.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in frame.collect())
    if name in registry.ORACLES:
        found = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == sorted(str([plain(r[i]) for i in order]) for r in found.fetchall())


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES and set(registry.ORACLES) <= set(registry.QUERIES)


def test_means_halfway_between_tenths(spark, tmp_path):
    sums = [(635.4, 12), (2398.2, 84), (487.35, 19), (7121.4, 132), (-2182.95, 77), (0.5, 2), (0.3, 2)]
    rows = [(u, "view", v) for u, (total, n) in enumerate(sums) for v in [total] + [0.0] * (n - 1)]
    rows += [(100 + i, "purchase", v) for i, v in enumerate([9158.085, 8423.095, -9158.085, 0.125, 0.375, None])]
    rows += [(200 + i, kind, 9158.045) for i in range(60) for kind in ["view"] * (i + 1) + ["purchase"] * 7]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["means_and_rates"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["means_and_rates"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert [m for u, m, *_ in sorted(got) if u < 7] == [53.0, 28.6, 25.6, 54.0, -28.4, 0.2, 0.2]


def test_pairs_of_one_key_are_many_tasks(spark, tmp_path):
    many = 8000
    spark.range(many).selectExpr("id AS p_partkey", "1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(many).selectExpr("id AS s_suppkey", "1 AS s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = registry.QUERIES["array_membership_join"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.xxhash64("p_partkey", "s_suppkey").cast("decimal(20,0)")).alias("h")).collect()
    want = sum(1 for p in range(8) for s in range(35) if p in (s % 5, s % 7)) / (8 * 35)
    total = sum(r.n for r in rows)
    assert abs(total / many**2 - want) < 1e-3
    assert len(rows) > 3 and max(r.n for r in rows) < total / 2
    p, s = spark.read.parquet(f"{tmp_path}/part.parquet"), spark.read.parquet(f"{tmp_path}/supplier.parquet")
    plain = s.join(p, F.expr("p_size = s_nationkey AND array_contains(array(s_suppkey % 5, s_suppkey % 7), p_partkey % 8)"))
    assert plain.agg(F.count("*"), F.sum(F.xxhash64("p_partkey", "s_suppkey").cast("decimal(20,0)"))).first() == (total, sum(r.h for r in rows))
