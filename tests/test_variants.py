from types import SimpleNamespace

from quayside.plans.texts import query_variants


def test_every_part_gives_its_variants(spark):
    part = spark.createDataFrame([(1, "red bolt", 3), (2, "nut", 6), (3, "pipe", 50), (4, "cap", None)], "p_partkey long, p_name string, p_size int")
    want = [(k, q) for k, n in [(1, "red bolt"), (2, "nut"), (3, "pipe"), (4, "cap")] for q in (n, f"buy {n}", f"{n} wholesale")]
    assert sorted(tuple(r) for r in query_variants(SimpleNamespace(part=part)).collect()) == sorted(want)
