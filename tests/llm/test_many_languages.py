import random

from pyspark.sql import functions as F

from quayside.llm import language


def test_rare_labels_are_languages_too(spark):
    rng = random.Random(6)
    rows = []
    for i in range(70):  # the last labels are the rarest
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)]
        rows += [(f"l{i:02}", " ".join(rng.choice(own) for _ in range(30))) for _ in range(12 if i < 64 else 6)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = language.identify(docs, label=F.col("lang"), keep=F.col("lang")).select(F.col("_row").alias("lang"), "language").collect()
    assert len(found) == len(rows) and all(r.lang == r.language for r in found)


def test_every_declared_value_has_its_own_likelihood(spark):
    # 250 values, more than 200, each seen with one of two languages
    counted = spark.createDataFrame([(f"v{i:03}", i % 2, 9 if i < 200 else 3) for i in range(250)], "_declared string, guess int, k long")
    table, unmet = language._weighted(counted, "_declared", 2)
    got = {r._declared: r._declared_logs for r in table.collect()}
    assert len(got) == 250 and all((x[0] > x[1]) == (int(v[1:]) % 2 == 0) for v, x in got.items())
    assert all(x < min(max(r) for r in got.values()) for x in unmet)
