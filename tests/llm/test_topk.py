import math
import random

from quayside.llm.topk import top_k


def brute(rows, k, every):
    whole = [(i, [math.floor(256 * e) for e in x]) for i, x in rows if i is not None and x and all(e is not None and math.isfinite(e) for e in x)]
    out = set()
    for q, a in whole:
        if q % every == 0:
            scored = sorted(((-sum(s * t for s, t in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b)))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        length = rng.choice([0.1, 1, 1, 5])
        x = [float(rng.gauss(0, 1) * length) for _ in range(6)]
        if i % 7 == 0 and rows:
            x = rows[i // 2][1]
        rows.append((i, x))
    rows += [(1000, None), (1050, []), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1150, [math.nan] * 6), (1200, [math.inf] * 6), (1250, [0.0] * 6), (None, [1.0] * 6), (1300, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, id int")
    got = {tuple(r) for r in top_k(frame, bucket=32, pass_bytes=400).collect()}
    assert got == brute(rows, 5, 50)
    assert {tuple(r) for r in top_k(frame).collect()} == brute(rows, 5, 50)
    few = [r for r in rows if r[0] in (0, 3, 50)]
    assert {tuple(r) for r in top_k(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect()} == brute([(i, [float(__import__("numpy").float32(e)) for e in x]) for i, x in few], 5, 50)
    assert top_k(frame.limit(0)).count() == 0


def test_large_components_and_repeated_rows(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.choice([0, 1, -1, 2**23, 2**31, -(2**40), 2.0**50 + 0.5]) * rng.choice([1, 0.37])) for _ in range(4)]) for i in range(200)]
    rows += [rows[150], rows[150], rows[3]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k(frame, bucket=16).collect())
    whole = [(i, [math.floor(256 * e) for e in x]) for i, x in rows]
    want = []
    for q, a in whole:
        if q % 50 == 0:
            scored = sorted((-sum(s * t for s, t in zip(a, b)), i) for i, b in whole if i != q)[:5]
            want += [(q, r + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(scored)]
    assert got == sorted(want)


def test_no_shuffle_on_a_single_key(spark):
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "vec_id long, embedding array<double>")
    plan = top_k(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(dim" in plan and "place" in plan
