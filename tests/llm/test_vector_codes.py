import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from quayside.llm import vector_codes
from quayside.llm.vector_codes import Codebooks, assign_part, distances

KINDS = "vec_id long, embedding array<double>, label int"


def plain(rows, entries=256, rounds=4):
    """Lloyd's rounds as they are written: every part against every entry, each time."""
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    if not rows:
        return [], ""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(rows[0][1])
    rows = [r for r in rows if len(r[1]) == dim]
    whole = [[math.floor(1024 * x) if abs(x) < 2**40 else int(x) * 1024 for x in r[1]] for r in rows]
    cuts = [i * dim // 4 for i in range(5)]
    parts = [[w[a:b] for a, b in zip(cuts, cuts[1:])] for w in whole]
    books = [[list(p[k]) for p in parts[:entries]] for k in range(4)]

    def nearest():
        return [[min((sum((a - b) ** 2 for a, b in zip(p[k], e)), i) for i, e in enumerate(books[k])) for k in range(4)] for p in parts]

    for _ in range(rounds):
        at = nearest()
        for k in range(4):
            held = defaultdict(list)
            for p, a in zip(parts, at):
                held[a[k][1]].append(p[k])
            for i, members in held.items():
                books[k][i] = [sum(c) // len(members) for c in zip(*members)]
    at = nearest()
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(r[0], r[2], "".join(f"{i:02x}" for _, i in a), min(sum(d for d, _ in a), vector_codes.MOST)) for r, a in zip(rows, at)], sha


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def check(spark, rows, **options):
    table = spark.createDataFrame(rows, KINDS).repartition(3)
    coded, books = vector_codes.compress(table, **options)
    want, sha = plain(rows, options.get("entries", 256), options.get("rounds", 4))
    assert order(tuple(r) for r in coded.collect()) == order(want)
    if want:
        assert vector_codes.codebooks_sha256(books) == sha


def test_against_plain_rounds(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], rng.randrange(3)) for i in range(500)]
    check(spark, rows, entries=16)
    check(spark, rows[:100])


def test_ties_repeated_rows_and_equal_entries(spark):
    rng = random.Random(6)
    rows = [(i // 3, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(8)], None) for i in range(300)] + [(7, [0.0] * 8, 1)] * 200
    check(spark, rows, entries=10)


def test_left_out_rows_null_ids_and_other_dimensions(spark):
    bad = [(1, None, 0), (2, [], 0), (3, [1.0, None, 0.0, 0.0], 0), (4, [math.nan] * 4, 0), (5, [math.inf, 0.0, 0.0, 0.0], 0)]
    good = [(10, [0.1, 0.2, -0.3, 0.4], None), (None, [0.2, 0.2, 0.2, 0.2], 1), (11, [9.0, -9.0, 0.0, 0.001], 1), (12, [1.0, 2.0], 1)]
    check(spark, bad + good, entries=2)
    check(spark, [(1, [0.5, 0.25, 0.125, 1.0, 2.0, 3.0], 1), (2, [1.5, 0.25, 0.125, 1.0, 2.0, 3.0], 1)])  # four does not divide six
    check(spark, [(1, [0.5], 1), (2, [0.75], 1)])
    check(spark, bad)
    check(spark, [])


def test_components_of_any_size(spark):
    rows = [(i, [x, -x, x / 3, 1.0], 1) for i, x in enumerate([1e5, 1e9, 1e12, 1e18, 1e30, -1e30, 3e30, 0.0, 7.25])]
    check(spark, rows, entries=3)


def test_bounds_fail_only_where_they_must():
    rng = np.random.default_rng(1)
    x = rng.integers(-1000, 1000, (3000, 6))
    book = Codebooks([x[:40].copy()])
    at, upper, lower = np.zeros(3000, dtype=np.int64), np.full(3000, np.inf), np.full(3000, -np.inf)
    assert assign_part(x, book, 0, at, upper, lower) > 2900  # all but those near the entry they begin with
    scanned = []
    for _ in range(6):
        entries = book.entries[0].copy()
        for e in np.unique(at):
            entries[e] = x[at == e].sum(axis=0) // (at == e).sum()
        book = Codebooks([entries], book.entries)
        scanned.append(assign_part(x, book, 0, at, upper, lower))
        assert (at == np.argmin(distances(x, entries), axis=1)).all()
    assert scanned[-1] < 2500


def test_query_adds_up_equal_labels(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.choice([1, 2, None])) for i in range(40)]
    table = spark.createDataFrame(rows, KINDS).selectExpr("*", "1 as code", "'x' as error")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op13_vector_codes(spark, str(tmp_path)).collect()
    want, sha = plain(rows)
    total = defaultdict(int)
    for _, label, _, error in want:
        total[label] += error
    assert sorted(tuple(r) for r in got) == sorted((i, code, error, total[label], sha) for i, label, code, error in want)


@pytest.mark.parametrize("value", [2**20, 2**30, 2**80])
def test_distances_are_exact(value):
    x = np.array([[value, -value], [0, 1], [value - 1, 3]], dtype=object)
    want = [[int(sum((int(a) - int(b)) ** 2 for a, b in zip(r, s))) for s in x] for r in x]
    assert [[int(v) for v in row] for row in distances(vector_codes.narrow(x), vector_codes.narrow(x))] == want
