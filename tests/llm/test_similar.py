import random

import numpy as np
import pytest

import corpus_pipeline
from quayside.llm import similar

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def five(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(texts):
    sets, parent = [five(t) for t in texts], list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return [top(a) for a in range(len(sets))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    out = ["", "  ", "one two", "one two", "One  TWO", None]
    for n in [5, 6, 7, 8, 9, 10, 12, 20, 40] * 3 + [100, 250, 400] * 5:
        base = [word() for _ in range(n)]
        out.append(" ".join(base))
        for share in (0.0, 0.05, 0.1, 0.15, 0.2, 0.3):  # added at the end: similarity n / (n + added)
            out.append(" ".join(base + [word() for _ in range(int(n * share))]))
        changed = list(base)
        for _ in range(max(1, n // 50)):
            changed[rng.randrange(n)] = word()
        out.append(" ".join(changed))
    return out


def test_pairs_between_080_and_090_are_there(texts):
    sets = [five(t) for t in texts]
    share = [jaccard(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.8 <= x < 0.9 for x in share) > 50 and sum(0.7 <= x < 0.8 for x in share) > 20


def test_stage_against_brute_force(spark, texts):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, KINDS).repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(set(groups(texts)))


def test_chunks_give_the_same(spark, texts, monkeypatch):
    monkeypatch.setattr(similar, "FILE_CHUNK", 2)
    monkeypatch.setattr(similar, "SET_CHUNK", 2)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], KINDS)
    found = similar.near_copies(docs).groupBy("component").agg({"least": "min"}).collect()
    assert sorted(r[1].doc_id for r in found) == sorted(set(groups(texts)))


@pytest.mark.parametrize("n", [3, 64, 65, 200])
def test_within_is_exact(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    values = np.concatenate([base, base ^ rng.integers(0, 1 << 30, n, dtype=np.uint64)])
    got = set(zip(*[x.tolist() for x in similar.within(base, values)]))
    assert got == {(i, j) for i, a in enumerate(base.tolist()) for j, b in enumerate(values.tolist()) if (a ^ b).bit_count() <= similar.RADIUS}
