import random

import numpy as np
import pyarrow as pa
import pytest

from quayside.llm import minhash


def three(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain(rows):
    """All pairs by their sets of words."""
    sets, parent = [three(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    out = []
    for i, (doc, _) in enumerate(rows):
        root = least.get(top(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), root, doc == root))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = minhash.near_duplicates(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = order(tuple(r) for r in found.collect())
    assert got == order(plain(rows))
    return got


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(4000)}"
    out = []
    for n in [3, 4, 6, 7, 8, 12, 20, 40] * 3 + [100, 250, 600] * 4:
        base = [word() for _ in range(n)]
        out.append(" ".join(base))
        for share in (0.0, 0.08, 0.15, 0.17, 0.2, 0.3):
            out.append(" ".join(base + [word() for _ in range(int(n * share))]))
        for changes in (1, 2, 3):
            changed = list(base)
            for _ in range(max(1, changes * n // 60)):
                changed[rng.randrange(n)] = word()
            out.append(" ".join(changed))
    return out


def test_against_all_pairs(spark, texts):
    got = check(spark, list(enumerate(texts)))
    assert 20 < sum(not kept for *_, kept in got) < len(got)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "one  two"), (8, "one two three"), (8, "one two three"), (9, "É x y"), (10, "é x y"), (None, "one two three"), (None, "alone in here now"), (11, "a b c " * 60000), (12, "a b c " * 60000 + "d"), (13, "two one")]
    check(spark, rows)
    check(spark, [])


def test_chains_and_bridges_between_components(spark):
    """Texts that drift word by word: far ends are unlike, but each is linked with the next."""
    rng = random.Random(2)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(40):
        rows.append((100 - i, " ".join(words)))
        for _ in range(2):
            words[rng.randrange(120)] = f"n{i}{rng.random()}"
    check(spark, rows)


@pytest.mark.parametrize("chunk", [2, 5])
def test_chunks_give_the_same(spark, texts, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "PARTNERS", chunk)
    check(spark, list(enumerate(texts[:160])))


def test_one_template_hardly_meets(spark):
    """Texts that share half of their words but are no near copies have no posting of their prefixes in common."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(50)]
    rows = [(i, " ".join(common + [f"o{rng.randrange(10**7)}" for _ in range(50)])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = minhash.nodes_of(docs, 3, "doc_id", "text").select("node", "sig").dropDuplicates(["node"])
    assert minhash.prefixes(nodes).count() < 600
    got = check(spark, rows)
    assert all(kept for *_, kept in got)


def test_similarity_is_a_comparison_of_whole_numbers():
    a = np.arange(20, dtype=np.uint64)
    assert minhash.similar(a, a[:17]) and not minhash.similar(a, a[:16])  # 17 / 20 is 0.85
    assert not minhash.similar(a, a[:0])


def test_mergeable_names_every_meeting_of_two_components():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (6, minhash.WIDE), dtype=np.uint8)
    sigs, roots, lists = [], [], []
    for i in range(60):
        sig = base[i % 6].copy()
        at = rng.choice(minhash.WIDE, rng.integers(0, 100), replace=False)
        sig[at] = rng.integers(0, 256, len(at))
        sigs.append(sig)
        roots.append(int(rng.integers(0, 20)))
        lists.append(sorted({50, *rng.integers(0, 1000, rng.integers(0, minhash.PREFIX - 1)).tolist()}))
    size = {r: roots.count(r) for r in roots}
    padded = [x + [-1] * (minhash.PREFIX - len(x)) for x in lists]
    payload = pa.array([np.array([r, size[r], 50, *x], dtype=np.int64).tobytes() + s.tobytes() for r, s, x in zip(roots, sigs, padded)], pa.binary())
    for shift in (0, 25):
        want, left = set(), 0
        for a in range(shift or 60):
            for b in range(shift or a + 1, 60):
                if roots[a] != roots[b] and (sigs[a] == sigs[b]).sum() >= minhash.WIDE_MATCHES:
                    if min(set(lists[a]) & set(lists[b])) < 50:
                        left += 1
                        continue
                    x, y = (a, b) if (size[roots[a]], roots[a]) < (size[roots[b]], roots[b]) else (b, a)
                    want.add((x, roots[y]))
        got = [(a, roots[b]) for a, b in minhash.mergeable(payload, shift)]
        assert left and want and len(got) == len(set(got)) and set(got) == want


def test_block_counts_what_sets_share():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    block = minhash.Block(list(enumerate(sets[:40])))
    done = set()
    for other in sets[40:]:
        want = {i for i in range(40) if i not in done and minhash.similar(sets[i], other, (1, 2))}
        assert set(block.similar_to(other, 1, 2)) == want
        done |= want
    assert done


@pytest.mark.parametrize("turns", [0, 1])
def test_what_turns_leave_open_is_settled(spark, texts, monkeypatch, turns):
    monkeypatch.setattr(minhash, "TURNS", turns)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "MEMBERS", 2)
    check(spark, list(enumerate(texts[:200])))


def test_one_group_of_near_copies(spark):
    """Copies with two changed words each: any two are near the threshold."""
    rng = random.Random(3)
    words = [f"g{i}" for i in range(60)]
    rows = []
    for i in range(300):
        own = list(words)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    check(spark, rows)
