import random

import numpy as np
import xxhash

from quayside.llm.components import components
from quayside.llm.simhash import fingerprint, near_duplicates, near_links, pieces_for, within


def plain(text, width=4):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(values, radius=4):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = sorted(set(values))
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def near(rng, n):
    out = []
    for _ in range(n):
        base = rng.getrandbits(64)
        out.append(base)
        for _ in range(rng.randrange(5)):
            for _ in range(rng.randrange(6)):
                base ^= 1 << rng.randrange(64)
            out.append(base)
    return out


def test_fingerprints():
    for text in [None, "", " \t", "A b", "a b C d", "Éa b c d e", "x y z w " * 50, "one\vtwo three four\ffive six"]:
        assert fingerprint(text) == plain(text)


def test_bit_sliced_distances():
    rng = random.Random(3)
    values = np.array(near(rng, 80), dtype=np.uint64)
    for radius in (0, 1, 3, 4, 7):
        a, b = within(values[:70], values, radius)
        want = {(i, j) for i in range(70) for j in range(len(values)) if bin(int(values[i]) ^ int(values[j])).count("1") <= radius}
        assert set(zip(a.tolist(), b.tolist())) == want


def test_links_by_every_number_of_pieces(spark):
    rng = random.Random(4)
    values = near(rng, 60)
    want = brute([v - (v >> 63 << 64) for v in values] and values)
    signed = lambda v: v - (v >> 63 << 64)
    frame = spark.createDataFrame([(signed(v),) for v in sorted(set(values))], "fp long")
    for pieces, chunk in ((5, 512), (6, 512), (5, 3)):
        found = {r.node: r.root for r in components(near_links(frame, pieces=pieces, chunk=chunk)).collect()}
        groups = {}
        for v in set(values):
            groups.setdefault(found.get(signed(v), signed(v)), set()).add(v)
        expected = {}
        for v, r in want.items():
            expected.setdefault(r, set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert pieces_for(1000, 4) == 5 and pieces_for(10**8, 4) > 5


def test_chain_of_links(spark):
    n = 300
    frame = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (900, 901)], "u long, v long")
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {900: 900, 901: 900}
    assert components(frame.where("u < 0")).count() == 0


def test_whole_operator(spark):
    rows = [(7, "a b c d e f", "1"), (3, "A b  c d e f", "2"), (9, None, None), (8, "", "3"), (None, "a b c d e f", "4"), (2, "quite another text here indeed", "5"), (2, "quite another text here indeed", "5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), r.component_id) for r in near_duplicates(docs).collect())
    assert got == sorted([("7", 3), ("3", 3), ("9", 8), ("8", 8), ("None", 3), ("2", 2), ("2", 2)])
    assert near_duplicates(docs.limit(0)).count() == 0
