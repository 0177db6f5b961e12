import random
import re
from collections import Counter, defaultdict

import pytest

from quayside.llm import divergence

KINDS = "doc_id long, text string, lang string, source string"


def plain(rows, least_docs=3, top=200):
    """Everything by loops over whole numbers."""
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        terms = [t.group() for t in re.finditer(r"(?:[a-z]|[^\x00-\x7f])+", lowered)]
        count[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least_docs]
        sources = [s for x, s in groups if x == lang]
        p, v = {}, len(kept)
        whole = Counter()
        for s in sources:
            n = sum(count[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (count[lang, s][t] + 1) // (n + v) for t in kept}
            whole.update({t: count[lang, s][t] for t in kept})
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + v) for t in kept}
        for s in sources:
            pair = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            term = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, last in (("pair", pair, None), ("term", term, top)):
                order = sorted(found, key=lambda x: (x[0], x[1].encode()))[:last]
                out += [(lang, s, part, item, -value, i) for i, (value, item) in enumerate(order, 1)]
    return sorted(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, KINDS).repartition(3)
    found = divergence.audit(docs, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in found.collect())


def test_against_loops(spark):
    rng = random.Random(3)
    words = ["the", "The", "THE", "naïve", "NAÏVE", "Ärger", "ärger", "x1y", "it's", "日本", "ok\x00no", "a", "b"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, rng.choice([" ", "\n", "-"]).join(rng.choices(words, k=rng.randrange(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None])) for i in range(120)]
    rows += [(500, None, "en", "s9"), (501, "", "xx", "only"), (502, "12 34", "xx", "other"), (None, "the", None, None)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, least_docs=8, top=3) == plain(rows, 8, 3)


def test_one_document_counts_once_towards_what_is_kept(spark):
    rows = [(1, "rare rare rare Rare", "en", "a"), (2, "rare", "en", "b"), (3, "word", "en", "a"), (4, "word", "en", "b"), (5, "word", "en", "b")]
    found = run(spark, rows)
    assert found == plain(rows) and {r[3] for r in found if r[2] == "term"} <= {"word"}


def test_repeated_rows_long_texts_and_no_rows(spark):
    rows = [(1, "alpha beta " * 40000, "en", "a")] * 3 + [(2, "gamma " * 3, "en", "b")] * 3 + [(3, "é" * 200000, "en", "b")] * 3
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_groups_without_kept_terms_have_pairs_of_zero(spark):
    rows = [(1, "one", "en", "a"), (2, "two", "en", "b"), (3, None, "en", "c")]
    assert run(spark, rows) == [("en", s, "pair", o, 0, i) for s in "abc" for i, o in enumerate([x for x in "abc" if x != s], 1)]


def test_shares_stay_exact_beyond_64_bits(spark):
    n, total = 9_100_000_000_000_000, 9_200_000_000_000_000
    row = spark.createDataFrame([(n, total, 7)], "n long, t long, v long").select(divergence.share(*[divergence.F.col(c) for c in "ntv"])).first()
    assert row[0] == 1 + 10**9 * (n + 1) // (total + 7)


def test_other_columns_are_ignored(spark):
    rows = [(i, f"alpha beta w{'abc'[i % 3]}", "en", f"s{i % 2}") for i in range(12)]
    docs = spark.createDataFrame(rows, KINDS).selectExpr("*", "1 as term", "'x' as item", "2 as rank", "3 as n", "4 as part")
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == plain(rows)


@pytest.mark.parametrize("parts", [1, 3])
def test_parts_do_not_change_ranks(spark, monkeypatch, parts):
    monkeypatch.setattr(divergence, "PARTS", parts)
    rows = [(i, " ".join(f"{a}{b}" for a in "abcdefgh" for b in "xyz" if (ord(a) + ord(b) * i) % 3), "en", f"s{i % 4}") for i in range(30)]
    assert run(spark, rows, top=5) == plain(rows, top=5)
