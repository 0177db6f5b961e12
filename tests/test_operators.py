import difflib
import random
import re

from pyspark.sql import functions as F

from quayside.operators import extraction, joins, merges, sequences


def test_domain_suffixes_and_flags(spark):
    rows = spark.createDataFrame([(1, "a.b.site.ru"), (2, "xsite.ru"), (3, "site.ru"), (4, None)], "id int, host string")
    listed = spark.createDataFrame([("Site.ru",), ("site.ru",)], "domain string")
    assert {r.id: r.f for r in joins.suffix_flag(rows, "host", listed, "domain", "f").collect()} == {1: True, 2: False, 3: True, 4: False}
    assert sorted(r.id for r in joins.suffix_anti_join(rows, "host", listed, "domain").collect()) == [2, 4]
    plan = joins.suffix_anti_join(rows, "host", listed, "domain")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairs_streaks_and_budget(spark):
    events = [(1, 1, "out"), (1, 2, "out"), (1, 5, "in"), (1, 6, "in"), (1, 7, "out"), (1, 9, "in"), (2, 1, "in"), (2, 3, "out")]
    frame = spark.createDataFrame([(k, t, i, e) for i, (k, t, e) in enumerate(events)], "k int, t int, i int, e string")
    got = sequences.pair_first_then_next(frame, ["k"], ["t", "i"], F.col("e") == "out", F.col("e") == "in", "t")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 5), (1, 7, 9)]
    health = sequences.trailing_health(frame, ["k"], [F.col("t"), F.col("i")], "e", "in", 2)
    assert sorted(tuple(r) for r in health.collect()) == [(1, 1, 2, 1), (2, 0, 2, 1)]
    counts = sequences.rolling_count(frame, ["k"], F.col("t").cast("long"), 2, "n")
    assert {r.i: r.n for r in counts.collect()} == {0: 1, 1: 2, 2: 1, 3: 2, 4: 3, 5: 2, 6: 1, 7: 2}


def test_breaker_against_a_loop(spark):
    rng = random.Random(12)
    rows = [(rng.randrange(5), float(rng.randrange(20000)), i, rng.random() < 0.6) for i in range(600)]
    want = {}
    for k in range(5):
        level, until, failures = 0, 0.0, []
        for _, t, i, bad in sorted(r for r in rows if r[0] == k):
            if not bad:
                level, until, failures, state = 0, 0.0, [], "closed"
            else:
                failures = [f for f in failures if t - f < 900] + [t]
                if len(failures) >= 3:
                    until, failures, state = t + 3600, [], "open"
                else:
                    until, level, state = max(until, t + min(3600, 300 * 2**level)), level + 1, "cooling"
            want[i] = (state, until)
    frame = spark.createDataFrame(rows, "k int, t double, i int, bad boolean").repartition(3)
    got = {r.event_id: (r.state, r.until) for r in sequences.breaker_log(frame, "k", "t", "i", "bad").collect()}
    assert got == want


def test_merges_are_idempotent(spark):
    schema = "id int, name string, n int, year int"
    a = spark.createDataFrame([(1, "", 1, 2020), (2, "b", None, 2021), (3, "c", 3, 2022)], schema)
    b = spark.createDataFrame([(1, "x", None, 2020), (2, "", 5, 2020), (4, "d", 4, 2020), (4, "e", 6, 2021)], schema)
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "name", "n", "year").collect())
    cases = {
        merges.insert_or_ignore: [(1, "", 1, 2020), (2, "b", None, 2021), (3, "c", 3, 2022), (4, "d", 4, 2020)],
        merges.last_writer_wins: [(1, "x", None, 2020), (2, "b", None, 2021), (3, "c", 3, 2022), (4, "e", 6, 2021)],
        merges.fill_blank_only: [(1, "x", 1, 2020), (2, "b", 5, 2021), (3, "c", 3, 2022), (4, "e", 6, 2021)],
        merges.overwrite_unless_blank: [(1, "x", 1, 2020), (2, "b", 5, 2020), (3, "c", 3, 2022), (4, "e", 6, 2021)],
    }
    for merge, want in cases.items():
        once = merge(a, b, ["id"], ["year"])
        assert rows(once) == want, merge.__name__
        assert rows(merge(once, b, ["id"], ["year"])) == want, merge.__name__
    lists = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "id int, l array<string>")
    more = spark.createDataFrame([(1, "b"), (1, "a"), (3, "z")], "id int, x string")
    assert sorted(tuple(r) for r in merges.append_to_list(lists, more, ["id"], "l", "x").collect()) == [(1, ["a", "b"]), (2, ["b"]), (3, ["z"])]
    assert [r.id for r in merges.conflicting_keys(b, "id", "name").collect()] == [4]


def test_pages(spark):
    code = "7a" + bytes(x ^ 0x7A for x in b"cf@firma.ru").hex()
    html = f"""<html><body><a href="mailto:A@firma.ru?subject=x">write</a><a data-cfemail="{code}">[protected]</a><span itemprop="email">micro@firma.ru</span>
    <p>text@firma.ru, logo@2x.png, info (at) firma (dot) ru</p><script type="application/ld+json">{{"a": [{{"email": "ld@firma.ru", "taxID": "7707083893"}}]}}</script>
    <script>var c = {{\\"email\\":\\"json@firma.ru\\"}}; x("js@firma.ru")</script> ИНН: 7736050003 <!-- x@y.ru --></body></html><html><p>second@firma.ru"""
    pages = spark.createDataFrame([("firma.ru", "u1", html), ("firma.ru", "u2", "<p>text@firma.ru <a href='mailto:text@firma.ru'>"), ("b.ru", "u3", None)], "host string, url string, html string")
    got = {(r.kind, r.value): (r.way, r.pages) for r in extraction.by_site(extraction.from_pages(pages)).collect()}
    assert got == {
        ("email", "a@firma.ru"): ("mailto", 1), ("email", "cf@firma.ru"): ("cfemail", 1), ("email", "micro@firma.ru"): ("microdata", 1), ("email", "text@firma.ru"): ("mailto", 2),
        ("email", "info@firma.ru"): ("obfuscated", 1), ("email", "ld@firma.ru"): ("jsonld", 1), ("email", "json@firma.ru"): ("jsonfield", 1), ("email", "js@firma.ru"): ("script", 1),
        ("email", "second@firma.ru"): ("text", 1), ("number", "7707083893"): ("jsonld", 1), ("number", "7736050003"): ("labeled", 1),
    }


def test_windows_against_a_loop(spark):
    rng = random.Random(13)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randrange(300))) for _ in range(80)] + ["", None, "a" * 200]

    def plain(text, margin=5, limit=60):
        text = re.sub(r"\s+", " ", text or "").strip()
        if len(text) <= limit:
            return text
        spans = []
        for m in re.finditer("bb", text):
            a, b = max(0, m.start() - margin), min(len(text), m.end() + margin)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        return " … ".join(text[a:b] for a, b in spans)[:limit] if spans else text[-limit:]

    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.w for r in frame.select("i", extraction.windows_around(F.col("t"), "bb", 5, 60).alias("w")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_similarity_share(spark):
    base = "we offer bricks and planks at the lowest price in town"
    groups = {1: [base, base + "!", base.upper()], 2: [base, "nothing alike here"], 3: ["  "], 4: [base]}
    rows = [(k, i, t) for k, ts in groups.items() for i, t in enumerate(ts)]
    got = {r.k: r.share for r in extraction.similarity_share(spark.createDataFrame(rows, "k int, i int, t string"), ["k"], "i", "t").collect()}
    assert difflib.SequenceMatcher(None, base, "nothing alike here").ratio() < 0.92
    assert got == {1: 1.0, 2: 0.5, 4: 1.0}


def test_latest_overlap_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, " \t".join(rng.choice(["a", "<x@y>", f"t{i % 9}", f"u{rng.randrange(40)}", "é"]) for _ in range(rng.randrange(4)))) for i in range(60)] + [(60, None), (61, "alone"), (62, "a\n\n  b ")]
    seen = {i: set((t or "").split()) for i, t in rows}
    want = []
    for i in seen:
        others = [j for j in seen if j != i and seen[i] & seen[j]]
        want += [(i, max(others), len(seen[i] & seen[max(others)]))] if others else []
    frame = spark.createDataFrame(rows, "item_id long, text string")
    tables = type("T", (), {"benchmark": frame})
    import quayside.plans.registry  # the register first: it imports the plans in their order
    from quayside.plans.relational import token_overlap_pairs

    assert sorted(tuple(r) for r in token_overlap_pairs(tables).collect()) == want


def test_sliced_join_deals_pairs_to_tasks(spark):
    from quayside.operators.joins import sliced_join

    left = spark.range(2000).selectExpr("id % 1000 AS a", "CASE WHEN id % 50 = 0 THEN id % 7 WHEN id % 50 = 1 THEN NULL ELSE 1 END AS k").repartition(2)
    right = spark.range(300).selectExpr("id % 250 AS b", "CASE WHEN id % 20 = 0 THEN id % 9 WHEN id % 20 = 1 THEN NULL ELSE 1 END AS k")
    want = sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    for pairs in (20_000, 10**9):
        got = sliced_join(left, right, ["k"], pairs).select("k", "a", "b")
        assert sorted(map(tuple, got.collect())) == want
    sizes = sliced_join(left, right, ["k"], 5000).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == len(want) and len(sizes) > 100 and max(sizes) < 8 * 5000
    assert sliced_join(left.where("false"), right, ["k"]).collect() == []
