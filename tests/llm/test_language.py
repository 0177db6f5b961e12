from pyspark.sql import functions as F

from quayside.llm.language import declared_in, host_of, identify, suffix_of

WORDS = {"en": "the and of that is house water with for this", "de": "der und das nicht ein haus wasser mit für ist", "fr": "le et les dans une maison eau avec pour est"}


def rows_of(n, start):
    import random

    rng = random.Random(start)
    return [(start + i, " ".join(rng.choice(WORDS[k].split()) for _ in range(30)), k) for i, k in enumerate(list(WORDS) * n)]


def test_held_out_accuracy_and_edges(spark):
    seen = [(i, t, k, f"www.{k}.example.{k}", k) for i, t, k in rows_of(60, 0)]
    unseen = [(i, t, None, None, None) for i, t, _ in rows_of(60, 1000)]
    truth = {i: k for i, _, k in rows_of(60, 1000)}
    edges = [(5000, None, None, None, None), (5001, "123 !!", None, "www.de.example.de", None), (5002, "haus", "zz", "new.example.xx", None), (5003, "the " * 50000, None, None, None), (5004, "xqz", "de", "www.de.example.de", None)]
    frame = spark.createDataFrame(seen + unseen + edges, "doc_id long, text string, declared string, host string, language string")
    out = identify(frame, declared=F.col("declared"), host=F.col("host"), label=F.col("language"), keep=F.col("doc_id")).collect()
    got = {r._row: r for r in out}
    assert len(out) == len(got) == frame.count()
    right = sum(got[i].language == k for i, k in truth.items())
    assert right / len(truth) > 0.95
    assert not got[5000].kept and not got[5001].kept and got[5001].language == "de"
    assert got[5003].kept and got[5003].language == "en"
    assert got[5004].language == "de"  # the text says nothing, its site and declaration do
    assert identify(frame.limit(0), declared=F.col("declared")).count() == 0
    bare = identify(frame.where("language is null"), label=F.col("language")).collect()
    assert len(bare) == 185 and not any(r.kept for r in bare)


def test_page_evidence(spark):
    pages = [("https://user@WWW.Site.de:80/x?y", '<!DOCTYPE html><HTML class="a" lang="de-AT"><body>'), ("nothing", "<p lang='fr'>"), (None, None)]
    got = spark.createDataFrame(pages, "url string, html string").select(host_of(F.col("url")).alias("h"), declared_in(F.col("html")).alias("d"), suffix_of(host_of(F.col("url"))).alias("s")).collect()
    assert [tuple(r) for r in got] == [("www.site.de", "de", "de"), (None, None, None), (None, None, None)]


def test_pages_table(spark):
    from quayside.llm.language import page_language_id

    found = page_language_id(spark, "/root/testdata/sf0.001")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", declared_in(F.col("html")).alias("d"))
    joined = found.join(pages, "page_id").collect()
    assert len(joined) == pages.count() and all(r.kept for r in joined)
    assert sum(r.language == r.d for r in joined) >= 0.9 * len(joined)


def test_a_host_keeps_the_counts_of_all_its_suffixes(spark):
    from math import exp

    from quayside.llm.language import SMOOTHING, host_priors

    counts = [("h", "de", 0, 30), ("h", "fr", 1, 90), ("o", "de", 0, 10), ("p", None, 1, 5), (None, "fr", 1, 7)]
    spread = spark.createDataFrame(counts, "_host string, _suffix string, guess int, k long")
    prior, whole = host_priors(spread, 2)
    got = {r._host: [exp(x) for x in r._prior] for r in prior.collect()}
    total = [41.0, 103.0]
    assert all(abs(a - b / 144) < 1e-12 for a, b in zip(whole, total))
    back = {s: [(k + SMOOTHING * w) / (sum(ks) + SMOOTHING) for k, w in zip(ks, whole)] for s, ks in {"de": (40, 0), "fr": (0, 97)}.items()}
    for j, own in enumerate((30, 90)):
        mean = (30 * back["de"][j] + 90 * back["fr"][j]) / 120
        assert abs(got["h"][j] - (own + SMOOTHING * mean) / (120 + SMOOTHING)) < 1e-9
    assert abs(got["p"][1] - (5 + SMOOTHING * whole[1]) / (5 + SMOOTHING)) < 1e-9 and set(got) == {"h", "o", "p"}


def test_fusion_against_plain_version(spark):
    """Posteriors from the same text model by plain sums over all rows; declaration, suffix and host change results."""
    import math
    import random

    from quayside.llm import language as L

    rng = random.Random(9)
    rows = [(i, t, k) for i, t, k in rows_of(60, 0)]
    hosts = [f"{x}.{e}" for x in "abc" for e in ("de", "fr", "uk")] + [None, "a.de"]
    rows = [(i, t if i % 7 else rng.choice(["xqz", "haus the", "", None]), k if i % 4 else rng.choice(["de", "zz", None]), {"en": "a.uk", "de": "a.de", "fr": "b.fr"}[k] if i % 5 else rng.choice(hosts), k if i % 2 else None) for i, t, k in rows] + [(7, rows[7][1], "fr", "a.de", None)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, said string, host string, label string")
    got = sorted((r._row, r.language, r.posterior, r.kept) for r in L.identify(frame, declared=F.col("said"), host=F.col("host"), label=F.col("label"), keep=F.col("doc_id")).collect())
    names, logs = L.fit(frame.select("label", "text"))
    n = len(names)

    def text_logs(t):
        bucket, _ = L.trigrams(__import__("numpy").frombuffer((t or "").encode(), dtype="uint8"), __import__("numpy").array([0, len((t or "").encode())]))
        return [sum(logs[j][b] for b in bucket) * min(1.0, L.EFFECTIVE / max(len(bucket), 1)) for j in range(n)] if len(bucket) else None

    suffix = lambda h: h.rpartition(".")[2] if h else None
    data = [(i, text_logs(t), d, h) for i, t, d, h, _ in rows]
    guess = [(ll.index(max(ll)), d, suffix(h), h) for _, ll, d, h in data if ll]

    def weights(at):
        values = {g[at] for g in guess if g[at] is not None}
        total = [len(values) + 1 + sum(g[0] == j and g[at] is not None for g in guess) for j in range(n)]
        return lambda v: [0.0] * n if v is None else [math.log((sum(g[0] == j and g[at] == v for g in guess) + 1) / total[j]) for j in range(n)]

    said, ends = weights(1), weights(2)
    whole = [1 + sum(g[0] == j for g in guess) for j in range(n)]
    whole = [x / sum(whole) for x in whole]
    smooth = lambda mine, back: [(sum(g[0] == j for g in mine) + L.SMOOTHING * back[j]) / (len(mine) + L.SMOOTHING) for j in range(n)]

    def prior(h):
        mine = [g for g in guess if g[3] == h]
        return whole if h is None or not mine else smooth(mine, smooth([g for g in guess if g[2] == suffix(h)], whole))

    want = []
    for i, ll, d, h in data:
        total = [math.log(p) + a + b + c for p, a, b, c in zip(prior(h), said(d), ends(suffix(h)), ll or [0.0] * n)]
        top = max(total)
        p = 1 / sum(math.exp(x - top) for x in total)
        want.append((i, names[total.index(top)], p, ll is not None and p >= L.MIN_POSTERIOR))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want)):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 and a[3] == b[3]
    # the same text, with other evidence, is another language
    assert len({w[1] for w, r in zip(want, rows) if r[1] == "xqz"}) > 1
