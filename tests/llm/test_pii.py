import random
import re

from pyspark.sql import functions as F

from quayside.llm import pii
from quayside.llm.pii import KINDS, base_spans, expectation_maximisation, find, train, written_out


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c)
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def brute(text):
    out = []
    text = text or ""
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def texts():
    rng = random.Random(6)
    parts = ["a", "b.c", "@", ".", "..", "_x", "%", "+", "1", "12", " ", "-", "(", ")", "é", "🙂", "x@y.z", "a@b.c_d@e.f", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "  ", "00000255.1.1.1", "\n"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)]
    return [*out, "", None, "9" * 30000, "1 2 " * 20000, "a" * 100000 + "@b.c", "a." * 20000, "x@" + "b." * 300 + "c", "a@" + "b." * 1500 + "c", "a@b.c " * 5000, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"]


def test_base_against_brute_force(spark):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in frame.select("doc_id", written_out(base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()}
    wrong = [(text, got[i], brute(text)) for i, text in rows if got[i] != brute(text)]
    assert not wrong, wrong[:3]


def plain_find(rows):
    """The whole method in plain Python: {id: spans as written out}."""
    held = {}
    for i, text in rows:
        text = text or ""
        spans = []
        for part in filter(None, brute(text).split(",")):
            kind, start, end = part.split(":")
            spans.append((int(start), KINDS.index(kind), int(end)))
        base = sorted(spans)
        loose = [(m.start(), KINDS.index(kind), m.end()) for kind, pattern in pii.CANDIDATES.items() for m in re.finditer(pattern, text)]
        held[i] = [(s, row_of(text, s, base + loose)) for s in base], [(s, row_of(text, s, base + loose)) for s in loose]
    counts = {}
    for base, loose in held.values():
        for _, row in base + loose:
            counts[row] = counts.get(row, 0.0) + 1
    weights, _ = pii.fitted(list(counts.items()))
    out = {}
    for i, (base, loose) in held.items():
        added = [s for s, row in loose if sum(weights.get(x, 0.0) for x in pii.names_of(row)) > 0 and not any(b[0] < s[2] and s[0] < b[2] for b, _ in base)]
        out[i] = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted([s for s, _ in base] + added))
    return out


LOOSE = {"card": r"[0-9]([\x20-]?[0-9])+", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def row_of(text, span, spans):
    start, kind, end = span
    name, value = KINDS[kind], text[start:end]
    pattern = pii.CANDIDATES.get(name) or LOOSE[name]
    whole = text
    if name == "card":  # separators that are not between digits are no part of what is matched; what stands before is the text's own
        text, pattern = re.sub(r"[ -](?![0-9])|(?<![0-9])[ -]", "x", text), r"[0-9][0-9 -]+"
    before = whole[:start]
    for m in re.finditer(pattern, text):
        if m.end() <= start:
            before = whole[m.end() : start]
    before = before[-pii.CONTEXT :]
    has = lambda p: re.search(p, value) is not None
    known, barred = pii.KNOWN[name]
    share = 10 * sum(c in "0123456789" for c in value) // max(1, len(value))
    low, high = pii.SHARE[name]
    context = 1 if re.search(pii.CONTEXT_FOR, before) else -1 if re.search(pii.CONTEXT_AGAINST, before) else 0
    front = 2 if re.search(r"[\"'=:]$", before) else 1 if re.search(r"(?:^|\s)$", before) else 0
    return (kind, 1 if has(pii.STRICT[name]) else -1, -1 if has(barred) else 1 if has(known) else 0, context, 1 if low <= share <= high else -1, min(6, len(value) // 8), share // 3, front)


def test_find_against_plain_version(spark):
    rng = random.Random(8)
    parts = ["call (212) 555-1234 now", "order 100-123-4567x", "joe [at] site [dot] com", "ssn 219-09-9999", "Mr. John Smith", "Dr The", 'token = "' + "0a1b2c3d4e" * 4 + '"', "sk-Ab1" + "Cd2" * 8, "some/very/long/path/of/words", "x" * 40, "key: ghp_" + "a1B2" * 6, "a@b.com", "10.0.0.1", "+1 (743) 555-3824", "4111 1111 1111 1111", "plain words", "é🙂", "1234567890123456789012", "sha 0123456789abcdef0123456789abcdef"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(8)))) for i in range(600)] + [(1000, None), (1001, ""), (1002, "token " * 3000 + 'k = "' + "9f" * 20 + '"')]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = {r.doc_id: r.s for r in find(frame).select("doc_id", written_out(F.array_sort(F.concat("base", "added"))).alias("s")).collect()}
    want = plain_find(rows)
    wrong = [(t, got[i], want[i]) for i, t in rows if got[i] != want[i]]
    assert not wrong, wrong[:3]
    assert "secret:" in got[1002]


def test_words_before_a_card_are_read(spark):
    texts = ["my card 4111111111111111 ok", "isbn 4111111111111111", "4111 1111 1111 1111", "visa - 4111-1111-1111-1111.", 'card="4111111111111111"', "page-4111111111111111"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    spans = frame.select("text", F.explode(pii.base_spans(F.col("text"))).alias("s")).select("text", "s.value", pii.features(F.col("s")).alias("f"))
    got = {r.text: (r.value, r.f.context, r.f.front) for r in spans.collect()}
    assert [got[t][1:] for t in texts] == [(1, 1), (-1, 1), (0, 1), (1, 1), (1, 2), (-1, 0)]
    assert got[texts[3]][0] == "4111-1111-1111-1111"


def test_planted_secrets_are_added(spark):
    found = pii.op9_personal_data(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.join(found, "doc_id").select("text", "spans", "n_spans").collect()
    planted = [r for r in rows if re.search(r'token = "[0-9a-f]{40}"', r.text or "")]
    assert len(planted) >= 10 and all("secret:" in r.spans for r in planted)
    bare = [r for r in rows if not re.search(r"[0-9@]", r.text or "")]
    assert len(bare) > 100 and sum(r.n_spans > 0 for r in bare) <= 0.01 * len(bare)


def test_votes_and_added_spans(spark):
    rows = [(i, f"call (212) 555-{1000 + i} now") for i in range(40)] + [(100 + i, f"order 100-123-{1000 + i}x") for i in range(40)]
    rows += [(200, "mail me: joe [at] site [dot] com"), (201, "ssn 219-09-9999"), (202, "plain words only"), (203, None), (203, None), (None, "tel 212.555.0000")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, base string")
    got = [(r.doc_id, r.s) for r in find(frame).select("doc_id", written_out(F.col("added")).alias("s")).collect()]
    assert len(got) == len(rows)
    found = dict(got)
    assert found[0] == "phone_local:5:19" and found[202] == "" and found[203] == "" and found[201] == "id_number:4:15" and found[100] == ""
    assert find(frame.limit(0)).count() == 0


def test_estimates_follow_planted_reliabilities():
    rng = random.Random(7)
    counts, right = {}, 0
    truth = {}
    for _ in range(20000):
        z = rng.random() < 0.4
        votes = tuple((1 if z else -1) if rng.random() < p else (-1 if z else 1) for p in (0.9, 0.8, 0.7, 0.85))
        counts[(4, *votes)] = counts.get((4, *votes), 0) + 1
        truth.setdefault((4, *votes), []).append(z)
    prior, vote, posterior = expectation_maximisation(sorted(counts.items()))
    assert abs(prior[4] - 0.4) < 0.1
    assert vote[0, 1, 1] > vote[3, 1, 1] > vote[1, 1, 1] > vote[2, 1, 1] > 0.5
    weights = train([((*p, 1, 1, 1), n) for p, n in counts.items()], posterior)
    for p, zs in truth.items():
        s = sum(weights.get(x, 0) for x in pii.names_of((*p, 1, 1, 1)))
        right += sum((s > 0) == z for z in zs)
    assert right / 20000 > 0.9
