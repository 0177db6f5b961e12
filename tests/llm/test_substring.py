import hashlib
import random
import re

from quayside.llm.substring import SuffixAutomaton, dedup


def brute(rows, length=20):
    """Window by window, in order of id (null last), one text an id."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out, done = set(), {}, {}
    for i in order:
        if rows[i] in done:
            out[i] = done[rows[i]]
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[i][1] or "")
        gone = set()
        for a in range(len(words) - length + 1):
            window = tuple(words[a : a + length])
            if window in seen:
                gone.update(range(a, a + length))
            seen.add(window)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = done[rows[i]] = (rows[i][0], len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return [out[i] for i in range(len(rows))]


def cases():
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "\x1c", "\xa0x"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t "]) for _ in range(n))
    shared = [text(n) for n in (19, 20, 21, 25, 40, 90, 200)]
    rows = []
    for i in range(260):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += [text(rng.randrange(60)), rng.choice(shared)]
        rows.append((1000 - 3 * i, " ".join(parts)))
    common = text(30)
    rows += [(2000 + i, f"{text(12)} {common} {text(12)}") for i in range(60)]
    rows += [(3000, "same word " * 60), (3001, "same " * 75), (3002, "a b c " * 30), (3003, text(30) * 3), (4000, None), (4001, ""), (None, rows[5][1]), (4002, text(20000)), (3003 + 1000, rows[7][1]), (3002, "a b c " * 30)]
    return rows


def test_against_brute_force(spark):
    rows = cases()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, at int, key string")
    want = sorted(brute(rows), key=str)
    for most in (200, 3):
        got = sorted((tuple(r) for r in dedup(frame.repartition(5), most=most, with_text=True).collect()), key=str)
        wrong = [(g[:3], w[:3]) for g, w in zip(got, want) if g != w]
        assert not wrong, (len(wrong), wrong[:5])
    assert dedup(frame.limit(0)).count() == 0


def test_automaton_statistics():
    rng = random.Random(11)
    for _ in range(300):
        parts = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        automaton, held = SuffixAutomaton(), set()
        for p in parts:
            automaton.separate()
            for s in p:
                automaton.add(s)
            held |= {tuple(p[a:b]) for a in range(len(p)) for b in range(a + 1, len(p) + 1)}
        query = [rng.randrange(3) for _ in range(20)]
        want = [max([n for n in range(1, e + 2) if tuple(query[e + 1 - n : e + 1]) in held], default=0) for e in range(20)]
        assert automaton.statistics(query) == want
