import random

from quayside.llm.decontamination import find_leaks, shingles_of, words_of


def brute(docs, items, threshold=0.8, width=5):
    out = []
    for d, text in docs:
        words = words_of(text)
        for i, item in items:
            own_words = words_of(item)
            if own_words:
                k = min(width, len(own_words))
                own = shingles_of(own_words, k)
                shared = len(own & shingles_of(words, k))
                if words and shared >= threshold * len(own):
                    out.append((d, i, len(own), shared))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 6, 20, 40, 150, 700]))) for i in range(60)] + [(900, None), (901, "?!"), (None, text(30)), (5, "Same Item, twice over and over"), (5, "Same Item, twice over and over")]
    docs = []
    for d in range(150):
        parts = [text(rng.randrange(400))]
        for _ in range(rng.randrange(3)):
            words = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if words:
                    words[rng.randrange(len(words))] = "changed"
            cut = rng.randrange(len(words) + 1) if rng.random() < 0.3 else 0
            parts += [" ".join(words[:cut]).upper(), text(rng.randrange(60)), ", ".join(words[cut:])] if cut else ["; ".join(words)]
            parts.append(text(rng.randrange(400)))
        docs.append((d, " ".join(parts)))
    docs += [(500, None), (501, ""), (None, items[20][1]), (502, text(60000) + " " + items[30][1]), (503, items[3][1]), (503, items[3][1])]
    left = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    right = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for pass_bytes in (1 << 24, 4000):
        got = sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in find_leaks(left, right, pass_bytes=pass_bytes).collect()), key=str)
        assert got == want
    assert find_leaks(left, right.limit(0)).count() == 0 and find_leaks(left.limit(0), right).count() == 0
