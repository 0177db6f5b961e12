"""Values near words against a plain loop."""

import random
import re

from pyspark.sql import functions as F

from quayside.operators import proximity

MAIL, CALL = r"[a-z0-9]+@[a-z]+(?:\.[a-z]+)+", r"\+[0-9]{6,}"


def by_loops(rows, words, barred, unless, required):
    out = {}
    for doc, text in rows:
        text = text or ""
        for pattern in (MAIL, CALL):
            for m in re.finditer(pattern, text):
                context = " ".join(text[max(0, m.start() - 180) : m.end() + 180].split())
                has = lambda xs: any(x in context.lower() for x in xs)
                if has(words) and not (has(barred) and not has(unless)) and (not required or has(required)):
                    if (doc, m[0]) not in out or m.start() < out[doc, m[0]][0]:
                        out[doc, m[0]] = (m.start(), context)
    return sorted((d, v, *x) for (d, v), x in out.items())


def test_against_loops(spark):
    rng = random.Random(2)
    piece = lambda: rng.choice(["a1@x.ru", "b@y.com.ua", "+1234567", "Кирпич", "куплю", "продажа", "завод", "слово " * rng.randrange(30), "\n", "é🙂"])
    rows = [(i, " ".join(piece() for _ in range(rng.randrange(60)))) for i in range(80)] + [(90, None), (91, ""), (92, "m@x.ru " * 3000 + "кирпич")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    for required in ([], ["завод"]):
        got = sorted(tuple(r) for r in proximity.near_words(docs, "text", [MAIL, CALL], ["кирпич"], ["куплю"], ["продажа"], required).collect())
        assert got == by_loops(rows, ["кирпич"], ["куплю"], ["продажа"], required)
    places = docs.where("doc_id = 92").select(F.size(proximity.match_places(F.col("text"), MAIL)).alias("n"), F.element_at(proximity.match_places(F.col("text"), MAIL), -1)["at"].alias("at")).first()
    assert tuple(places) == (3000, 7 * 2999)
