"""Registry resolving against plain loops, numbers of texts with every confusable label."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quayside.functions import company
from quayside.operators import companies

REGISTRY = "inn string, ogrn string, name string, site string, emails array<string>"


def number(base):
    return f"{base:09d}{sum(int(d) * w for d, w in zip(f'{base:09d}', company.WEIGHTS_10)) % 11 % 10}"


def ids(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", company.ids_of_text(F.col("t")).alias("x"))
    return [[(y.number, y.method) for y in r.x] for r in rows.orderBy("i").collect()]


def by_loops(text):
    ok = lambda n: len(n) == 10 and n == number(int(n[:9]))
    labelled = [re.sub(r"[\s-]", "", m) for m in re.findall(r"(?i)\b(?:ИНН|INN)\b\s*(?:/\s*КПП\s*)?[:№\-—\s]*([0-9][0-9\s-]{8,14}[0-9])(?![0-9])", text)]
    out = {n: "labeled" for n in labelled if ok(n)}
    for m in re.finditer(r"(?<![0-9])([0-9][0-9\s-]{8,14}[0-9])(?![0-9])", text):
        before, n = text[max(0, m.start() - 40) : m.start()].lower(), re.sub(r"[\s-]", "", m[1])
        if ok(n) and not any(w in before for w in company.OWN_LABELS + company.OTHER_LABELS):
            out.setdefault(n, "text")
    return sorted(out.items())


@pytest.mark.parametrize("label", company.OTHER_LABELS)
def test_every_other_label_vetoes(spark, label):
    n = number(770123456)
    got = ids(spark, [f"{label.upper()}: {n}", f"{label} " + "x" * 45 + f" {n}", f"{label} ИНН {n}"])
    assert got == [[], [(n, "text")], [(n, "labeled")]]


def test_numbers_against_loops(spark):
    rng = random.Random(3)
    some = lambda *x: rng.choice(x)
    piece = lambda: some(number(rng.randrange(10**9)), number(rng.randrange(10**9)), str(rng.randrange(10**9, 10**10)), some(*company.OTHER_LABELS), "ИНН ", "inn: ", "слово " * rng.randrange(8), "12345", ", ")
    texts = [some(" ", ". ").join(piece() for _ in range(rng.randrange(14))) for _ in range(300)] + ["", None]
    for t, got in zip(texts, ids(spark, texts)):
        assert sorted(got) == by_loops(t or ""), t


def name_words(name):
    return {w for w in re.split("[^а-яёa-z0-9]+", re.sub(r"(?iu)\b(?:ооо|ао)\b", " ", name.lower())) if len(w) > 2}


def test_names_against_loops(spark):
    rng = random.Random(4)
    words = ["торг", "сервис", "кирпич", "завод", "двор", "бетон", "сталь"] + [f"имя{i}" for i in range(30)]
    named = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 4)))
    registry = [(number(i), None, f"ООО {named()}", rng.choice(["", f"http://www.h{rng.randrange(30)}.ru/"]), [rng.choice(["a@mail.ru", f"i@h{rng.randrange(30)}.ru", "k@mail.ru"])]) for i in range(300)]
    queries = [(f"h{rng.randrange(30)}.ru", i, named()) for i in range(80)]
    known = [(f"h{i}.ru", "K@mail.ru") for i in range(0, 30, 2)]
    df = {}
    for r in registry:
        for w in name_words(r[2]):
            df[w] = df.get(w, 0) + 1
    want = {}
    for host in {q[0] for q in queries}:
        ranked = []
        for _, place, query in sorted((q for q in queries if q[0] == host), key=lambda q: q[1]):
            own = {w: 1_000_000 // df[w] for w in name_words(query) if w in df}
            found = []
            for inn, _, name, _, _ in registry:
                score = sum(own[w] for w in name_words(name) & set(own))
                if score and 2 * score >= sum(own.values()):
                    found.append((-score, len(name), inn))
            ranked += [inn for *_, inn in sorted(found)]
        best = None
        for inn in list(dict.fromkeys(ranked))[:6]:
            _, _, name, site, emails = next(r for r in registry if r[0] == inn)
            kind = "site" if site.endswith(f"www.{host}/") else "email" if host in dict(known) and "k@mail.ru" in emails else "domain" if emails[0] == f"i@{host}" else "none"
            weight = company.EVIDENCE_WEIGHT[kind]
            if weight >= 60 and (best is None or weight > best[0]):
                best = (weight, inn, kind)
        if best:
            want[host] = best[1:]
    frames = [spark.createDataFrame(rows, kind) for rows, kind in ((queries, "host string, place int, query string"), (known, "host string, known_email string"), (registry, REGISTRY))]
    got = {r.host: (r.inn, r.evidence) for r in companies.resolve_by_name(*frames).collect()}
    assert got == want and len(want) > 3


def test_later_queries_of_a_host_are_answered_in_rounds(spark):
    # no record has half of "раз два три", whose words are as rare as each other; the answers come late, and some again
    registry = spark.createDataFrame([(number(i), None, w, "", []) for i, w in enumerate(["раз", "два", "три", "кирпич", "кирпич а", "бетон", "бетон кирпич"])], REGISTRY)
    asked = [("late.ru", i, "раз два три") for i in range(20)] + [("late.ru", 20, "бетон"), ("late.ru", 21, "раз два три"), ("late.ru", 40, "кирпич"), ("late.ru", 41, "бетон"), ("never.ru", 1, "раз два три"), ("soon.ru", None, "кирпич"), (None, 7, "три")]
    asked = spark.createDataFrame(asked, "host string, place int, query string")
    got = [tuple(r) for r in companies.name_candidates(asked, registry).orderBy("host", "rank").collect()]
    at = lambda host, *found: [(host, number(n), rank) for rank, n in enumerate(found, 1)]
    assert got == at(None, 2) + at("late.ru", 5, 6, 3, 4) + at("soon.ru", 3, 4, 6)
    assert [r["rank"] for r in companies.name_candidates(asked, registry, 2).where("host = 'late.ru'").orderBy("rank").collect()] == [1, 2]
    assert companies.name_candidates(asked.where("false"), registry).collect() == []


def test_a_frequent_word_in_many_queries(spark):
    many = 12_000  # each of as many queries shares its words with all records: 144 million pairs if all were met
    registry = spark.range(many).selectExpr("lpad(id, 10, '0') AS inn", "'' AS ogrn", "concat('сервис торг ', repeat('x', int(id % 2))) AS name", "'' AS site", "array('') AS emails")
    queries = spark.range(many).selectExpr("concat('h', id % 5) AS host", "id AS place", "'торг сервис' AS query")
    begun = time.monotonic()
    got = companies.name_candidates(queries, registry).collect()
    assert time.monotonic() - begun < 45
    assert sorted(tuple(r) for r in got) == sorted((f"h{h}", f"{2 * n:010d}", n + 1) for h in range(5) for n in range(6))


def test_registration_numbers_and_backlog(spark):
    check = lambda n: f"{n}{n % 11 % 10}"
    a, b = check(102770000001), check(102770000002)
    registry = spark.createDataFrame([(number(1), a, "A", "https://a.ru", ["x@mail.ru", "Info@A.ru"]), ("7700000000", b, "B", "", ["i@b.ru"]), (number(3), check(102770000003), "C", "", ["x@mail.ru"])], REGISTRY)
    found = spark.createDataFrame([("a.ru", 1, "ogrn", "1027700000000", 100), ("a.ru", 2, "ogrn", f"{a[:5]} {a[5:]}", 50), ("b.ru", 1, "ogrn", b, 100), ("c.ru", 1, "ogrn", None, None)], "host string, place int, kind string, value string, score int")
    assert [tuple(r) for r in companies.resolve_by_registration(found, registry).collect()] == [("a.ru", number(1), "A", "ogrn", "organization", a)]
    known = spark.createDataFrame([("a.ru", number(1)), ("b.ru", "7700000000"), ("c.ru", number(3)), ("d.ru", None)], "host string, inn string")
    assert [tuple(r) for r in companies.confirmed_backlog(known, registry).collect()] == [("a.ru", number(1), "A", "site", "Info@A.ru")]
