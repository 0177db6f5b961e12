"""Verdicts, hints and clean-up on vectors of hand-made cases."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from quayside.functions import verdicts as v
from quayside.plans.verdicts import labelled_truth


def test_address_verdicts(spark):
    rows = [  # address, mx, second, pages, accepted, technical, mismatch, passed, failed, verified
        ("i@site.ru", True, False, 1, None, False, False, [v.SYNTAX, v.MX_FOUND, v.OWN_DOMAIN], [], True),
        ("i@mail.site.ru", None, None, None, None, None, None, [v.SYNTAX, v.OWN_DOMAIN], [v.MX_UNCHECKED], False),
        ("i@mail.ru", True, False, 3, True, False, False, [v.SYNTAX, v.MX_FOUND, "встречается на 3 страницах", v.SERVER_YES], [v.FREE_MAIL], False),
        ("i@mail.ru", True, True, 1, None, False, False, [v.SYNTAX, v.MX_FOUND, v.SECOND_SOURCE], [v.FREE_MAIL], True),
        ("i@else.ru", False, True, 1, False, True, True, [v.SYNTAX, v.SECOND_SOURCE], [v.MX_MISSING, v.FOREIGN_DOMAIN, v.SERVER_NO, v.TECHNICAL, v.MISMATCH], False),
        ("i@site.ru", True, False, 1, False, False, False, [v.SYNTAX, v.MX_FOUND, v.OWN_DOMAIN], [v.SERVER_NO], False),
    ]
    names = "address mx second pages accepted technical mismatch".split()
    schema = "address string, mx boolean, second boolean, pages int, accepted boolean, technical boolean, mismatch boolean, n int"
    data = spark.createDataFrame([(*r[:7], i) for i, r in enumerate(rows)], schema)
    address, mx, second, pages, accepted, technical, mismatch = (F.col(x) for x in names)
    got = data.select("n", v.address_verdict(address, F.lit("site.ru"), mx, second, pages, accepted, technical, mismatch).alias("v")).orderBy("n").collect()
    assert [(r.v.passed, r.v.failed, r.v.verified) for r in got] == [r[7:] for r in rows]
    assert [r.v.sources for r in got] == [2 if r[2] else 1 for r in rows]


def test_ownership_and_numbers(spark):
    rows = [  # checksum, registry, name, method, title, registry_site, registry_emails, verified, last of failed
        (True, True, "ООО Ромашка", "llm", "", "http://www.site.ru/x", [], True, None),
        (True, True, "ООО Ромашка", "llm", "", "", ["a@mail.site.ru", None, "x"], True, None),
        (True, True, "ООО Ромашка", "llm", "Ромашка — опт", "", [], True, None),
        (True, True, "ООО Ромашка", "llm", "", "", ["a@mail.ru"], False, v.UNKNOWN_OWNER),
        (True, True, "ООО Ромашка", "labeled", None, "else.ru", None, True, v.OTHER_DOMAIN % ("ООО Ромашка", "site.ru")),
        (True, None, None, None, None, None, None, False, v.UNKNOWN_OWNER),
        (False, True, "ООО Ромашка", "labeled", "", "site.ru", [], False, v.CHECKSUM_NO),
        (None, True, "ООО Ромашка", "labeled", "", "site.ru", [], False, v.CHECKSUM_NO),
    ]
    schema = "checksum boolean, registry boolean, name string, method string, title string, rsite string, emails array<string>, n int"
    data = spark.createDataFrame([(*r[:7], i) for i, r in enumerate(rows)], schema)
    checksum, registry, name, method, title, rsite, emails = (F.col(x) for x in "checksum registry name method title rsite emails".split())
    got = data.select("n", v.number_verdict(checksum, registry, name, method, F.lit("site.ru"), title, F.lit(1), rsite, emails).alias("v")).orderBy("n").collect()
    assert [(r.v.verified, r.v.failed[-1] if r.v.failed else None) for r in got] == [r[7:] for r in rows]


def test_name_hints(spark):
    pages = {
        None: [],
        "": [],
        "<title>Кирпич | Мир кирпича</title><p>ООО «Ромашка плюс», Москва</p>": ["ООО Ромашка плюс", "Мир кирпича"],
        '<meta property="og:site_name" content="Кирпич.ру"><title>кирпич.ру</title>': ["Кирпич.ру"],
        "<p>ЗАО Рога и копыта (Тула)</p><p>ИП Иванов - склад</p>": ["ЗАО Рога и копыта", "ИП Иванов"],
        "<title>ab | x</title>ПООО Завод": [],
        "".join(f"<b>ООО Номер{i}</b>" for i in range(9)): [f"ООО Номер{i}" for i in range(4)],
    }
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(pages)], "n int, html string")
    got = [r.h for r in rows.select("n", v.name_hints(F.col("html")).alias("h")).orderBy("n").collect()]
    assert got == list(pages.values())


def test_missing_reasons(spark):
    long = " слово" * 70
    pages = [
        (None, "no_contacts_page"),
        ('<IMG src="/Mail.png">', "image"),
        ("<form></form> Напишите нам", "form"),
        ("<form></form>" + long, "no_contacts_page"),
        ('<a href="x.pdf">Реквизиты</a>' + long, "pdf"),
        ("<div id=app></div>", "js"),
        (long, "no_contacts_page"),
    ]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(pages)], "n int, html string")
    got = [r.h for r in rows.select("n", v.missing_reason(F.col("html")).alias("h")).orderBy("n").collect()]
    assert got == [v.MISSING[k] for _, k in pages]


def test_css_is_cut(spark):
    cases = [
        (None, None, ""),
        ("", "<p>x</p>", ""),
        ("Hello\n\n\n\n  world \t x\r\ny", None, "Hello\n\nworld x\ny"),
        (".a { color: red } .b{x:y}\nЗдравствуйте", None, "Здравствуйте"),
        ("@media x { .a { b: c } .d { e: f } }\nПривет", None, "Привет"),
        ("Привет\n/* note { */ p.x { y: z }\nдо встречи", None, "Привет\n\nдо встречи"),
        ("font-size: 12px;\nПривет", None, "Привет"),
        (".a { b: c }", "<style>p{}</style><p>Цена 5</p>", "Цена 5"),
        ("1 { не правило }", None, "1 { не правило }"),
        (".a { нет конца", None, ".a { нет конца"),
    ]
    rows = spark.createDataFrame([(i, t, h) for i, (t, h, _) in enumerate(cases)], "n int, body string, html string")
    got = [r.x for r in rows.select("n", v.without_css(F.col("body"), F.col("html")).alias("x")).orderBy("n").collect()]
    assert got == [x for _, _, x in cases]


def test_blocks_in_linear_time():
    text = "a { b { c } } " * 50_000 + "конец"
    assert v.cut_blocks(text).strip() == "конец"


def test_labelled_truth(spark):
    pages = [
        (1, "http://a.ru/2", "<p>ИНН 7707083893</p>"),
        (2, "http://a.ru/1", "<p>ИНН: 7707083894</p>"),
        (3, "http://www.a.ru/3", "<p>ИНН 500100732259</p>"),
        (4, "http://b.ru", "7707083893"),
        (5, None, None),
    ]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.host: (r.pages, r.number, r.source) for r in labelled_truth(SimpleNamespace(pages=rows)).collect()}
    assert got == {"a.ru": (3, "7707083893", "http://a.ru/2"), "b.ru": (1, None, ""), "": (1, None, "")}
