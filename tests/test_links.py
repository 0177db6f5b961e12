"""References resolved as RFC 3986 does, and links chosen from pages."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from quayside.functions import links
from quayside.operators import links as chosen

BASE = "http://a/b/c/d;p?q"
#: The examples of RFC 3986, 5.4, without fragments.
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q", "g#s": "http://a/b/c/g", "g?y#s": "http://a/b/c/g?y",
    ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/",
    "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g#s/../x": "http://a/b/c/g",
}


def run(spark, pairs):
    rows = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "i int, b string, r string")
    return [x[0] for x in rows.orderBy("i").select(links.resolved(F.col("b"), F.col("r"))).collect()]


def test_examples_of_the_standard(spark):
    assert dict(zip(EXAMPLES, run(spark, [(BASE, r) for r in EXAMPLES]))) == EXAMPLES


def test_against_the_standard_library(spark):
    rng = random.Random(6)
    some = lambda *x: rng.choice(x)
    bases = ["http://x.ru", "https://x.ru/", "http://x.ru/a/b/", "http://u@x.ru:8080/a/b.html?q=1"]
    words = ["a", "b.html", "..", ".", "c", "d?e=/../f", "контакты"]
    pairs = [(some(*bases), some("", "/", "./", "../") + "/".join(rng.choices(words, k=rng.randrange(1, 5)))) for _ in range(300)]
    for (b, r), got in zip(pairs, run(spark, pairs)):
        assert got == urljoin(b, r), (b, r)


PAGE = """<base href="/shop/"><a href="mailto:a@x.ru">contact</a> <a class=x href='contact?b=1&amp;c=2#top'><b>Our</b>&nbsp; office</a><A HREF=../about>About us</A>
<a href="https://www.x.ru/rekvizity">x</a><a href="https://y.ru/contact">other host</a><a href="/news">Контакты</a><a href="contact?b=1&c=2">again</a><a name=q>no link</a>
<a href="/docs/card.pdf" title="Реквизиты">card</a><a href="/docs/price.pdf">price</a><a href="https://cdn.x.ru/company%20card.PDF">Company card</a><a href="https://z.ru/r.pdf">реквизиты</a>
<a href="/offer">Оферта</a><a href="/tender/1">куплю кирпич</a><a href="/tender/2">кирпич, продажа</a><a href="/tender/3">кирпич</a><a href="/tender/3#x">кирпич</a><a href="/tender/4">кирпич</a><a href="/tender/5">кирпич</a>"""


def test_contact_links_are_ranked(spark):
    pages = spark.createDataFrame([(1, "http://x.ru/index.html", PAGE), (2, "http://e.ru/", None), (3, "http://e.ru/", "<p>no links")], "page_id int, url string, html string")
    got = [(r.rank, r.link, r.weight) for r in chosen.contact_links(pages).orderBy("rank").collect()]
    assert got[:3] == [(1, "http://x.ru/news", 3), (2, "http://x.ru/shop/contact?b=1&c=2", 3), (3, "https://www.x.ru/rekvizity", 2)]
    assert ("http://x.ru/about", 1) in [g[1:] for g in got]
    hinted = [(r.link, r.weight) for r in chosen.contact_links(pages, most=1, hints=["оферта"]).collect()]
    assert hinted == [("http://x.ru/offer", 4)]


def test_documents_and_details(spark):
    pages = spark.createDataFrame([(1, "http://x.ru/index.html", PAGE)], "page_id int, url string, html string")
    docs = [r.link for r in chosen.document_links(pages).orderBy("at").collect()]
    assert docs == ["http://x.ru/docs/card.pdf", "https://cdn.x.ru/company%20card.PDF"]
    details = [r.link for r in chosen.detail_links(pages, ["/tender/"], ["кирпич"], ["куплю"], ["продажа"]).orderBy("rank").collect()]
    assert details == ["http://x.ru/tender/2", "http://x.ru/tender/3", "http://x.ru/tender/4"]
