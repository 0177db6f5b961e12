from types import SimpleNamespace
from urllib.parse import quote_plus

from quayside.functions.matching import BUYER_MARKERS, SELLER_MARKERS
from quayside.plans.models import search_urls


def test_whole_texts_of_every_row(spark):
    texts = ["steel pipe 20 mm", "été à Paris", "«Купим» трубу", "Купим, доставка", "a+b=c&d %20 %7E", "~*-_.!()'", "", None, "x\ny\t\"z\"/?#", "1" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    want = []
    for i, t in enumerate(x or "" for x in texts):
        has = lambda words: any(w in t.lower() for w in words)  # noqa: B023, E731
        want.append((i, "https://s.example/find?q=" + quote_plus(t), has(BUYER_MARKERS) and not has(SELLER_MARKERS)))
    got = sorted(tuple(r) for r in search_urls(SimpleNamespace(benchmark=rows)).collect())
    assert got == want and {x[2] for x in want} == {True, False}
