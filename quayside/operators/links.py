"""Links worth following: contact pages ranked, documents with a company's details, detail pages of a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.functions import links, mail
from quayside.functions.urls import host_of, root_domain

# Fixed values from here on.
SKIPPED = ["mailto:", "tel:", "javascript:", "#"]
CONTACT_WORDS = ["contact", "kontakt", "контакт"]
REQUISITE_PATH, REQUISITE_WORD = "rekvizit", "реквизит"
DOCUMENT_LABELS = ["реквизит", "карточка компании", "карточка предприятия", "скачать реквизиты", "company card", "requisite"]
# End of fixed values.


def any_in(text: Column, words: list[str]) -> Column:
    return F.lit(False) if not words else F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def page_links(pages: DataFrame) -> DataFrame:
    """The columns of pages but html, with at (the place on the page), tag, href, label, link (absolute, without fragment) for each anchor."""
    rest = [c for c in pages.columns if c != "html"]
    rows = pages.select(*rest, F.posexplode(links.anchors(F.col("url"), F.coalesce("html", F.lit("")))).alias("at", "a"))
    return rows.select(*rest, "at", "a.*")


def web(link: Column) -> Column:
    return link.rlike(r"^https?://[^/?#]")


def path_of(link: Column) -> Column:
    return F.lower(links.parts(link)["path"])


def contact_links(pages: DataFrame, key: str = "page_id", most: int = 12, hints: list[str] | None = None) -> DataFrame:
    """key, rank, link, weight: links of a page's own host that look like contact pages, the most useful first.

    hints (names of offers and policies, say) weigh 4, contact words 3, requisites 2, other contact pages 1; of equal ones
    the shorter link comes first, then the one that stands first. `most` is how many a crawler would follow.
    """
    hints = [h.lower() for h in hints or []]
    rows = page_links(pages).where(web(F.col("link")) & ~F.exists(F.array(*map(F.lit, SKIPPED)), lambda p: F.startswith(F.lower("href"), p)))
    rows = rows.where(host_of(F.col("link")) == host_of(F.col("url")))
    text, low = F.lower(F.substring("label", 1, 80)), F.lower("link")
    path = path_of(F.col("link"))
    hinted = any_in(low, hints) | any_in(text, hints)
    rows = rows.where(hinted | F.coalesce(mail.is_contact_page(F.col("link"), F.substring("label", 1, 80)), F.lit(False)))
    named = any_in(path, CONTACT_WORDS) | any_in(text, CONTACT_WORDS)
    weight = F.when(any_in(path, hints) | any_in(text, hints), 4).when(F.contains(path, F.lit(REQUISITE_PATH)) | F.contains(text, F.lit(REQUISITE_WORD)), 2).when(named, 3).otherwise(1)
    once = rows.groupBy(key, "link").agg(F.min_by(F.struct("at", weight.alias("weight")), "at").alias("x"))
    order = W.partitionBy(key).orderBy(F.col("x.weight").desc(), F.length("link"), "x.at")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select(key, "rank", "link", F.col("x.weight").alias("weight"))


def document_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, at, link of PDF files of the same registrable domain that are labelled as a company's details."""
    rows = page_links(pages).where(web(F.col("link")))
    rows = rows.where(root_domain(host_of(F.col("link"))) == root_domain(host_of(F.col("url"))))
    title = links.unescaped(F.regexp_replace(F.regexp_extract("tag", r"""(?is)\stitle\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1), "^[\"']|[\"']$", ""))
    said = F.lower(F.concat_ws(" ", "label", title, links.parts(F.col("link"))["path"]))
    rows = rows.where(F.endswith(path_of(F.col("link")), F.lit(".pdf")) & any_in(said, DOCUMENT_LABELS))
    return rows.groupBy(key, "link").agg(F.min("at").alias("at")).select(key, "at", "link")


def detail_links(pages: DataFrame, markers: list[str], words: list[str], buyer: list[str], seller: list[str], key: str = "page_id", most: int = 3) -> DataFrame:
    """key, rank, link: the first links of the same registrable domain whose path has a marker and that speak of the product.

    A link that a buyer's word is about, and no seller's, is left out. `most` is how many details a listing is asked for.
    """
    rows = page_links(pages).where(web(F.col("link")))
    rows = rows.where(root_domain(host_of(F.col("link"))) == root_domain(host_of(F.col("url"))))
    path = path_of(F.col("link"))
    text = F.concat(path, F.lit(" "), F.lower("label"))
    fits = any_in(path, markers) & any_in(text, words) & ~(any_in(text, buyer) & ~any_in(text, seller))
    once = rows.where(fits).groupBy(key, "link").agg(F.min("at").alias("at"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("at"))).where(F.col("rank") <= most)
    return ranked.select(key, "rank", "link")
