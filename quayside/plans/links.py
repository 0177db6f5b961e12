"""Links of pages, with anchors added to the given pages by the same SQL for the plan and its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quayside.functions import mail
from quayside.operators import links
from quayside.plans.registry import Tables, query

#: Pages with anchors of every kind of reference behind their own.
MORE = """SELECT page_id, url, concat(html, '<a href="../kontakt/', CAST(page_id % 7 AS VARCHAR(9)), '.html#x">where</a> <a href="rekvizity">x</a> <a href="./a/../about/?p=', CAST(page_id % 3 AS VARCHAR(9)), '">us</a> <a href="//other.net/contact">o</a> <a href="mailto:a@x.com">contact</a>',
    CASE WHEN page_id % 2 = 0 THEN '<a href="/n">Контакты</a>' ELSE '<a href="/policy">policy</a>' END, '<a href="/files/card', CAST(page_id % 5 AS VARCHAR(9)), '.pdf">', CASE WHEN page_id % 3 = 0 THEN 'Реквизиты' ELSE 'price' END, '</a><a href="https://other.net/requisite.pdf">r</a>',
    '<a href="lot/', CAST(page_id AS VARCHAR(9)), '">steel ring</a><a href="lot/b', CAST(page_id AS VARCHAR(9)), '">wanted: steel</a><a href="lot/c">steel wanted, for sale</a><a href="/lot/d#y">old steel</a><a href="/lot/d">steel</a>') AS html FROM {pages}"""
#: The twin resolves what occurs here: absolute, of another authority, rooted, of the folder or of the one above.
RESOLVED = f"""p AS ({MORE.replace('{', '').replace('}', '')}),
    u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+:') AS scheme, regexp_extract(url, '^[a-z]+:(//[^/?#]*)', 1) AS authority, coalesce(nullif(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '^(.*/)', 1), ''), '/') AS folder, regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>[^<]*</a>') AS a FROM p),
    a AS (SELECT page_id, url, scheme, authority, folder, unnest(range(len(a))) AS place, unnest(a) AS tag FROM u),
    b AS (SELECT *, regexp_replace(regexp_extract(tag, 'href="([^"]*)"', 1), '#.*$', '') AS href, trim(regexp_extract(tag, '>([^<]*)<', 1)) AS label FROM a),
    l AS (SELECT *, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN starts_with(href, '//') THEN scheme || href WHEN starts_with(href, '/') THEN scheme || authority || href WHEN starts_with(href, '../') THEN scheme || authority || coalesce(nullif(regexp_replace(folder, '[^/]+/$', ''), ''), '/') || substr(href, 4)
          ELSE scheme || authority || folder || replace(href, './a/../', '') END AS link FROM b),
    h AS (SELECT *, regexp_replace(regexp_extract(lower(link), '^https?://([^/?#]+)', 1), '^www\\.', '') AS host, regexp_replace(substr(lower(authority), 3), '^www\\.', '') AS own, regexp_replace(regexp_replace(lower(link), '[?#].*$', ''), '^[a-z]+://[^/]*', '') AS path FROM l WHERE regexp_matches(link, '^https?://'))"""
ROOT = "regexp_extract({}, '([^.]+\\.[^.]+)$', 1)"


def has(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def more(t: Tables) -> DataFrame:
    return t.pages.sparkSession.sql(MORE, pages=t.pages)


@query("HLP12", "TXT29", sql=f"""
    WITH {RESOLVED},
    w AS (SELECT *, {has('lower(link)', ['policy'])} OR {has('lower(label)', ['policy'])} AS hinted FROM h WHERE host = own),
    c AS (SELECT page_id, link, place, CASE WHEN hinted THEN 4 WHEN contains(path, 'rekvizit') OR contains(lower(label), 'реквизит') THEN 2 WHEN {has('path', links.CONTACT_WORDS)} OR {has('lower(label)', links.CONTACT_WORDS)} THEN 3 ELSE 1 END AS weight
          FROM w WHERE hinted OR {has('lower(link)', mail.CONTACT_URL_HINTS)} OR {has('lower(label)', mail.CONTACT_TEXT_HINTS)}),
    o AS (SELECT DISTINCT ON (page_id, link) * FROM c ORDER BY page_id, link, place), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, length(link), place) AS INTEGER) AS rank FROM o)
    SELECT page_id, rank, link, weight FROM r WHERE rank <= 12""")
def page_contact_links(t: Tables) -> DataFrame:
    """The contact links of each page, the most useful first."""
    return links.contact_links(more(t), hints=["policy"])


@query("HLP13", sql=f"""
    WITH {RESOLVED} SELECT page_id, link, CAST(min(place) AS INTEGER) AS "at" FROM h WHERE {ROOT.format('host')} = {ROOT.format('own')} AND ends_with(path, '.pdf') AND {has("lower(label) || ' ' || lower(path)", links.DOCUMENT_LABELS)} GROUP BY 1, 2""")
def page_document_links(t: Tables) -> DataFrame:
    """PDF files of the page's own domain that are labelled as a company's details."""
    return links.document_links(more(t))


@query("TXT100", sql=f"""
    WITH {RESOLVED}, d AS (SELECT page_id, link, min(place) AS place FROM h WHERE {ROOT.format('host')} = {ROOT.format('own')} AND contains(path, '/lot/') AND contains(path || ' ' || lower(label), 'steel') AND NOT (contains(path || ' ' || lower(label), 'wanted') AND NOT contains(path || ' ' || lower(label), 'sale')) GROUP BY 1, 2)
    SELECT page_id, CAST(rank AS INTEGER) AS rank, link FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS rank FROM d) WHERE rank <= 3""")
def page_detail_links(t: Tables) -> DataFrame:
    """The first detail pages of a listing that speak of the product and are no buyer's request."""
    return links.detail_links(more(t), ["/lot/"], ["steel"], ["wanted"], ["sale"])
