"""Links of a page: references resolved against the page, anchors with their labels, native expressions throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path and query of a reference; those that are not there are empty.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?:(//)([^/?#]*))?([^?#]*)(?:(\?)([^#]*))?"
#: An anchor with its reference: quoted in one way or the other, or bare; group 1 is the whole start tag, 2 the reference, 3 what is inside.
ANCHOR = r"""(?is)(<a\b(?=[^>]*\shref)[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)[^>]*>)(.*?)</a\s*>"""
BASE = r"""(?is)<base\b[^>]*?\shref\s*=\s*["']?([^"'\s>]+)"""
ENTITIES = [("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed one time however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unescaped(text: Column) -> Column:
    for name, character in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def parts(reference: Column) -> Column:
    """struct(scheme, has_authority, authority, path, has_query, query)."""
    part = lambda i: F.regexp_extract(reference, PARTS, i)
    return F.struct(F.lower(part(1)).alias("scheme"), (part(2) != "").alias("has_authority"), part(3).alias("authority"), part(4).alias("path"), (part(5) != "").alias("has_query"), part(6).alias("query"))


def without_dots(path: Column) -> Column:
    """The path without . and .. segments; .. at the top goes nowhere."""

    def step(held: Column, s: Column) -> Column:
        shorter = F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(1)))
        return F.when(s == ".", held).when(s == "..", shorter).otherwise(F.concat(held, F.array(s)))

    def joined(segments: Column) -> Column:
        # the text before the first slash is no segment that .. can remove
        kept = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.slice(segments, 1, 1), step)
        directory = F.element_at(segments, -1).isin(".", "..") & (F.size(segments) > 1)
        return F.concat(F.array_join(kept, "/"), F.when(directory, "/").otherwise(""))

    return once(F.split(path, "/", -1), joined)


def resolved(base: Column, reference: Column) -> Column:
    """The reference as an absolute URL without its fragment, by the rules of RFC 3986, 5.2; base is absolute."""

    def joined(both: Column) -> Column:
        b, r = both["b"], both["r"]
        own = (r["scheme"] != "") | r["has_authority"]
        rooted = own | F.startswith(r["path"], F.lit("/"))
        empty = ~own & (r["path"] == "")
        folder = F.when(b["has_authority"] & (b["path"] == ""), F.lit("/")).otherwise(F.regexp_extract(b["path"], r"^(.*/)", 1))
        path = F.when(empty, b["path"]).otherwise(without_dots(F.when(rooted, r["path"]).otherwise(F.concat(folder, r["path"]))))
        scheme = F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"])
        whose = F.when(own, r).otherwise(b)
        authority = F.when(whose["has_authority"], F.concat(F.lit("//"), whose["authority"])).otherwise("")
        asked = F.when(empty & ~r["has_query"], b).otherwise(r)
        return F.concat(scheme, F.lit(":"), authority, path, F.when(asked["has_query"], F.concat(F.lit("?"), asked["query"])).otherwise(""))

    return once(F.struct(parts(base).alias("b"), parts(F.trim(reference)).alias("r")), joined)


def label(inside: Column) -> Column:
    """The text of an anchor: tags out, entities read, blanks compacted."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(inside, "(?s)<[^>]*>", " ")), r"(?U)\s+", " "))


def anchors(url: Column, html: Column) -> Column:
    """array of struct(tag, href, label, link) in the order of the page; link is absolute."""
    found = [F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(i)) for i in (1, 2, 3)]
    zipped = F.arrays_zip(*[c.alias(n) for c, n in zip(found, ("tag", "href", "inside"), strict=True)])
    bare = lambda x: unescaped(F.trim(F.regexp_replace(x, "^[\"']|[\"']$", "")))

    def read(page: Column) -> Column:
        plain = F.transform(page["anchors"], lambda a: F.struct(a["tag"].alias("tag"), bare(a["href"]).alias("href"), label(a["inside"]).alias("label")))
        return F.transform(plain, lambda a: F.struct(a["tag"].alias("tag"), a["href"].alias("href"), a["label"].alias("label"), resolved(page["base"], a["href"]).alias("link")))

    return once(F.struct(base_of(url, html).alias("base"), zipped.alias("anchors")), read)


def base_of(url: Column, html: Column) -> Column:
    """What the page's references are relative to: its base element, itself relative to the page, or the page."""
    named = F.regexp_extract(html, BASE, 1)
    return F.when(named != "", resolved(url, unescaped(named))).otherwise(url)
