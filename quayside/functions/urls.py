"""Hosts, registrable domains and keys of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public suffixes of two labels.
COMPOUND_SUFFIXES = ["com.ru", "org.ru", "net.ru", "pp.ru", "msk.ru", "spb.ru", "nov.ru", "co.uk", "org.uk", "com.ua", "com.by", "com.kz", "com.tr", "com.cn", "co.jp", "com.au", "com.br", "co.in", "co.kr"]


def host_of(url: Column) -> Column:
    """Lower-case host without credentials, port and a leading www; a URL without a scheme counts too."""
    text = F.trim(F.coalesce(url, F.lit("")))
    whole = F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("http://"), text))
    host = F.lower(F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def root_domain(host: Column) -> Column:
    """The registrable domain: two labels, or three below a compound suffix."""
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) <= 2, host).when(last(2).isin(COMPOUND_SUFFIXES), last(3)).otherwise(last(2))


def url_key(url: Column) -> Column:
    """A URL without its fragment and trailing slashes."""
    return F.rtrim(F.regexp_replace(url, "#.*$", ""), F.lit("/"))
