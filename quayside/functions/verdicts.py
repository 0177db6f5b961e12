"""Verdicts on contacts and page texts: what was checked of an address or number, name hints, why an address is missing, CSS."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quayside.functions import company, mail
from quayside.functions.messages import or_empty, visible_text
from quayside.functions.urls import host_of, root_domain

# Fixed values from here on.
SYNTAX = "синтаксис"
MX_FOUND, MX_MISSING, MX_UNCHECKED = "MX-запись", "MX-записи нет", "MX не проверялся"
OWN_DOMAIN, FREE_MAIL, FOREIGN_DOMAIN = "домен совпадает с сайтом", "бесплатная почта — принадлежность не доказана", "домен чужой"
SECOND_SOURCE = "подтверждён вторым источником"
ON_PAGES, REPEATED = "встречается на %d страницах", "повторяется на %d страницах"
SERVER_YES, SERVER_NO = "почтовый сервер принял адрес", "почтовый сервер адрес отверг"
TECHNICAL, MISMATCH = "технический адрес — письмо не дойдёт", "ссылка и видимый адрес расходятся"
CHECKSUM_YES, CHECKSUM_NO = "контрольная сумма", "контрольная сумма не сошлась"
IN_REGISTRY, NOT_IN_REGISTRY, REGISTRY_UNCHECKED = "есть в реестре (%s)", "в реестре не найден", "реестр не проверялся"
BY_DOMAIN, BY_NAME = "контакты из реестра — на домене сайта", "название из реестра похоже на сайт"
UNKNOWN_OWNER = "в реестре нет сайта, принадлежность не доказана"
OTHER_DOMAIN = "контакты «%s» ведут на другой домен — ИНН может принадлежать не владельцу %s"
MISSING = {
    "form": "на сайте только форма обратной связи",
    "image": "адрес, вероятно, нарисован картинкой",
    "js": "контакты подгружаются скриптом — нужен рендеринг",
    "pdf": "контакты, вероятно, в PDF с реквизитами",
    "no_contacts_page": "страница контактов не найдена",
}
IMAGE = r"<img[^>]+(?:mail|pochta|kontakt)[^>]*>"
FORM_WORDS, PDF_WORDS = "обратн|напишите|заявк|feedback|вопрос", "реквизит|карточка предприятия"
FEW_WORDS = 60
LEGAL_NAME = r"(?iU)\b(ООО|ОАО|ЗАО|ПАО|АО|ИП)\b[\s:]*[«\"']?([А-ЯЁA-Z][^«»\"'<>\n]{2,48})"
SITE_NAME = r"(?i)<meta[^>]+property=[\"']og:site_name[\"'][^>]+content=[\"']([^\"']{3,60})"
PAGE_TITLE = r"(?i)<title[^>]*>([^<]{3,200})</title>"
MOST_HINTS = 4
CSS_SIGNAL = r"(?i)[{}]|\b(?:text-decoration|font-size|background-color)\s*:"
CSS_PROPERTY = r"(?im)^\s*(?:text-decoration|color|font(?:-[\w-]+)?|margin(?:-[\w-]+)?|padding(?:-[\w-]+)?|background(?:-[\w-]+)?|display|white-space|border(?:-[\w-]+)?|line-height)\s*:\s*[^;{}\n]+;?\s*$"
# End of fixed values.


def address_verdict(address: Column, site: Column, mx: Column, second_source: Column, pages: Column, accepted: Column, technical: Column, mismatch: Column) -> Column:
    """struct(passed, failed, sources, verified) of an address; mx and accepted are null where nobody asked.

    Verified: a mail server is there and has not refused, nothing speaks against the address, and the site's own
    domain or a second source speaks for it.
    """
    domain = F.lower(mail.domain_part(address))
    own = root_domain(domain) == root_domain(site)
    free = domain.isin(mail.FREE_MAIL_DOMAINS) | root_domain(domain).isin(mail.FREE_MAIL_DOMAINS)
    second, several = F.coalesce(second_source, F.lit(False)), F.coalesce(pages, F.lit(0)) > 1
    bad = F.coalesce(technical, F.lit(False)) | F.coalesce(mismatch, F.lit(False))
    passed = F.array(
        F.lit(SYNTAX), F.when(mx, MX_FOUND), F.when(own, OWN_DOMAIN), F.when(second, SECOND_SOURCE), F.when(several, F.format_string(ON_PAGES, pages)), F.when(accepted, SERVER_YES)
    )
    failed = F.array(
        F.when(mx.isNull(), MX_UNCHECKED).when(~mx, MX_MISSING), F.when(~own, F.when(free, FREE_MAIL).otherwise(FOREIGN_DOMAIN)), F.when(~accepted, SERVER_NO), F.when(technical, TECHNICAL), F.when(mismatch, MISMATCH)
    )
    verified = F.coalesce(mx, F.lit(False)) & ~bad & F.coalesce(accepted, F.lit(True)) & (own | second)
    return F.struct(F.array_compact(passed).alias("passed"), F.array_compact(failed).alias("failed"), F.when(second, 2).otherwise(1).alias("sources"), verified.alias("verified"))


def mail_domains(emails: Column) -> Column:
    known = F.filter(F.coalesce(emails, F.array().cast("array<string>")), lambda e: F.contains(e, F.lit("@")))
    return F.transform(known, lambda e: root_domain(F.lower(F.trim(F.substring_index(e, "@", -1)))))


def owned_by_domain(site: Column, registry_site: Column, registry_emails: Column) -> Column:
    """Whether a registry's site or one of its addresses is on the site's domain."""
    root = root_domain(site)
    return (root_domain(host_of(registry_site)) == root) | F.coalesce(F.array_contains(mail_domains(registry_emails), root), F.lit(False))


def ownership_unknown(registry_site: Column, registry_emails: Column) -> Column:
    """Whether the registry has nothing to compare: no site, and no address but at free mail services."""
    return (or_empty(registry_site) == "") & ~F.exists(mail_domains(registry_emails), lambda d: ~d.isin(mail.FREE_MAIL_DOMAINS))


def number_verdict(checksum: Column, registry: Column, name: Column, method: Column, site: Column, title: Column, pages: Column, registry_site: Column, registry_emails: Column) -> Column:
    """struct(passed, failed, sources, verified) of a company number; registry is null where nobody asked.

    A wrong checksum ends the checks. Domains prove ownership, a likeness of names counts less but counts; a number
    from a model needs either, others need the registry only.
    """
    right = F.coalesce(checksum, F.lit(False))
    named = or_empty(name) != ""
    owned = owned_by_domain(site, registry_site, registry_emails)
    alike = named & (((or_empty(title) != "") & F.coalesce(company.names_match(name, title), F.lit(False))) | F.coalesce(company.domain_hints_name(name, site), F.lit(False)))
    several = F.coalesce(pages, F.lit(0)) > 1
    passed = F.array(
        F.lit(CHECKSUM_YES), F.when(registry, F.format_string(IN_REGISTRY, or_empty(name))), F.when(owned, BY_DOMAIN).when(alike, BY_NAME), F.when(several, F.format_string(REPEATED, pages))
    )
    failed = F.array(
        F.when(registry.isNull(), REGISTRY_UNCHECKED).when(~registry, NOT_IN_REGISTRY),
        F.when(~owned & ~alike, F.when(ownership_unknown(registry_site, registry_emails), UNKNOWN_OWNER).otherwise(F.format_string(OTHER_DOMAIN, or_empty(name), site))),
    )
    none = F.array().cast("array<string>")
    verified = right & F.coalesce(registry, F.lit(False)) & (owned | alike | (or_empty(method) != "llm"))
    return F.struct(
        F.when(right, F.array_compact(passed)).otherwise(none).alias("passed"),
        F.when(right, F.array_compact(failed)).otherwise(F.array(F.lit(CHECKSUM_NO))).alias("failed"),
        F.when(right & several, 2).otherwise(1).alias("sources"),
        verified.alias("verified"),
    )


def name_hints(html: Column) -> Column:
    """Names a page may give its company, at most four: legal names, then the site's name, then the end of the title."""
    page = or_empty(html)
    form, body = (F.regexp_extract_all(page, F.lit(LEGAL_NAME), F.lit(i)) for i in (1, 2))
    whole = F.zip_with(form, body, lambda f, b: F.trim(F.regexp_replace(F.concat(f, F.lit(" "), b), r"(?U)\s+", " ")))
    legal = F.transform(whole, lambda x: F.trim(F.regexp_replace(x, r"(?:[,;(]| - ).*$", "")))
    site = F.transform(F.regexp_extract_all(page, F.lit(SITE_NAME), F.lit(1)), F.trim)
    tail = F.transform(F.regexp_extract_all(page, F.lit(PAGE_TITLE), F.lit(1)), lambda x: F.regexp_replace(F.regexp_extract(x, "[^|—–]*$", 0), r"(?U)^\s+|\s+$", ""))
    hints = F.concat(F.filter(legal, lambda x: F.length(x).between(6, 60)), site, F.filter(tail, lambda x: F.length(x).between(4, 40)))
    low = F.transform(hints, F.lower)
    first = F.filter(hints, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return F.slice(first, 1, MOST_HINTS)


def missing_reason(html: Column) -> Column:
    """Why a page gave no address, by the first that fits: an image, only a form, a PDF, a script's page, no contact page."""
    page = F.lower(or_empty(html))
    words = F.size(F.filter(F.split(F.regexp_replace(page, "<[^>]+>", ""), r"(?U)\s+"), lambda w: w != ""))
    kind = (
        F.when(page == "", "no_contacts_page")
        .when(page.rlike(IMAGE), "image")
        .when(page.rlike("<form[^>]*>") & page.rlike(FORM_WORDS), "form")
        .when(F.contains(page, F.lit(".pdf")) & page.rlike(PDF_WORDS), "pdf")
        .when(words < FEW_WORDS, "js")
        .otherwise("no_contacts_page")
    )
    return F.element_at(F.create_map(*[F.lit(x) for pair in MISSING.items() for x in pair]), kind)


BRACE = re.compile("[{}]")
RULE_START = re.compile(r"(?:^|(?<=[\s;]))(?:[.#:*]?[A-Za-z]|\*|@[\w-]*\w|\[[^\]]+\])")


def cut_blocks(text: str) -> str:
    """Style rules taken out with all that is nested in them, each leaving a line feed.

    A rule begins at the first thing like a selector since the rule before. The cutting ends at a block without a
    selector or without an end; what is left stays.
    """
    text = re.sub(r"/\*.*?\*/", " ", text, flags=re.DOTALL)
    kept, done, opening, depth = [], 0, -1, 0
    for brace in BRACE.finditer(text):
        if brace.group() == "{":
            opening = brace.start() if depth == 0 else opening
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                before = text[done:opening]
                rule = RULE_START.search(before)
                if rule is None:
                    break
                kept.append(before[: rule.start()])
                done = brace.end()
    return "\n".join([*kept, text[done:]])


@F.pandas_udf(StringType())
def without_blocks(texts: pd.Series) -> pd.Series:
    return texts.map(cut_blocks, na_action="ignore")


def even_lines(text: Column) -> Column:
    """Blanks compacted, lines trimmed, one empty line at most between others."""
    out = F.regexp_replace(F.replace(or_empty(text), F.lit("\r\n"), F.lit("\n")), r"[ \t]+", " ")
    out = F.regexp_replace(out, r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def looks_like_css(text: Column) -> Column:
    return text.rlike(CSS_SIGNAL) & text.rlike(r"(?:^|\n)\s*[.#][\w-]+")


def without_css(text: Column, html: Column) -> Column:
    """A mail's text without style sheets that were taken for text; the HTML part's text where nothing else helps.

    Null is empty. Only texts with a sign of CSS are sent to Python, which balances the braces.
    """
    plain = even_lines(text)
    signal = plain.rlike(CSS_SIGNAL)
    cut = F.regexp_replace(without_blocks(F.when(signal, plain)), r"(?:^|\n)\s*[.#][\w-][^{}]*\{[^{}]*\}\s*", "\n")
    out = F.coalesce(F.regexp_replace(cut, CSS_PROPERTY, ""), plain)
    other = visible_text(html)
    instead = (plain != "") & (looks_like_css(plain) | looks_like_css(out)) & (other != "") & ~looks_like_css(other)
    return even_lines(F.when(instead, other).otherwise(out))
