"""Search text: normalisation, tokens, product matching, roles, contacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values from here on.
BUYER_MARKERS = ["купим", "ищу поставщика", "ищем поставщика", "требуется", "заявка на закупку", "заказчик", "нужен поставщик", "запрос цены"]
STRONG_BUYER = ["купим", "требуется", "заявка на закупку", "ищу поставщика", "ищем поставщика", "нужен поставщик"]
SELLER_MARKERS = ["купить", "продажа", "поставщик", "производитель", "в наличии", "цена", "опт", "доставка", "каталог", "наша компания"]
TECHNICAL = "ввг|аввг|пвс|сип|нг|fr|ls|гост|мкэ|кв"
PLATFORM_DOMAINS = ["flagma.ru", "supl.biz", "all.biz", "productcenter.ru", "promportal.su", "postavshiki.com", "postavshikov.net"]
PHONE = r"(?<![0-9])(?:\+7|8)\s*[\-(]?\s*[0-9]{3}\s*[)\-]?\s*[0-9]{3}\s*[\-\s]?[0-9]{2}\s*[\-\s]?[0-9]{2}(?![0-9])"
# End of fixed values.


def normal_text(text: Column) -> Column:
    """One spelling: е for ё, single blanks, x between digits, a decimal point, cable brands as one word."""
    out = F.translate(F.coalesce(text, F.lit("")), "ёЁ", "еЕ")
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    out = F.regexp_replace(out, r"(?iu)(?<![\p{L}\p{N}_])ввг\s*нг(?![\p{L}\p{N}_])", "ВВГнг")
    out = F.regexp_replace(out, r"(?iu)(?<![\p{L}\p{N}_])ввг\s*нг\s*\(?а\)?\s*-?\s*ls(?![\p{L}\p{N}_])", "ВВГнг(А)-LS")
    out = F.regexp_replace(out, r"(?iu)(?<=[0-9])[хx](?=[0-9])", "x")
    return F.regexp_replace(out, r"(?<=[0-9]),(?=[0-9])", ".")


def number_of(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(","), F.lit(".")), F.lit(" "), F.lit("")).try_cast("double")


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of two characters or more."""
    found = F.regexp_extract_all(F.lower(normal_text(text)), F.lit(r"[a-zа-я0-9][a-zа-я0-9().,/_+-]*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) > 1))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normal_text(text), F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0)))


def product_match(product: Column, offered: Column) -> Column:
    """struct(match, score): how well an offer's text answers a product's text."""
    target, seen = tokens(product), tokens(offered)
    overlap = F.size(F.array_intersect(target, seen)) / F.size(target)
    wanted = numbers(product)
    fit = (F.size(wanted) > 0) & (F.size(F.array_except(wanted, numbers(offered))) == 0)
    technical = F.filter(target, lambda x: x.rlike(f"{TECHNICAL}|[0-9]"))
    missing = F.exists(technical, lambda x: ~F.exists(seen, lambda y: F.contains(y, x) | F.contains(x, y)))
    exact = (overlap >= 0.8) & ((F.size(wanted) == 0) | fit)
    rounded = F.bround(overlap, 3)
    strong = F.least(F.lit(1.0), 0.72 + overlap * 0.18 + F.when(fit, 0.1).otherwise(0.0))
    kind = F.when(F.size(target) == 0, "unknown").when(missing, "near_match").when(exact, "exact_match").when(overlap >= 0.55, "acceptable_analog").when(overlap >= 0.25, "near_match").otherwise("unrelated")
    score = F.when(F.size(target) == 0, 0.0).when(~missing & exact, strong).otherwise(rounded)
    return F.struct(kind.alias("match"), score.alias("score"))


def role_of(text: Column) -> Column:
    """buyer_request, seller_offer or unknown, by markers; a strong buyer's word near the start decides."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    start = F.substring(low, 1, 900)
    strong = F.exists(F.array(*map(F.lit, STRONG_BUYER)), lambda w: F.contains(start, w))
    buyer, seller = hits(BUYER_MARKERS), hits(SELLER_MARKERS)
    weak = (buyer > 0) & (buyer >= F.greatest(F.lit(1), F.floor(seller / 2)))
    return F.when(strong | weak, "buyer_request").when(seller > 0, "seller_offer").otherwise("unknown")


def qualification(role: Column, match: Column, contacts: Column) -> Column:
    """struct(status, reasons) of an offer."""
    good = role.isin("seller_offer", "manufacturer") & match.isin("exact_match", "acceptable_analog") & (contacts > 0)
    reasons = F.array_compact(F.array(F.when(role == "buyer_request", "buyer_request"), F.when(contacts == 0, "no_public_seller_contact"), F.when(match.isin("unrelated", "near_match"), "match_below_acceptable_threshold")))
    return F.struct(F.when(good, "qualified").otherwise("unqualified").alias("status"), reasons.alias("reasons"))


def phone(value: Column) -> Column:
    """+ and digits, an 8 before ten digits read as 7; the text itself if it has no digit."""
    d = F.regexp_replace(value, "[^0-9]", "")
    d = F.when(d.startswith("8") & (F.length(d) == 11), F.concat(F.lit("7"), F.substring(d, 2, 10))).otherwise(d)
    return F.when(d == "", F.trim(value)).otherwise(F.concat(F.lit("+"), d))


def phones(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), phone))


def has_region_phone(context: Column, region: Column, value: Column) -> Column:
    """Whether the region's name stands up to 120 characters before the number's last four digits."""
    tail = F.regexp_extract(F.regexp_replace(value, "[^0-9]", ""), "([0-9]{1,4})$", 1)
    spread = F.array_join(F.filter(F.split(tail, ""), lambda d: d != ""), r"\D*")
    name = F.lower(F.trim(F.coalesce(region, F.lit(""))))
    pattern = F.concat(F.lit(r"(?Us)\b\Q"), name, F.lit(r"\E\b.{0,120}"), spread)
    return F.when((name == "") | (tail == ""), False).otherwise(F.rlike(F.lower(context), pattern))


def label_before(text: Column, start: Column, window: int = 40) -> Column:
    """The characters before a place (counted from 0), lower case."""
    return F.lower(F.substr(text, F.greatest(F.lit(1), start - window + 1).cast("int"), F.least(F.lit(window), start).cast("int")))


def snippet(text: Column, value: Column, radius: int = 180) -> Column:
    """The text around a value's first place, blanks compacted; the start of the text if it is not there."""
    at = F.instr(F.lower(text), F.lower(value))
    start = F.greatest(F.lit(1), at - radius // 2)
    around = F.substr(text, start, at - start + F.length(value) + radius // 2)
    return F.when(at == 0, F.trim(F.substring(text, 1, radius))).otherwise(F.trim(F.regexp_replace(around, r"\s+", " ")))


def with_suffix(keyword: Column, suffix: Column) -> Column:
    """keyword and suffix, unless all the suffix's words are in the keyword already."""
    k, s = (F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")) for x in (keyword, suffix))
    words = F.transform(F.split(k, " "), lambda w: F.lower(F.btrim(w, F.lit(".,!?«»\"'"))))
    return F.when((s == "") | (F.size(F.array_except(F.split(F.lower(s), " "), words)) == 0), k).otherwise(F.concat(k, F.lit(" "), s))


def is_platform(value: Column, platform: str | None = None) -> Column:
    """Whether an address belongs to a marketplace and not to its seller."""
    return F.lower(F.substring_index(value, "@", -1)).isin([*PLATFORM_DOMAINS, *([platform] if platform else [])])


def contact_confidence(kind: Column, platform: Column, near_seller: Column) -> Column:
    mail = F.when(platform, 0.25).otherwise(0.9) + F.when(near_seller, 0.08).otherwise(0.0)
    call = F.when(platform, 0.2).otherwise(0.82) + F.when(near_seller, 0.1).otherwise(0.0)
    return F.bround(F.least(F.lit(1.0), F.when(kind == "email", mail).otherwise(call)), 4)
