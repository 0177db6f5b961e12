"""Company numbers and names: checksums, confidence, name comparison, transliteration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.functions.urls import root_domain

# Fixed values from here on.
WEIGHTS_10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
WEIGHTS_11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
WEIGHTS_12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
ID_METHOD_SCORE = {"jsonld": 55, "labeled": 55, "llm": 30, "text": 20}
EVIDENCE_WEIGHT = {"ogrn": 120, "ogrnip": 120, "site": 100, "email": 100, "domain": 60, "none": 0}
LEGAL_FORMS = "ооо|оао|зао|пао|ао|ип|нко|тд|торговый дом|компания|группа|фирма|llc|ltd|inc|gmbh"
CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщыэюя"
LATIN = "abvgdeejziiklmnoprstufhccssyeua"
DIGRAPHS = [("sch", "s"), ("shh", "s"), ("ch", "c"), ("sh", "s"), ("zh", "j"), ("kh", "h"), ("ts", "c"), ("ph", "f"), ("ya", "a"), ("yu", "u"), ("ye", "e"), ("yo", "e"), ("j", "i"), ("y", "i")]
TO_CYRILLIC_DIGRAPHS = [("shch", "щ"), ("sch", "щ"), ("sh", "ш"), ("ch", "ч"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("yu", "ю"), ("ya", "я"), ("yo", "ё"), ("ph", "ф"), ("ck", "к"), ("ee", "и"), ("oo", "у"), ("x", "кс")]
TO_CYRILLIC_FROM, TO_CYRILLIC = "abcdefghijklmnopqrstuvwyz", "абкдефгхижклмнопкрстуввйз"
ACTIVITY = {"manufacturer": [*range(10, 12), *range(13, 34)], "wholesale": [46], "retail": [47], "contractor": [41, 42, 43]}
LABELLED_ID = r"(?iu)(?<![\p{L}\p{N}_])(?:ИНН|INN)(?![\p{L}\p{N}_])\s*(?:/\s*КПП\s*)?[:№\-—\s]*([0-9][0-9\s-]{8,14}[0-9])(?![0-9])"
LABELLED_REGISTRATION = r"(?iu)(?<![\p{L}\p{N}_])(?:ОГРНИП|ОГРН)(?![\p{L}\p{N}_])\s*[:№\-—\s]*([0-9][0-9\s\-]{11,17}[0-9])(?![0-9])"
# End of fixed values.


def digits_only(raw: Column) -> Column:
    """Blanks and dashes of any kind taken out."""
    return F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)[\s\-‐‑‒–—―]", "")


def weighted(number: Column, weights: tuple[int, ...]) -> Column:
    """Sum of digit times weight, modulo 11, modulo 10."""
    return sum((F.substring(number, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0)) % 11 % 10


def digit(number: Column, place: int) -> Column:
    return F.substring(number, place, 1).cast("int")


def valid_company_id(number: Column) -> Column:
    """10 digits with one check digit, or 12 with two."""
    ten = number.rlike("^[0-9]{10}$") & (weighted(number, WEIGHTS_10) == digit(number, 10))
    twelve = number.rlike("^[0-9]{12}$") & (weighted(number, WEIGHTS_11) == digit(number, 11)) & (weighted(number, WEIGHTS_12) == digit(number, 12))
    return F.coalesce(F.when(F.length(number) == 10, ten).when(F.length(number) == 12, twelve), F.lit(False))


def id_kind(number: Column) -> Column:
    return F.when(F.length(number) == 10, "organization").when(F.length(number) == 12, "individual").otherwise("")


def valid_registration(number: Column) -> Column:
    """13 digits: the first 12 modulo 11; 15 digits: the first 14 modulo 13; the last digit of that is the check."""
    value = digits_only(number)
    check = lambda n, m: F.substring(value, 1, n).try_cast("long") % m % 10 == F.substring(value, n + 1, 1).try_cast("int")
    return F.coalesce(F.when(value.rlike("^[0-9]{13}$"), check(12, 11)).when(value.rlike("^[0-9]{15}$"), check(14, 13)), F.lit(False))


def labelled_ids(text: Column) -> Column:
    """Numbers behind a tax-id label, blanks and dashes taken out, checksum right, each once."""
    found = F.regexp_extract_all(text, F.lit(LABELLED_ID), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, digits_only), valid_company_id))


def labelled_registrations(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(LABELLED_REGISTRATION), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, digits_only), valid_registration))


def id_confidence(method: Column, checksum: Column, registry: Column, on_requisites: Column) -> tuple[Column, Column]:
    """(score, high / medium / low); no high without the registry's yes, nothing without the checksum."""
    points = F.create_map(*[F.lit(x) for pair in ID_METHOD_SCORE.items() for x in pair])
    total = F.coalesce(F.try_element_at(points, method), F.lit(0)) + 20 + F.when(on_requisites, 10).otherwise(0) + F.when(registry, 25).when(~registry, -60).otherwise(0)
    score = F.when(checksum, F.greatest(F.lit(0), F.least(F.lit(100), total))).otherwise(0)
    sure = F.coalesce(registry, F.lit(False))
    return score, F.when((score >= 75) & sure, "high").when(score >= 45, "medium").otherwise("low")


def name_words(name: Column) -> Column:
    """Significant lower-case words of a company name, each once."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{LEGAL_FORMS})(?![\p{{L}}\p{{N}}_])|[«»\"'`()]", " ")
    return F.array_distinct(F.filter(F.split(bare, "[^а-яёa-z0-9]+"), lambda w: F.length(w) > 2))


def names_match(a: Column, b: Column) -> Column:
    return F.arrays_overlap(name_words(a), name_words(b))


def comparable(word: Column) -> Column:
    """A coarse transliteration in which a Russian name and its Latin spelling meet."""
    out = F.translate(F.lower(word), CYRILLIC + "ъь", LATIN)
    for pair, letter in DIGRAPHS:
        out = F.replace(out, F.lit(pair), F.lit(letter))
    return out


def to_cyrillic(word: Column) -> Column:
    """A guess at the Russian spelling of a Latin word; longer letter groups first."""
    out = F.lower(word)
    for pair, letter in TO_CYRILLIC_DIGRAPHS:
        out = F.replace(out, F.lit(pair), F.lit(letter))
    return F.translate(out, TO_CYRILLIC_FROM, TO_CYRILLIC)


def domain_hints_name(name: Column, host: Column) -> Column:
    """Whether the domain's own label says a word of the name, as it stands or transliterated."""
    label = F.replace(F.split_part(root_domain(host), F.lit("."), F.lit(1)), F.lit("-"), F.lit(""))
    near = F.exists(name_words(name), lambda w: F.contains(w, label) | F.contains(label, w) | (comparable(w) == comparable(label)))
    return F.when(F.length(label) < 4, False).otherwise(near)


def activity_role(code: Column) -> Column:
    """Role by the industry code's first two digits; empty without a code."""
    first = F.regexp_extract(code, r"^([0-9]{2})\.", 1).try_cast("int")
    out = F.lit("other")
    for role, codes in ACTIVITY.items():
        out = F.when(first.isin(codes), role).otherwise(out)
    return F.when(F.coalesce(code, F.lit("")) == "", "").otherwise(out)


def ownership(host: Column, registry_site: Column, registry_emails: Column, known_email: Column, free_mail: list[str]) -> Column:
    """site, email, domain or none: how a registry record proves that a host is the company's."""
    root = root_domain(host)
    site = root_domain(F.regexp_replace(F.lower(F.coalesce(registry_site, F.lit(""))), r"^(?:https?://)?(?:www\.)?|/.*$", ""))
    emails = F.transform(F.coalesce(registry_emails, F.array().cast("array<string>")), lambda e: F.lower(F.trim(e)))
    own = F.exists(emails, lambda e: (root_domain(F.substring_index(e, "@", -1)) == root) & ~F.substring_index(e, "@", -1).isin(free_mail))
    return F.when((site != "") & (site == root), "site").when(F.array_contains(emails, F.lower(F.trim(known_email))), "email").when(own, "domain").otherwise("none")


def evidence_weight(kind: Column) -> Column:
    """Weight of a proof of ownership; 60 or more is accepted."""
    table = F.create_map(*[F.lit(x) for pair in EVIDENCE_WEIGHT.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0))


def display_name(name: Column) -> Column:
    """Long legal forms abbreviated, quotes of one kind, blanks compacted."""
    out = F.coalesce(name, F.lit(""))
    for long, short in (("общество с ограниченной ответственностью", "ООО"), ("публичное акционерное общество", "ПАО"), ("закрытое акционерное общество", "ЗАО"), ("акционерное общество", "АО"), ("индивидуальный предприниматель", "ИП")):
        out = F.regexp_replace(out, f"(?iu){long}", short)
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[\"“”„]", ""), r"\s+", " "))


# Fixed values from here on.
UNLABELLED_ID = r"(?U)(?<![0-9])([0-9][0-9\s-]{8,14}[0-9])(?![0-9])"
OWN_LABELS = ["инн", "inn", "taxid", "tax_id", "vatin"]
OTHER_LABELS = ["кпп", "огрн", "огрнип", "окпо", "оквэд", "бик", "октмо", "окато", "р/с", "к/с", "счет", "счёт", "лицензия", "снилс", "артикул", "телефон"]
LABEL_WINDOW = 40
# End of fixed values.


def unlabelled_ids(text: Column) -> Column:
    """Numbers without a tax-id label, checksum right, each once: none that another number's label stands before.

    The LABEL_WINDOW characters before a number are put together from the stretches and numbers in front of it, of which
    four are enough: a number has ten characters or more.
    """
    numbers, stretches = F.regexp_extract_all(text, F.lit(UNLABELLED_ID), F.lit(1)), F.split(text, UNLABELLED_ID, -1)
    near = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))

    def read(both: Column) -> Column:
        pieces = F.transform(both["numbers"], lambda x, i: F.struct(F.get(both["stretches"], i).alias("part"), x.alias("number")))

        def one(x: Column, i: Column) -> Column:
            front = F.slice(pieces, F.greatest(i - 3, F.lit(1)), F.least(i, F.lit(4)))
            front = F.when(i == 0, "").otherwise(F.array_join(F.transform(front, lambda y: F.concat(y["part"], y["number"])), ""))
            before = F.lower(F.right(F.concat(front, x["part"]), F.lit(LABEL_WINDOW)))
            return F.struct(digits_only(x["number"]).alias("number"), (near(before, OWN_LABELS) | near(before, OTHER_LABELS)).alias("named"))

        return F.transform(F.filter(F.transform(pieces, one), lambda x: ~x["named"] & valid_company_id(x["number"])), lambda x: x["number"])

    return F.array_distinct(F.element_at(F.transform(F.array(F.struct(numbers.alias("numbers"), stretches.alias("stretches"))), read), 1))


def ids_of_text(text: Column) -> Column:
    """array of struct(number, method): labelled numbers, then those without any label."""
    text = F.coalesce(text, F.lit(""))
    labelled = labelled_ids(text)
    named = lambda c, method: F.transform(c, lambda x: F.struct(x.alias("number"), F.lit(method).alias("method")))
    return F.concat(named(labelled, "labeled"), named(F.array_except(unlabelled_ids(text), labelled), "text"))
