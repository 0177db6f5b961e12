"""Personal data by weak supervision, in native expressions.

Base spans are the matches of four fixed patterns that pass their checks. Looser patterns give candidate spans of five
more kinds. Four labelers vote on every span, base ones included: a strict form (regex), a gazetteer (known endings,
prefixes, names), the words before it (context) and the mix of its characters (shape), each for, against or not at
all. The votes are counted by grouped aggregation; the number of distinct vote patterns is bounded by kinds
and labelers, not by the data. Expectation-maximisation over these counts estimates the prior of each kind and each
labeler's reliability; the posteriors train a logistic span classifier over kind, votes and features that no
labeler votes on (length, share of digits, what stands right before and behind), whose weights become a native
expression. Base spans stay whatever it says; candidates that it accepts and that touch no base span are added.

Positions come from split() and regexp_extract_all() of one pattern: the parts between matches and the matches,
whose lengths add up to code-point offsets. Patterns use possessive runs of single character classes, so time is
linear in a text's length and the regex engine does not recurse; no part of a pattern has a greatest length.

Defined results: a null text is empty and has no spans; repeated rows give a row each; an empty table gives no
rows and trains on nothing (the prior decides); other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import running, table, written

KINDS = ("email", "ip", "card", "phone", "mail_words", "phone_local", "id_number", "person", "secret")
BASE = KINDS[:4]
SPAN = "struct<start:bigint,kind:int,end:bigint,value:string,before:string>"

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A separator that is not between two digits, and what is left of a card number's form once those are gone. In their places stand
#: characters that are no part of a number but, as they were, no part of a word either, so that words before a number are still read.
LOOSE, DIGITS = r"{0}(?![0-9])|(?<![0-9]){0}", r"[0-9][0-9\x20-]+"
INSTEAD = {r"\x20": "\t", "-": "~"}
TWELVE = r"[0-9](?:[\x20-]?[0-9]){11}"

#: Candidates beyond the base: kind, pattern.
CANDIDATES = {
    "mail_words": r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++",
    "phone_local": r"(?<![0-9+.)-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.? [A-Z][a-z]++(?: [A-Z][a-z]++)?+",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",
}
#: A sign of the kind that costs less to look for than its pattern.
HINTS = {"mail_words": r"[\[(]at[\])]", "secret": r"[A-Za-z0-9+/_-]{16}"}
#: Strict forms: what a true instance of the kind looks like.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "ip": r"^(?!0)[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$",
    "phone": r"^\+[0-9]{1,3} ?(?:\([0-9]{1,4}\))?[ 0-9.-]+$",
    "mail_words": r"^\S+ ?[\[(]at[\])] ?\S+ ?(?:[\[(]dot[\])]|\.) ?[A-Za-z]{2,}$",
    "phone_local": r"^(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ .-][2-9][0-9]{2}[ .-][0-9]{4}$",
    "id_number": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "person": r"^\S+ [A-Z][a-z]+ [A-Z][a-z]+$",
    "secret": r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=[^0-9]*[0-9])(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])[A-Za-z0-9+/_-]{20,})$",
}
#: Gazetteers, for and against.
ENDINGS = "com org net edu gov info biz io de fr es it nl be at ch uk us ca au nz ie dk se no fi pl pt cz ru ua jp cn in br mx eu"
NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen "
    "Anna Maria Peter Paul Hans Klaus Jürgen Wolfgang Ursula Monika Petra Sabine Jean Pierre Michel André Marie Nathalie Isabelle Sylvie "
    "Carlos José Juan Luis Antonio Manuel Carmen Ana Isabel Dolores Smith Johnson Williams Brown Jones Miller Davis Müller Schmidt Schneider "
    "Fischer Weber Meyer Wagner Becker Martin Bernard Dubois Durand Moreau Laurent García Martínez López Sánchez González Rodríguez Fernández"
)
PREFIXES = "sk- sk_ pk_ rk_ ghp_ gho_ ghs_ github_pat_ glpat- xoxb- xoxp- xoxa- AKIA ASIA AIza ya29 SG. npm_ pypi- hf_ eyJ shpat_ dop_v1_"


def _any(words: str) -> str:
    return "|".join(words.replace("_", "[_]").replace(".", "[.]").split())


KNOWN = {
    "email": (rf"(?i)\.(?:{_any(ENDINGS)})$", r"(?i)\.(?:invalid|localhost|test|local)$"),
    "ip": (r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.", r"^(?:0|127|255)\."),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6)", r"^(?:0|1|9)"),
    "phone": (r"^\+[1-9]", r"^\+0|(?:000|123)[ .-]?4567"),
    "mail_words": (rf"(?i)(?:{_any(ENDINGS)})$", r"(?i)(?:invalid|localhost)"),
    "phone_local": (r"^\(?[2-9]", r"^\(?[01]|(?:000|123)[ .-]?4567"),
    "id_number": (r"^[0-8]", r"^(?:123-45-6789|078-05-1120)$"),
    "person": (rf"\b(?:{_any(NAMES)})\b", r"\b(?:The|And|President|Chairman|Speaker)\b"),
    "secret": (rf"^(?:{_any(PREFIXES)})|^(?:[0-9a-f]{{32}}|[0-9a-f]{{40}}|[0-9a-f]{{64}})$", r"(?i)example|test|dummy|xxxx|^[A-Za-z/_-]+$|^[0-9-]+$|^(.)\1+$"),
}
#: Words before a span that speak for it or against it.
CONTEXT_FOR = r"(?i)(?:mail|contact|call|phone|tel|fax|mobile|ssn|social|security|reach|write|key|token|secret|password|passwd|auth|bearer|credential|name|signed|by|card|visa|pay|ip|host|address|from)\W*$"
CONTEXT_AGAINST = r"(?i)(?:isbn|issn|version|order|item|serial|model|part|no|page|section|chapter|commit|sha|md5|digest|checksum)\W*$"
CONTEXT = 24
#: Kinds of which digits, letters or both are typical: the share of digits in ten, from and to.
SHARE = {"email": (0, 5), "ip": (6, 9), "card": (7, 10), "phone": (6, 10), "mail_words": (0, 4), "phone_local": (7, 10), "id_number": (8, 9), "person": (0, 0), "secret": (2, 8)}


def matches(text: Column, pattern: str, kind: str, accept=None) -> Column:
    """array<SPAN> of the pattern's leftmost matches that are accepted; offsets are code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(hits.alias("hit"), F.slice(F.split(text, pattern, -1), 1, 1 << 30).alias("part"))

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        part = F.coalesce(x["part"], F.lit(""))
        begin = at + F.length(part)
        end = begin + F.length(F.coalesce(x["hit"], F.lit("")))
        span = F.struct(begin.cast("bigint").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.cast("bigint").alias("end"), x["hit"].alias("value"), F.right(part, F.lit(CONTEXT)).alias("before"))
        good = x["hit"].isNotNull()
        return end, span, good if accept is None else good & accept(x["hit"])

    return running(both, SPAN, step)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    reverse = F.reverse(digits(value))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(reverse))),
        F.lit(0),
        lambda n, i: n + F.when(i % 2 == 1, F.substr(reverse, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(2 * d if d < 5 else 2 * d - 9) for d in range(10)]), F.substr(reverse, i, F.lit(1)).cast("int") + 1)
        ),
    )
    n = F.length(digits(value))
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(False)


def octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: x.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_spans(text: Column) -> Column:
    """array<SPAN> of the base kinds, by start, then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    mail = F.when(F.contains(text, F.lit("@")), matches(text, EMAIL, "email")).otherwise(none)
    ip = F.when(text.rlike(IP), matches(text, IP, "ip", octets)).otherwise(none)
    apart = text
    for separator, other in INSTEAD.items():
        apart = F.regexp_replace(apart, LOOSE.format(separator), other)
    card = F.when(text.rlike(TWELVE), matches(apart, DIGITS, "card", luhn)).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), matches(text, PHONE, "phone", lambda x: F.length(digits(x)).between(9, 15))).otherwise(none)
    return F.array_sort(F.concat(mail, ip, card, phone))


def candidate_spans(text: Column) -> Column:
    """array<SPAN> of the looser kinds."""
    none = F.array().cast(f"array<{SPAN}>")
    return F.concat(*[F.when(text.rlike(HINTS.get(kind, pattern)), matches(text, pattern, kind)).otherwise(none) for kind, pattern in CANDIDATES.items()])


def by_kind(kind: Column, value: Column, patterns: dict[str, str]) -> Column:
    out = F.lit(False)
    for name, pattern in patterns.items():
        out = F.when(kind == KINDS.index(name), value.rlike(pattern)).otherwise(out)
    return out


def features(span: Column) -> Column:
    """kind; votes of the labelers (1 for, -1 against, 0 none); buckets of length, share of digits, what stands before."""
    kind, value, before = span["kind"], span["value"], span["before"]
    known = by_kind(kind, value, {k: p[0] for k, p in KNOWN.items()})
    barred = by_kind(kind, value, {k: p[1] for k, p in KNOWN.items()})
    share = F.floor(10 * F.length(digits(value)) / F.greatest(F.length(value), F.lit(1))).cast("int")
    within = F.lit(False)
    for name, (low, high) in SHARE.items():
        within = F.when(kind == KINDS.index(name), share.between(low, high)).otherwise(within)
    return F.struct(
        kind.alias("kind"),
        F.when(by_kind(kind, value, STRICT), 1).otherwise(-1).alias("regex"),
        F.when(barred, -1).when(known, 1).otherwise(0).alias("gazetteer"),
        F.when(before.rlike(CONTEXT_FOR), 1).when(before.rlike(CONTEXT_AGAINST), -1).otherwise(0).alias("context"),
        F.when(within, 1).otherwise(-1).alias("shape"),
        F.least(F.lit(6), F.floor(F.length(value) / 8)).cast("int").alias("size"),
        F.floor(share / 3).cast("int").alias("share"),
        F.when(before.rlike(r"[\"'=:]$"), 2).when(before.rlike(r"(?:^|\s)$"), 1).otherwise(0).alias("front"),
    )


LABELERS = ("regex", "gazetteer", "context", "shape")
MORE = ("size", "share", "front")
FEATURES = "struct<" + ",".join(f"{x}:int" for x in ("kind", *LABELERS, *MORE)) + ">"


def expectation_maximisation(counts: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[dict, dict, dict]:
    """(prior by kind, vote probabilities by labeler and truth, posterior by pattern) from counts of (kind, votes).

    A Beta(2, 2) prior on kinds and one pseudo-count on votes keep unseen cases defined.
    """
    labelers = range(len(counts[0][0]) - 1 if counts else 0)
    prior = {k: 0.5 for k in range(len(KINDS))}
    vote = {(j, v, z): p for j in labelers for z in (0, 1) for v, p in ((1, 0.7 if z else 0.2), (0, 0.1), (-1, 0.2 if z else 0.7))}
    posterior: dict = {}
    for _ in range(rounds):
        for (kind, *votes), _n in counts:
            like = [prior[kind] if z else 1 - prior[kind] for z in (0, 1)]
            for j, v in enumerate(votes):
                like = [x * vote[j, v, z] for z, x in enumerate(like)]
            posterior[(kind, *votes)] = like[1] / (like[0] + like[1])
        for k in prior:
            mine = [(posterior[p], n) for p, n in counts if p[0] == k]
            prior[k] = (1 + sum(p * n for p, n in mine)) / (2 + sum(n for _, n in mine))
        for j in labelers:
            for z in (0, 1):
                mass = {v: 1.0 for v in (1, 0, -1)}
                for pattern, n in counts:
                    p = posterior[pattern]
                    mass[pattern[1 + j]] += n * (p if z else 1 - p)
                whole = sum(mass.values())
                for v in mass:
                    vote[j, v, z] = mass[v] / whole
    return prior, vote, posterior


def names_of(row: tuple) -> list[str]:
    return ["bias", *[f"{name}:{value}" for name, value in zip(("kind", *LABELERS, *MORE), row, strict=True)]]


def train(counts: list[tuple[tuple, float]], posterior: dict, steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic classifier fitted to the posteriors by gradient descent over the counted feature rows."""
    weights: dict[str, float] = {}
    total = sum(n for _, n in counts) or 1.0
    named = [(names_of(row), posterior[row[: 1 + len(LABELERS)]], n / total) for row, n in counts]
    for _ in range(steps):
        slope: dict[str, float] = {}
        for names, truth, n in named:
            p = 1 / (1 + math.exp(-sum(weights.get(x, 0.0) for x in names)))
            for x in names:
                slope[x] = slope.get(x, 0.0) + (truth - p) * n
        for x, s in slope.items():
            weights[x] = weights.get(x, 0.0) + rate * (s - decay * weights.get(x, 0.0))
    return weights


def fitted(counts: list[tuple[tuple, float]]) -> tuple[dict[str, float], dict]:
    """(weights of the span classifier, the estimated reliabilities) from counted feature rows."""
    counts = sorted(counts)
    patterns: dict = {}
    for row, n in counts:
        key = row[: 1 + len(LABELERS)]
        patterns[key] = patterns.get(key, 0.0) + n
    _, vote, posterior = expectation_maximisation(sorted(patterns.items()))
    return train(counts, posterior), vote


def score(f: Column, weights: dict[str, float]) -> Column:
    """The classifier's log-odds of a features struct."""
    out = F.lit(weights.get("bias", 0.0))
    for name in ("kind", *LABELERS, *MORE):
        part = F.lit(0.0)
        for x, w in sorted(weights.items()):
            if x.startswith(f"{name}:"):
                part = F.when(f[name] == int(x.partition(":")[2]), w).otherwise(part)
        out = out + part
    return out


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, base (array of spans), added (array of spans the classifier accepts, apart from base ones).

    Texts are read once: what goes on is a thin table of the spans with their features.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    thin = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), features(s).alias("f")))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), thin(base_spans(text)).alias("base"), thin(candidate_spans(text)).alias("loose"))
    rows = written(rows, "spans")
    votes = rows.select(F.explode(F.concat("base", "loose")).alias("s")).select("s.f.*")
    # at most kinds x votes x buckets rows, whatever the input
    found = votes.groupBy("kind", *LABELERS, *MORE).count().collect()
    weights, _ = fitted([(tuple(r)[:-1], float(r["count"])) for r in found])

    def good(s: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) & (score(s["f"], weights) > 0)

    added = F.when(F.size("loose") > 0, F.filter("loose", good)).otherwise(F.col("loose"))
    return rows.select("doc_id", "base", added.alias("added"))


def written_out(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    every = F.concat("base", "added")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(written_out(F.col("base")), 256).alias("base_sha256"),
        written_out(F.array_sort(every)).alias("spans"),
        F.size(every).cast("long").alias("n_spans"),
    )
