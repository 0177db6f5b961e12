"""Companies resolved in a registry, and numbers read from texts, over companion tables derived by the same SQL for the plan and its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions import company
from quayside.operators import companies
from quayside.plans.registry import Tables, query
from quayside.plans.texts import weights_sql

#: The last digit weighs the others, which are taken from the number by division.
CHECK = " + ".join(f"{w} * (CAST(floor(n / {10 ** (8 - i)}) AS BIGINT) % 10)" for i, w in enumerate(company.WEIGHTS_10))
TAX = f"SELECT DISTINCT k, concat(CAST(n AS VARCHAR(9)), CAST(({CHECK}) % 11 % 10 AS VARCHAR(1))) AS inn FROM (SELECT p_partkey AS k, 770000000 + p_partkey * 37 AS n FROM {{part}}) d"
LABELS = [*company.OTHER_LABELS, "ИНН", "inn", "", "код", "длинного"]
#: Companion tables as SQL; braces mark the driver's tables.
DERIVED = {
    "registry": f"""SELECT CASE WHEN p_partkey % 41 = 40 THEN '7700000000' ELSE inn END AS inn, concat(CAST(102770000000 + p_partkey AS VARCHAR(12)), CAST((102770000000 + p_partkey) % 11 % 10 AS VARCHAR(1))) AS ogrn,
        concat('ООО ', p_name, ' ', CASE WHEN p_partkey % 4 = 0 THEN concat('zu', CAST(p_partkey % 53 AS VARCHAR(9))) ELSE p_type END) AS name, CASE WHEN p_partkey % 3 = 0 THEN concat('https://www.s', CAST(p_partkey % 90 AS VARCHAR(9)), '.ru/') ELSE '' END AS site,
        split(CASE WHEN p_partkey % 5 = 0 THEN concat('x@mail.ru;Sales@s', CAST(p_partkey % 90 AS VARCHAR(9)), '.ru') WHEN p_partkey % 5 = 1 THEN concat('K', CAST(p_partkey % 60 AS VARCHAR(9)), '@mail.ru') ELSE '' END, ';') AS emails FROM {{part}} p JOIN ({TAX}) t ON t.k = p_partkey""",
    "queries": """SELECT concat('s', CAST(p_partkey % 90 AS VARCHAR(9)), '.ru') AS host, p_partkey * 2 AS place, p_name AS query FROM {part} UNION ALL
        SELECT concat('s', CAST(p_partkey % 60 AS VARCHAR(9)), '.ru'), p_partkey * 2 - 1, concat('фирма zu', CAST(p_partkey % 53 AS VARCHAR(9)), CASE WHEN p_partkey % 2 = 0 THEN concat(' ', p_name) ELSE '' END) FROM {part}""",
    "known": "SELECT DISTINCT concat('s', CAST(p_partkey % 60 AS VARCHAR(9)), '.ru') AS host, concat(' k', CAST(p_partkey % 60 AS VARCHAR(9)), '@Mail.ru') AS known_email FROM {part}",
    "printed": """SELECT concat('s', CAST(p_partkey % 90 AS VARCHAR(9)), '.ru') AS host, p_partkey AS place, CASE WHEN p_size % 2 = 0 THEN 'ogrn' ELSE 'ogrnip' END AS kind, p_size % 3 AS score,
        CASE WHEN p_size % 7 = 0 THEN '1027700000000' WHEN p_size % 7 = 1 THEN concat(substr(CAST(102770000000 + p_partkey AS VARCHAR(12)), 1, 6), ' ', substr(CAST(102770000000 + p_partkey AS VARCHAR(12)), 7, 6), '-', CAST((102770000000 + p_partkey) % 11 % 10 AS VARCHAR(1)))
        ELSE concat(CAST(102770000000 + p_partkey AS VARCHAR(12)), CAST((102770000000 + p_partkey) % 11 % 10 AS VARCHAR(1))) END AS value FROM {part} WHERE p_partkey % 6 = 0""",
    "held": f"SELECT concat('s', CAST(k % 90 AS VARCHAR(9)), '.ru') AS host, CASE WHEN k % 8 = 0 THEN concat(substr(inn, 1, 9), 'x') ELSE inn END AS inn FROM ({TAX}) t",
    "texts": f"""SELECT k AS id, concat('Text ', CASE k % {len(LABELS)} {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LABELS))} END, ' ', CASE WHEN k % 3 = 0 THEN concat(substr(inn, 1, 4), ' ', substr(inn, 5, 6)) ELSE inn END, CASE WHEN k % 2 = 0 THEN ', far away from any label, as some forty characters stand here: ' ELSE ' или ' END, inn2, '.') AS body
        FROM (SELECT a.k, a.inn, b.inn AS inn2 FROM ({TAX}) a JOIN ({TAX}) b ON b.k = (a.k * 7) % 997) d""",
}
PLAIN = ", ".join(f"{name} AS ({sql.replace('{part}', 'part')})" for name, sql in DERIVED.items())


def companion(t: Tables, name: str) -> DataFrame:
    return t.part.sparkSession.sql(DERIVED[name], part=t.part)


ROOT = "regexp_extract({}, '([^.]+[.][^.]+)$', 1)"
EVIDENCE = f"""CASE WHEN site <> '' AND {ROOT.format("rtrim(regexp_replace(lower(site), '^https?://(www[.])?', ''), '/')")} = host THEN 'site' WHEN list_contains(list_transform(emails, lambda e: lower(trim(e))), lower(trim(coalesce(known_email, '')))) THEN 'email'
    WHEN len(list_filter(emails, lambda e: split_part(lower(trim(e)), '@', 2) = host)) > 0 THEN 'domain' ELSE 'none' END"""
VALID = f"length(inn) = 10 AND {weights_sql(1, company.WEIGHTS_10).replace('n, ', 'inn, ')} = try_cast(substr(inn, 10, 1) AS INTEGER)"


def words_sql(text: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({text}), '(^| )(ооо|фирма)( |$)', ' ', 'g'), '[^а-яёa-z0-9]+'), lambda w: length(w) > 2))"


@query("TXT50", "TXT32", sql=f"""
    WITH {PLAIN}, v AS (SELECT *, regexp_replace(value, '[ -]', '', 'g') AS n FROM printed)
    SELECT host, x.inn, x.name, x.evidence, 'organization' AS kind, x.n AS number FROM (SELECT v.host, max_by(struct_pack(inn := r.inn, name := r.name, evidence := v.kind, n := v.n), struct_pack(a := v.score, b := -v.place, c := r.inn)) AS x
        FROM v JOIN registry r ON r.ogrn = v.n WHERE CAST(substr(v.n, 1, 12) AS BIGINT) % 11 % 10 = CAST(substr(v.n, 13, 1) AS BIGINT) AND {VALID.replace('inn', 'r.inn')} GROUP BY 1)""")
def registry_by_number(t: Tables) -> DataFrame:
    """Companies whose registration number a site prints."""
    return companies.resolve_by_registration(companion(t, "printed"), companion(t, "registry"))


@query("TXT51", "TXT49", "HLP09", sql=f"""
    WITH {PLAIN}, g AS (SELECT * FROM registry WHERE inn <> '7700000000'), i AS (SELECT DISTINCT inn, unnest({words_sql('name')}) AS word FROM g), f AS (SELECT word, 1000000 // count(*) AS weight FROM i GROUP BY 1),
    q AS (SELECT DISTINCT host, place, word, weight FROM (SELECT host, place, unnest({words_sql('query')}) AS word FROM queries) JOIN f USING (word)), s AS (SELECT host, place, sum(weight) AS total FROM q GROUP BY 1, 2),
    c AS (SELECT q.host, q.place, i.inn, sum(q.weight) AS score FROM q JOIN i ON i.word = q.word GROUP BY 1, 2, 3), a AS (SELECT c.host, c.inn, min(row(c.place, -c.score, length(r.name))) AS at_ FROM c JOIN s ON s.host = c.host AND s.place = c.place JOIN g r ON r.inn = c.inn WHERE 2 * c.score >= s.total GROUP BY 1, 2),
    n AS (SELECT host, inn, row_number() OVER (PARTITION BY host ORDER BY at_, inn) AS rank FROM a), e AS (SELECT n.*, r.name, {EVIDENCE.replace('host', 'n.host')} AS evidence FROM n JOIN g r ON r.inn = n.inn LEFT JOIN known ON known.host = n.host WHERE rank <= 6)
    SELECT host, inn, name, evidence, 'organization' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY CASE evidence WHEN 'domain' THEN 1 ELSE 0 END, rank) AS k FROM e WHERE evidence <> 'none') WHERE k = 1""")
def registry_by_name(t: Tables) -> DataFrame:
    """Companies found by name among six candidates a site, proved by site, address or domain."""
    registry = companion(t, "registry").where("inn <> '7700000000'")  # one row a number
    return companies.resolve_by_name(companion(t, "queries"), companion(t, "known"), registry)


@query("HLP10", "HLP09", sql=f"""
    WITH {PLAIN}, e AS (SELECT h.host, h.inn, r.name, r.emails, {EVIDENCE.replace('host', 'h.host')} AS evidence FROM (SELECT *, '' AS known_email FROM held WHERE {VALID}) h JOIN registry r ON r.inn = h.inn)
    SELECT host, inn, name, evidence, list_filter(emails, lambda x: split_part(lower(trim(x)), '@', 2) = host)[1] AS own_email FROM e WHERE evidence <> 'none'""")
def registry_backlog(t: Tables) -> DataFrame:
    """Known numbers whose records the registry proves to be the site's, with the address on the site's own domain."""
    return companies.confirmed_backlog(companion(t, "held"), companion(t, "registry"))


NUMBERS = "[0-9]{4} [0-9]{6}|[0-9]{10}"


@query("TXT37", "TXT30", sql=f"""
    WITH {PLAIN}, m AS (SELECT id, body, unnest(regexp_extract_all(body, '{NUMBERS}')) AS raw FROM texts), b AS (SELECT id, raw, lower(right(substr(body, 1, strpos(body, raw) - 1), 40)) AS label FROM m),
    c AS (SELECT id, replace(raw, ' ', '') AS inn, regexp_matches(label, '(^|[^а-яa-z])(инн|inn) ?$') AS own, {' OR '.join(f"contains(label, '{w}')" for w in [*company.OWN_LABELS, *company.OTHER_LABELS])} AS named FROM b)
    SELECT id, inn AS number, CASE WHEN bool_or(own) THEN 'labeled' ELSE 'text' END AS method FROM c WHERE (own OR NOT named) AND {VALID} GROUP BY 1, 2""")
def numbers_in_texts(t: Tables) -> DataFrame:
    """Tax numbers of texts, with a label or, if no other number's label stands before them, without."""
    rows = companion(t, "texts").select("id", F.explode(company.ids_of_text(F.col("body"))).alias("x"))
    return rows.select("id", "x.number", "x.method")
