"""Contacts of texts that stand near certain words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators import proximity
from quayside.plans.registry import Tables, query

MAIL, CALL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"\+[0-9][0-9 ().-]{7,}[0-9]"
WORDS, BARRED, UNLESS = ["contact", "kontakt", " the ", " und "], [" was "], [" for "]


def has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


def places(pattern: str) -> str:
    """Each match's place from the lengths of what stands before it."""
    return f"""SELECT doc_id, h[i] AS value, CAST(coalesce(list_sum(list_transform(p[1 : i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1 : i - 1], lambda x: length(x))), 0) AS INTEGER) AS place, t
        FROM (SELECT doc_id, t, h, regexp_split_to_array(t, '{pattern}') AS p, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{pattern}') AS h FROM documents))"""


@query("TXT99", "TXT13", sql=f"""
    WITH m AS ({places(MAIL)} UNION ALL {places(CALL)}),
    c AS (SELECT doc_id, value, place, trim(regexp_replace(substr(t, greatest(place - 180, 0) + 1, least(place, 180) + length(value) + 180), '\\s+', ' ', 'g')) AS context FROM m), l AS (SELECT *, lower(context) AS low FROM c),
    g AS (SELECT * FROM l WHERE {has(WORDS)} AND NOT ({has(BARRED)} AND NOT {has(UNLESS)}))
    SELECT doc_id, value, min(place) AS "at", md5(arg_min(context, place)) AS context FROM g GROUP BY 1, 2""")
def contacts_near_words(t: Tables) -> DataFrame:
    """Addresses and numbers with a word of the subject within 180 characters, and the text around them as a digest."""
    found = proximity.near_words(t.documents, "text", [MAIL, CALL], WORDS, BARRED, UNLESS)
    return found.withColumn("context", F.md5("context"))
