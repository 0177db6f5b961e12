"""DuckDB twins of the queries that SQL can express on whole tables.

Language ID, SimHash components, tokenizers, the span classifier and the pipeline are no SQL; their tests hold them
against brute-force versions and the libraries.
"""

from __future__ import annotations

WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
SHINGLE_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


def shingles(words: str, size: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({words}) - {size} + 2, 1)), lambda i: array_to_string({words}[i : i + {size} - 1], ' ')))"


def _lloyd(rounds: int) -> str:
    """Common tables a0, b1, a1, ...: indexes by the entries b, then entries by the indexes a."""

    def assign(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (SELECT r, k, min([d, e]) AS m FROM (SELECT p.r, p.k, b.e, CAST(list_sum(list_transform(list_zip(p.y, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN b{i} b ON p.k = b.k) GROUP BY r, k)"""

    def update(i: int) -> str:
        return f"""m{i} AS (SELECT k, e, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY j) AS y FROM (SELECT a.k, a.m[2] AS e, u.j, CAST(sum(p.y[u.j]) AS BIGINT) AS s, count(*) AS n
            FROM a{i} a JOIN p ON p.r = a.r AND p.k = a.k CROSS JOIN LATERAL (SELECT unnest(range(1, len(p.y) + 1)) AS j) u GROUP BY ALL) GROUP BY k, e),
        b{i + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(m.y, b.y) AS y FROM b{i} b LEFT JOIN m{i} m ON m.k = b.k AND m.e = b.e)"""

    return ",\n        ".join([x for i in range(rounds) for x in (assign(i), update(i))] + [assign(rounds)])


ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": f"""
        WITH i AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {SHINGLE_WORDS.format("coalesce(text, '')")} AS w FROM benchmark) WHERE len(w) > 0),
        s AS (SELECT item_id, k, unnest({shingles("w", "k")}) AS x FROM i), n AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1),
        d AS (SELECT doc_id, {SHINGLE_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        g AS (SELECT doc_id, kk.k, unnest(list_distinct(list_transform(range(1, greatest(len(w) - kk.k + 2, 1)), lambda i: array_to_string(w[i : i + kk.k - 1], ' ')))) AS x FROM d, (SELECT DISTINCT k FROM i) kk),
        h AS (SELECT g.doc_id, s.item_id, count(*) AS n_shared FROM g JOIN s ON g.x = s.x AND g.k = s.k GROUP BY 1, 2)
        SELECT doc_id, item_id, n AS n_shingles, n_shared, CAST(n_shared AS DOUBLE) / n AS containment FROM h JOIN n USING (item_id) WHERE n_shared >= 0.8 * n""",
    "op3_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1))) AS pos, w FROM d),
        g AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY sha256(array_to_string(w[pos : pos + 19], ' ')) ORDER BY doc_id, pos) AS n FROM p),
        c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS i FROM g WHERE n > 1),
        e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
        k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept, count(*) AS n FROM e ANTI JOIN c ON c.doc_id = e.doc_id AND c.i = e.i GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op5_line_dedup": """
        WITH d AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, source, unnest(range(1, len(lines) + 1)) AS pos, trim(unnest(lines), chr(32) || chr(9) || chr(13)) AS x FROM d),
        b AS (SELECT x FROM l WHERE x <> '' GROUP BY x HAVING count(DISTINCT source) >= 10),
        r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY l.x ORDER BY doc_id, pos) AS n FROM l JOIN b ON b.x = l.x),
        g AS (SELECT doc_id, list(pos) AS gone FROM r WHERE n > 1 GROUP BY 1)
        SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines, coalesce(len(gone), 0) AS n_removed,
               sha256(CASE WHEN gone IS NULL THEN coalesce(text, '') ELSE coalesce(array_to_string(list_transform(list_filter(list_zip(lines, range(1, len(lines) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]), chr(10)), '') END) AS kept_sha256
        FROM d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "op7_chat_formatting": """
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        e AS (SELECT *, replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') AS content FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, content)) AS turns_sha256,
               CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, content), '')) AS loss_sha256,
               CAST(sum(12 + length(role) + 1 + length(content) + 11) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op11_source_divergence": """
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM t GROUP BY ALL),
        v AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY 1, 2 HAVING sum(docs) >= 3),
        lt AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS n FROM v GROUP BY 1),
        k AS (SELECT c.lang, c.source, c.term, CAST(c.n AS HUGEINT) AS n FROM c JOIN v ON c.lang = v.lang AND c.term = v.term),
        g AS (SELECT x.lang, x.source, CAST(coalesce(sum(k.n), 0) AS HUGEINT) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN k ON k.lang = x.lang AND k.source = x.source GROUP BY 1, 2),
        p AS (SELECT v.lang, g.source, v.term, coalesce(k.n, 0) AS n, 1 + 1000000000 * (coalesce(k.n, 0) + 1) // (g.n + lt.v) AS p, 1 + 1000000000 * (v.n + 1) // (lt.n + lt.v) AS q
              FROM v JOIN lt ON lt.lang = v.lang JOIN g ON g.lang = v.lang LEFT JOIN k ON k.lang = v.lang AND k.source = g.source AND k.term = v.term),
        s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
              UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
        o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
        SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200""",
    "op13_vector_codes": f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT r, t.k, x[t.k * len(x) // 4 + 1 : (t.k + 1) * len(x) // 4] AS y FROM v, (SELECT unnest(range(4)) AS k) t),
        b0 AS MATERIALIZED (SELECT k, r - 1 AS e, y FROM p WHERE r <= 256),
        {_lloyd(4)},
        c AS (SELECT r, string_agg(lower(lpad(to_hex(m[2]), 2, '0')), '' ORDER BY k) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM a4 GROUP BY r),
        h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY k, e)) AS h FROM b4)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.h AS codebooks_sha256 FROM v JOIN c ON c.r = v.r, h""",
    "op12_minhash_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')))) END AS x FROM d),
        n AS MATERIALIZED (SELECT sha256(array_to_string(x, chr(10))) AS node, any_value(x) AS x, min(doc_id) AS least FROM s WHERE len(x) > 0 GROUP BY 1),
        e AS MATERIALIZED (SELECT node, len(x) AS n, unnest(x) AS x FROM n),
        l AS MATERIALIZED (SELECT a.node AS u, b.node AS v FROM e a JOIN e b ON a.x = b.x AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
        t(u, v) AS (SELECT node, node FROM n UNION SELECT t.u, b.v FROM t JOIN b ON t.v = b.u),
        c AS (SELECT t.u AS node, min(n.least) AS component_id FROM t JOIN n ON n.node = t.v GROUP BY 1)
        SELECT s.doc_id, len(s.x) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
        FROM s LEFT JOIN c ON len(s.x) > 0 AND c.node = sha256(array_to_string(s.x, chr(10)))""",
}
