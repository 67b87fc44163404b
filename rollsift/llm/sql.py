"""DuckDB SQL of the queries that SQL can express on small tables."""

from __future__ import annotations

from rollsift.llm import secrets as s

JACCARD = """
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    sets AS (
        SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]
            WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS grams FROM w),
    sizes AS (SELECT doc_id, len(grams) AS n FROM sets),
    grams AS (SELECT doc_id, unnest(grams) AS gram FROM sets),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
    reached(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT l.a, r.other FROM reached r JOIN links l ON l.b = r.doc_id)
    SELECT doc_id, n AS n_shingles, min(other) AS component_id FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _located(name: str, pattern: str) -> str:
    p = _quoted(pattern)
    return f"""{name} AS (
        SELECT doc_id, value, (list_sum([len(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([len(x) FOR x IN found[1:i - 1]]), 0))::BIGINT AS start
        FROM (SELECT doc_id, found, gaps, unnest(found) AS value, unnest(range(1, len(found) + 1)) AS i
              FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS found, regexp_split_to_array(t, {p}) AS gaps FROM texts)))"""


def secret_spans() -> str:
    # RE2 never goes back, and has no mark for it
    plain = [p.replace("++", "+").replace("*+", "*").replace("}+", "}") for p in s.ALLOWED]
    allowed = " OR ".join(f"regexp_matches(value, {_quoted(p)})" for p in [s.NUMBER, *plain])
    w = s.WINDOW
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    {_located("assigned", s.ASSIGN)}, {_located("accessed", s.ACCESS)}, {_located("hexed", s.HEX)}, {_located("runs", s.CANDIDATE)},
    base AS (
        SELECT doc_id, start, 0 AS rank, start + len(value) AS stop, 'assign' AS kind FROM assigned WHERE len(regexp_extract(value, {_quoted(s.ASSIGN)}, 2)) >= 6
        UNION ALL SELECT doc_id, start, 1, start + len(value), 'access' FROM accessed WHERE len(value) >= 20
        UNION ALL SELECT doc_id, start, 2, start + len(value), 'hex' FROM hexed),
    classed AS (SELECT doc_id, start, value, regexp_replace(value, {_quoted(s.PLACEHOLDER)}, '\\3', 'g') AS seen,
        CASE WHEN NOT regexp_matches(value, '[0-9]') THEN CASE WHEN regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') THEN 5 END
             WHEN regexp_full_match(value, '[0-9a-fA-F]*') THEN 3 ELSE 4 END AS rank
        FROM runs WHERE NOT ({allowed})),
    candidates AS (SELECT * FROM classed WHERE rank IS NOT NULL),
    windows AS (SELECT doc_id, start, seen, unnest(range(1, len(seen) - {w - 1} + 1)) AS i FROM candidates),
    characters AS (SELECT doc_id, start, i, unnest(string_split(substr(seen, i, {w}), '')) AS ch FROM windows),
    counts AS (SELECT doc_id, start, i, ch, count(*) AS c FROM characters GROUP BY ALL),
    entropies AS (SELECT doc_id, start, i, log2({w}.0) - sum(c * log2(c)) / {w}.0 AS bits FROM counts GROUP BY ALL),
    best AS (SELECT doc_id, start, max(bits) AS bits FROM entropies GROUP BY ALL),
    hot AS (
        SELECT doc_id, start, rank, start + len(value) AS stop, CASE rank WHEN 3 THEN 'entropy_hex' WHEN 4 THEN 'entropy_mixed' ELSE 'entropy_letters' END AS kind
        FROM candidates JOIN best USING (doc_id, start)
        WHERE bits >= CASE rank WHEN 3 THEN {s.THRESHOLDS["entropy_hex"]} WHEN 4 THEN {s.THRESHOLDS["entropy_mixed"]} ELSE {s.THRESHOLDS["entropy_letters"]} END),
    added AS (SELECT * FROM hot h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.start <= h.start AND b.stop >= h.stop)),
    base_lists AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS listed FROM base GROUP BY doc_id),
    all_lists AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS listed FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id)
    SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.listed, '')) AS base_sha256, coalesce(a.listed, '') AS spans
    FROM texts t LEFT JOIN base_lists b USING (doc_id) LEFT JOIN all_lists a USING (doc_id)
    """

WORDS = "[w FOR w IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF w <> '']"

#: Every run of a document's words that is as long as some window is compared with all windows.
DECONTAMINATION = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
    i AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
    win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT *, least(len(w), 10) AS n FROM i WHERE len(w) > 0))),
    runs AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
    hits AS (SELECT r, s, runs.n AS n, item_id FROM runs JOIN win ON runs.n = win.n AND runs.t = win.t),
    marks AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
    named AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS name FROM hits) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN marks USING (r) LEFT JOIN named USING (r)
"""
