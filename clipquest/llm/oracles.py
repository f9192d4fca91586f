"""The corpus queries that SQL can express, for DuckDB."""

from __future__ import annotations

# A line without the white space [\x20\x09-\x0D] at its ends, A-Z lower-cased.
_KEY = ("translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), "
        "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

LINE_DEDUP = f"""
WITH numbered AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {{docs}}),
lines AS (
    SELECT r, doc_id, pos, line, {_KEY} AS key FROM (
        SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM numbered)),
shared AS (
    SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
    SELECT l.*, s.key IS NOT NULL AND l.doc_id < s.keeper AS gone
    FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, r
FROM judged GROUP BY r"""

# Base 32 of a SHA-1: five hexadecimal digits are four letters.
_BASE32 = """array_to_string(list_transform(range(32), lambda k: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((('0x' || substr(h, 1 + 5 * (k // 4), 5))::INTEGER
    >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '')"""

WARC = f"""
WITH hashed AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h
    FROM pages),
firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM hashed)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts"""

# A text with A-Z lower-cased, and the pattern of a term.
_TERMS = ("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'")

RANKED = f"""
WITH counts AS (
    SELECT r, doc_id, term, count(*) AS tf FROM (
        SELECT r, doc_id, unnest(regexp_extract_all(
            {_TERMS})) AS term
        FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents))
    GROUP BY ALL),
lengths AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY r),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE)
                                      / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counts, whole GROUP BY term),
wanted AS (
    SELECT DISTINCT i, item_id, unnest(regexp_extract_all(
        {_TERMS})) AS term
    FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
scores AS (
    SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf)
        // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
    FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (r), whole
    GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
       doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10"""

ORACLES: dict[str, str] = {
    "op2_line_dedup": "SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM ("
                      + LINE_DEDUP.format(docs="documents") + ")",
    "op10_warc": WARC,
    "op13_ranked_search": RANKED,
}


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
