"""DuckDB statements for the rows of the queries that SQL can express on whole tables."""

from __future__ import annotations

from .licenses import TEMPLATES

_WORDS = r"""words AS (SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') END AS w FROM documents)"""

SUBSTRING = (
    "WITH "
    + _WORDS.format(text="text")
    + """,
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM words WHERE len(w) >= 50),
windows AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS d FROM windows GROUP BY k),
late AS (SELECT DISTINCT doc_id, i FROM windows JOIN firsts USING (k) WHERE doc_id > d),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM late),
lists AS (SELECT doc_id, list(i ORDER BY i) AS g FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM words),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i WHERE g.i IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words w LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)"""
)

NEAR = (
    "WITH RECURSIVE "
    + _WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """,
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
each AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM each a JOIN each b ON a.k = b.k AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, x.b FROM reach r JOIN pairs x ON x.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id, min(r.b) = s.doc_id AS kept FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s"""
)

_BODIES = ", ".join("('{}', '{}')".format(k, b.replace("'", "''")) for k, bodies in TEMPLATES.items() for b in bodies)
_TERM = r"[a-z0-9]+(?:\.[0-9]+)*"

LICENSES = rf"""WITH templates(license, body) AS (VALUES {_BODIES}),
placed AS (SELECT doc_id, coalesce(text, '') AS body, array_to_string([coalesce(source, 'none'), coalesce(lang, 'none'), CAST(doc_id // 100 AS VARCHAR), 'part' || CAST(doc_id % 3 AS VARCHAR)][1:CAST(doc_id % 4 AS INTEGER) + 1], '/') AS dir, doc_id % 10 = 0 AS named FROM documents),
files AS MATERIALIZED (SELECT *, dir || '/' || CASE WHEN named THEN 'LICENSE-' ELSE '' END || CAST(doc_id AS VARCHAR) AS path,
    CASE WHEN NOT named THEN array_to_string(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '(?i)licen[cs]e|copyright|permission is hereby granted|public domain|redistribution and use')), ' ') END AS header FROM placed),
stated AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN named THEN list_filter(string_split_regex(body, '\n[ \t\r]*\n'), lambda x: regexp_matches(lower(x), '[a-z0-9]')) WHEN header <> '' THEN [header] ELSE [] END) AS unit FROM files),
units AS (SELECT DISTINCT unit FROM stated),
spread AS (SELECT unit, term, count(*) AS tf FROM (SELECT unit, unnest(regexp_extract_all(lower(unit), '{_TERM}')) AS term FROM units) GROUP BY ALL),
model AS (SELECT license, body, term, count(*) AS tf FROM (SELECT license, body, unnest(regexp_extract_all(lower(body), '{_TERM}')) AS term FROM templates) GROUP BY ALL),
idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM units) + (SELECT count(*) FROM templates)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM (SELECT term FROM spread UNION ALL SELECT term FROM model) GROUP BY term),
wu AS (SELECT unit, term, tf * idf AS w FROM spread JOIN idf USING (term)),
wm AS (SELECT license, body, term, tf * idf AS v FROM model JOIN idf USING (term)),
scored AS (SELECT unit, license, round(dot / (nu * nm), 6) AS similarity FROM (SELECT unit, license, body, sum(w * v) AS dot FROM wu JOIN wm USING (term) GROUP BY ALL)
    JOIN (SELECT unit, sqrt(sum(w * w)) AS nu FROM wu GROUP BY unit) USING (unit) JOIN (SELECT license, body, sqrt(sum(v * v)) AS nm FROM wm GROUP BY ALL) USING (license, body) WHERE round(dot / (nu * nm), 6) >= 0.5),
best AS (SELECT doc_id, min((-similarity, license)) AS x FROM stated JOIN scored USING (unit) GROUP BY doc_id),
own AS MATERIALIZED (SELECT f.doc_id, path, dir, x[2] AS license, -x[1] AS similarity, x IS NOT NULL AND (named OR len(regexp_extract_all(lower(header), '{_TERM}')) >= 0.3 * len(regexp_extract_all(lower(f.body), '{_TERM}'))) AS is_file FROM files f LEFT JOIN best USING (doc_id)),
source_dirs AS (SELECT dir AS from_dir, min((-similarity, license))[2] AS inherited FROM own WHERE is_file GROUP BY dir),
up AS (SELECT DISTINCT dir, array_to_string(string_split(dir, '/')[1:unnest(generate_series(1, len(string_split(dir, '/'))))], '/') AS from_dir FROM own),
near AS (SELECT dir, max((length(from_dir), from_dir, inherited)) AS n FROM up JOIN source_dirs USING (from_dir) GROUP BY dir)
SELECT doc_id, path, coalesce(license, n[3]) AS license, similarity, CASE WHEN license IS NOT NULL AND is_file THEN 'file' WHEN license IS NOT NULL THEN 'header' WHEN n IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
    CASE WHEN license IS NULL THEN n[2] END AS from_dir FROM own LEFT JOIN near USING (dir)"""

SQL = {"op1_substring_dedup": SUBSTRING, "op6_near_duplicates": NEAR, "op10_scan_licenses": LICENSES}
