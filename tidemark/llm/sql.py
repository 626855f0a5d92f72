"""DuckDB SQL for the queries of this folder."""

from __future__ import annotations

URL_FILTER = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), parts AS (
    SELECT row_number() OVER () AS k, page_id,
           coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), best AS (
    SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
    FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (k)
"""

LINE_DEDUP = r"""
WITH docs AS (
    SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), split AS (
    SELECT k, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs
), keyed AS (
    SELECT k, doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM split
), common AS (
    SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT k) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE common.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.key = common.key
GROUP BY k, doc_id
"""

DECONTAMINATION = r"""
WITH docs AS (
    SELECT row_number() OVER () AS k, doc_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
    FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), starts AS (
    SELECT item_id, words, least(10, len(words)) AS size, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS pos
    FROM items WHERE len(words) > 0
), windows AS (
    SELECT DISTINCT item_id, size, array_to_string(words[pos : pos + size - 1], ' ') AS run FROM starts
), sizes AS (
    SELECT DISTINCT size FROM windows
), places AS (
    SELECT k, size, words, unnest(range(1, len(words) - size + 2)) AS pos FROM docs JOIN sizes ON len(words) >= size
), runs AS (
    SELECT k, size, pos, array_to_string(words[pos : pos + size - 1], ' ') AS run FROM places
), found AS (
    SELECT k, pos, size, item_id FROM runs JOIN windows USING (size, run)
), hit AS (
    SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(pos, pos + size)) AS place FROM found) GROUP BY k
), named AS (
    SELECT k, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
    FROM found GROUP BY k
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (k) LEFT JOIN named USING (k)
"""

NGRAM_JOIN = r"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS k, doc_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
    FROM documents
), starts AS (
    SELECT k, words, least(5, len(words)) AS size, unnest(range(1, len(words) - least(5, len(words)) + 2)) AS pos FROM docs WHERE len(words) > 0
), grams AS (
    SELECT DISTINCT k, array_to_string(words[pos : pos + size - 1], ' ') AS gram FROM starts
), sets AS (
    SELECT k, count(*) AS size, md5(string_agg(gram, '|' ORDER BY gram)) AS set_key FROM grams GROUP BY k
), common AS (
    SELECT a.k AS a, b.k AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.k <> b.k GROUP BY a.k, b.k
), links AS (
    SELECT a, b FROM common JOIN sets x ON a = x.k JOIN sets y ON b = y.k WHERE 5 * n >= 4 * (x.size + y.size - n)
), reach(k, r) AS (
    SELECT k, k FROM docs UNION SELECT reach.k, links.b FROM reach JOIN links ON reach.r = links.a
), classes AS (
    SELECT reach.k, min(docs.doc_id) AS class_id FROM reach JOIN docs ON reach.r = docs.k GROUP BY reach.k
), degree AS (
    SELECT a AS k, count(*) AS n_links FROM links GROUP BY a
), copies AS (
    SELECT k, count(*) OVER (PARTITION BY set_key) AS n_copies FROM sets
)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 1) AS n_copies
FROM docs JOIN classes USING (k) LEFT JOIN degree USING (k) LEFT JOIN copies USING (k)
"""

ORACLES: dict[str, str] = {
    "op3_ngram_join": NGRAM_JOIN,
    "op4_url_filter": URL_FILTER,
    "op5_line_dedup": LINE_DEDUP,
    "op7_benchmark_decontamination": DECONTAMINATION,
}
