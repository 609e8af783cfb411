"""DuckDB SQL for the queries that SQL can express, by plain search."""

from __future__ import annotations

from dossier.llm.license_scan import TEMPLATES

_TEMPLATE_ROWS = ", ".join(
    "({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES)
)

LICENSE_SCAN = rf"""
WITH templates AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) t(template, license, statement)),
grams AS (SELECT template, license, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS g
  FROM (SELECT *, regexp_extract_all(lower(statement), '[a-z0-9]+') AS w FROM templates)),
wanted AS (SELECT template, license, len(g) AS size, greatest(1, len(g) // 4) AS step, unnest(g) AS gram FROM grams),
tokens AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda t: lower(t)) AS w FROM documents),
places AS (SELECT doc_id, i - 1 AS place, array_to_string(w[i:i+2], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM tokens WHERE len(w) >= 3)),
hits AS (SELECT doc_id, template, license, size, step, gram,
    unnest(range(CAST(greatest(0, ceil((place - size - step + 1) / step)) AS BIGINT), place // step + 1)) * step AS word
  FROM places JOIN wanted USING (gram)),
windows AS (SELECT doc_id, template, license, word, count(DISTINCT gram) / any_value(size) AS share FROM hits
  GROUP BY doc_id, template, license, word HAVING share >= 0.8::DOUBLE)
SELECT doc_id, license, arg_max(template, (share, -word, -template)) AS template, max(share) AS containment,
  arg_max(word, (share, -word, -template)) AS word, count(*) AS n_windows
FROM windows GROUP BY doc_id, license"""

SUFFIX_DEDUP = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM bytes WHERE length(h) >= 100)),
firsts AS (SELECT s, min(doc_id) AS owner FROM strings GROUP BY s HAVING count(DISTINCT doc_id) > 1),
starts AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM strings JOIN firsts USING (s) WHERE owner < doc_id),
numbered AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY i) AS span FROM starts),
spans AS (SELECT doc_id, min(i) AS low, max(i) + 50 AS high,
  coalesce(lag(max(i) + 50) OVER (PARTITION BY doc_id ORDER BY min(i)), 0) AS after
  FROM numbered GROUP BY doc_id, span),
removed AS (SELECT doc_id, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans, max(high) AS last,
  string_agg(substr(h, 2 * after + 1, 2 * (low - after)), '' ORDER BY low) AS head
  FROM spans JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(concat(coalesce(head, ''), substr(h, 2 * coalesce(last, 0) + 1)))) AS kept_sha256
FROM bytes LEFT JOIN removed USING (doc_id)"""

QUALITY_RULES = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS host_name, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM again, range(5) r(j) GROUP BY doc_id),
facts AS (SELECT doc_id, host_name, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM texts LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  base_failed OR n_symbols > 0.5 * n_words OR n_dup_lines > 0.5 * n_lines OR word_chars < 2 * n_words
    OR word_chars > 15 * n_words AS rule_failed FROM facts),
hosts AS (SELECT host_name, count(*) AS host_docs, CAST(count_if(rule_failed) AS BIGINT) AS host_failed FROM judged GROUP BY host_name),
total AS (SELECT sum(host_docs) AS n, sum(host_failed) / sum(host_docs) AS m,
  sum(host_failed * host_failed / host_docs) - sum(host_docs) * pow(sum(host_failed) / sum(host_docs), 2)
    - (count(*) - 1) * (sum(host_failed) / sum(host_docs)) * (1 - sum(host_failed) / sum(host_docs)) AS spread,
  sum(host_docs) - sum(host_docs * host_docs) / sum(host_docs) AS scale FROM hosts),
prior AS (SELECT m, least(greatest(CASE WHEN scale > 0 AND spread > 0 THEN m * (1 - m) / (spread / scale) - 1 ELSE 1e4 END, 2), 1e4) AS weight FROM total),
verdicts AS (SELECT host_name, host_docs, host_failed, (host_failed + m * weight) / (host_docs + weight) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate < 0.8 AND (rate < 0.5 OR NOT rule_failed) AS kept, host_name, host_docs, host_failed,
  CASE WHEN rate >= 0.8 THEN 'bad' WHEN rate >= 0.5 THEN 'suspect' ELSE 'good' END AS host_verdict
FROM judged JOIN verdicts USING (host_name)"""

URL_RULES = r"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(domain, start, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fitting AS (SELECT page_id, arg_max({'rule': concat(domain, start), 'verdict': verdict}, length(concat(domain, start))) AS best
  FROM parts JOIN rules ON (host = domain OR ends_with(host, concat('.', domain))) AND starts_with(path, start) GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule, best.verdict AS verdict FROM parts LEFT JOIN fitting USING (page_id)"""

# crc32 of the id's digits, bit by bit; words of every tenth text repeat up to its end.
PERIODIC_RUNS = r"""
WITH texts AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
hashed AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, xor(4294967295, list_reduce(
    list_transform(range(8 * length(d)), lambda k: CASE WHEN k % 8 = 0 THEN CAST(ascii(d[k // 8 + 1]) AS BIGINT) ELSE 0 END),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), CAST(4294967295 AS BIGINT))) AS h FROM texts),
placed AS (SELECT *, h // 10 % greatest(n, 1) AS a, 1 + (n - h // 10 % greatest(n, 1)) // (3 + h // 10 % 8) AS p FROM hashed),
given AS (SELECT doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END]) AS w
  FROM placed),
places AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS gram FROM (SELECT *, unnest(range(n - 4)) AS i FROM given WHERE n > 4)),
met AS (SELECT x.doc_id, x.i, x.i - y.i AS lag FROM places x JOIN places y USING (doc_id, gram) WHERE y.i < x.i AND 4 * (x.i - y.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM met),
stretches AS (SELECT doc_id, lag, min(i) - lag AS start, max(i) + 5 - min(i) + lag AS length FROM islands GROUP BY doc_id, lag, island),
runs AS (SELECT doc_id, start, length, min(lag) AS period FROM stretches WHERE length >= greatest(6, 4 * lag) GROUP BY doc_id, start, length),
totals AS (SELECT doc_id, count(*) AS n_runs, arg_max({'s': start, 'n': length, 'p': period}, (length, -start, -period)) AS best,
  string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id),
word AS (SELECT doc_id, i, w[i + 1] AS word FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM given)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM word
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = word.doc_id AND i >= r.start + r.period AND i < r.start + r.length) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.p AS period, 1000 * best.n // best.p AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM given LEFT JOIN totals USING (doc_id) LEFT JOIN kept USING (doc_id)"""

# One pair of tables per round: vectors with their centroid, and the centroids they move.
_DISTANCE = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_ASSIGNED = (
    "a{0} AS MATERIALIZED (SELECT vec_id, v.x, min({{'distance': %s, 'cluster': c.cluster}}) AS best "
    "FROM v, c{0} c GROUP BY vec_id, v.x)" % _DISTANCE
)
_MOVED = """c{1} AS MATERIALIZED (SELECT cluster, coalesce(m.x, c.x) AS x FROM c{0} c LEFT JOIN (
  SELECT cluster, list((total - (total % n + n) % n) // n ORDER BY i) AS x FROM (
    SELECT cluster, i, sum(y) AS total, count(*) AS n FROM (
      SELECT best.cluster, unnest(x) AS y, unnest(range(64)) AS i FROM a{0}) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))"""
CENTROID_CLUSTERS = (
    """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('2:', vec_id))) - 1 AS cluster, x FROM v
  QUALIFY cluster < 40),
"""
    + ",\n".join(part.format(n, n + 1) for n in range(5) for part in (_ASSIGNED, _MOVED))
    + ",\n"
    + _ASSIGNED.format(5)
    + """
SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, CAST(best.distance AS BIGINT) AS distance,
  CAST(sum(best.distance) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON c5.cluster = best.cluster"""
)

SQL = {
    "op1_license_scan": LICENSE_SCAN,
    "op2_suffix_dedup": SUFFIX_DEDUP,
    "url_rules": URL_RULES,
    "op10_quality_rules": QUALITY_RULES,
    "op11_periodic_runs": PERIODIC_RUNS,
    "op13_centroid_clusters": CENTROID_CLUSTERS,
}
