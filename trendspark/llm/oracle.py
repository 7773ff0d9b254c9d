"""DuckDB counterparts of the operator queries."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN strlen(html) >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 1000 AND page_id < first THEN first END AS refers_to
FROM q
"""

URL_FILTERS = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r(action, rule_host, rule_path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(action, length(rule_host || rule_path)) AS action
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""

#: Windows of ten words by list slices; hit places by expanding every match.
DECONTAMINATION = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, len(x) AS n, array_to_string(x, ' ') AS x FROM (
    SELECT item, unnest([w[i:i + 9] FOR i IN range(1, greatest(1, len(w) - 9) + 1)]) AS x FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, dw.n, i, item FROM dw JOIN bw ON dw.x = bw.x AND dw.n = bw.n),
h AS (
  SELECT r, count(*) AS n_hit FROM (
    SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
""".replace("{UPPER}", UPPER).replace("{LOWER}", LOWER)

SUBSTRING_DEDUP = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
x AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
many AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM x SEMI JOIN many USING (h)) GROUP BY r),
word AS (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
lost AS (SELECT DISTINCT r, unnest(ps) AS p FROM gone),
kept AS (
  SELECT r, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS k FROM word ANTI JOIN lost USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT r, unnest([hash(array_to_string(w[i:i + 3], ' ')) FOR i IN range(1, greatest(1, len(w) - 3) + 1)]) AS x
  FROM d WHERE len(w) > 0),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
df AS (SELECT x, count(*) AS c FROM s GROUP BY x),
-- Links share one of the rarest shingles: 1 + 15 % of a set, in one order for all.
p AS MATERIALIZED (
  SELECT r, x FROM (
    SELECT r, x, row_number() OVER (PARTITION BY r ORDER BY c, x) AS k FROM s JOIN df USING (x)) JOIN n USING (r)
  WHERE 100 * (k - 1) <= 15 * n.n),
cand AS (SELECT DISTINCT a.r AS a, b.r AS b FROM p a JOIN p b ON a.x = b.x AND a.r < b.r),
link AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT a, b, count(*) AS i FROM cand JOIN s sa ON sa.r = a JOIN s sb ON sb.r = b AND sa.x = sb.x GROUP BY a, b)
  JOIN n na ON na.r = a JOIN n nb ON nb.r = b
  WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (r) JOIN (
  SELECT reach.a AS r, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = reach.b GROUP BY reach.a) c USING (r)
""".replace("{UPPER}", UPPER).replace("{LOWER}", LOWER)

ORACLE = {"op8_jaccard_join": JACCARD, "op6_substring_dedup": SUBSTRING_DEDUP, "op1_decontamination": DECONTAMINATION, "op2_warc": WARC, "op9_url_filters": URL_FILTERS}
