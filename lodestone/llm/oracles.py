"""DuckDB statements that give the rows of the corpus queries from the same tables."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"

_OP1 = f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS g
  FROM w, unnest(range(1, greatest(len(ws) - 11, 1))) AS t(i)),
seen AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY g) AS dup FROM win),
gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM seen, unnest(range(0, 13)) AS t(k) WHERE dup),
word AS (SELECT doc_id, p, ws[p] AS x FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (
  SELECT word.doc_id, string_agg(word.x, ' ' ORDER BY word.p) AS kept, count(*) AS n
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

#: For tables whose links are absolute urls without dot segments.
_OP5 = r"""
WITH RECURSIVE tag AS (
  SELECT url AS u, unnest(regexp_extract_all(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>|<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is')) AS t
  FROM pages WHERE html IS NOT NULL),
link AS (SELECT u, replace(regexp_extract(t, '(?:\bhref\s*=\s*["'']?|\burl\s*=\s*[''"]?)([^"''\s>]+)', 1, 'is'), '&amp;', '&') AS v FROM tag),
part AS (
  SELECT url,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^?#]*(\?[^#]*)', 1) AS query
  FROM (SELECT url FROM pages UNION SELECT v FROM link)),
node AS (SELECT *, host || CASE WHEN host <> '' AND path = '' THEN '/' ELSE path END || query AS node FROM part),
r(verdict, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hit AS (
  SELECT host, path, max_by(h || q, length(h || q)) AS rule, max_by(verdict, length(h || q)) AS verdict
  FROM (SELECT DISTINCT host, path FROM node) d JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY host, path),
edge AS (
  SELECT DISTINCT a.node AS x, b.node AS y FROM link JOIN node a ON a.url = u JOIN node b ON b.url = v
  WHERE v LIKE '%://%' AND a.host <> '' AND b.host <> ''),
both_ways AS (SELECT x, y FROM edge UNION SELECT y, x FROM edge),
reach AS (SELECT x, y FROM both_ways UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON reach.y = b.x),
spread AS (
  SELECT x, min(verdict) AS spread FROM reach JOIN node ON node.node = reach.y JOIN hit ON hit.host = node.host AND hit.path = node.path GROUP BY x)
SELECT page_id, n.host, n.path, hit.rule, coalesce(hit.verdict, spread, 'allow') AS verdict
FROM pages p JOIN node n ON n.url IS NOT DISTINCT FROM p.url LEFT JOIN hit ON n.host = hit.host AND n.path = hit.path LEFT JOIN spread ON spread.x = n.node
"""

_OP9 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, i, i + 4), ' ') END AS s
  FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON reach.y = b.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m, w.doc_id) AS component_id, coalesce(m, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) USING (doc_id)
"""

_OP12 = _OP9.replace(">= 75 *", ">= 80 *").replace(", coalesce(m, w.doc_id) = w.doc_id AS kept", "")

_OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

#: The table of the cyclic redundancy check is made from its polynomial; bytes are read from hexadecimal digits.
_OP11 = r"""
WITH RECURSIVE
k(i, c, step) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM k WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM k WHERE step = 8),
texts AS (SELECT 0 AS side, row_number() OVER () AS id, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (
  SELECT side, id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM texts),
f AS (
  SELECT side, id, array_to_string(list_slice(ws, i, i + o - 1), ' ') AS f
  FROM w, unnest([1, 2, 3]) AS a(o), unnest(range(1, greatest(len(ws) - o + 2, 1))) AS t(i)),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
bucket AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda j: ('0x' || substr(x, j, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM h, crc),
fb AS (SELECT side, id, b FROM f JOIN bucket USING (f)),
n AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM fb GROUP BY b),
total AS (SELECT sum(s) AS ss, sum(t) AS tt FROM n),
gain AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain FROM n, total),
weight AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS weight FROM fb JOIN gain USING (b) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT w.id, doc_id, len(ws) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weight ON weight.id = w.id WHERE side = 0),
placed AS (
  SELECT id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS total FROM scored WHERE words >= 20 AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * total // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (id)
"""

_OP13 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, ''))::BIGINT AS n,
    list_transform(range(4), lambda k: ('0x' || substr(sha256('1:' || doc_id::VARCHAR), 8 * k + 1, 8))::BIGINT) AS h FROM documents),
c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR coalesce(h[3] % 100 >= 90, true) THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(x, 1, a) AS pre, substr(x, a + 1, b - a) AS mid, substr(x, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM p
"""

ORACLES: dict[str, str] = {"op3_exact_top_k": _OP3, "op9_minhash_near_dedup": _OP9, "op1_substring_dedup": _OP1, "op5_url_filters": _OP5, "op11_importance_resampling": _OP11, "op12_jaccard_join": _OP12, "op13_fill_in_middle": _OP13}
