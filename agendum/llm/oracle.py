"""The queries' rows in DuckDB's SQL."""

from agendum.llm.licenses import PHRASES, TEMPLATES

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

URLS = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
t(h, b, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, h || b AS rule, t.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || b) DESC) AS n
  FROM p JOIN t ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, b))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND n = 1
"""

JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM d WHERE len(w) > 0),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM k JOIN c p ON x = p.doc_id JOIN c q ON y = q.doc_id WHERE 10 * k.n >= 8 * (p.n + q.n - k.n)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
walk AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT walk.x, l.y FROM walk JOIN l ON walk.y = l.x)
SELECT r.x AS doc_id, min(r.y) AS class_id, max(coalesce(f.n, 0)) AS n_links
FROM walk r LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) f ON r.x = f.x GROUP BY r.x
"""

REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
o AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM o),
s AS (SELECT doc_id, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM s) GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
y AS (SELECT doc_id, unnest(gone) AS i FROM g),
z AS (SELECT x.doc_id, array_to_string(list(t ORDER BY x.i), ' ') AS kept, count(*) AS n FROM x ANTI JOIN y ON x.doc_id = y.doc_id AND x.i = y.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN z ON d.doc_id = z.doc_id
"""

_LICENSES = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(phrase, label) AS (VALUES {phrases}),
t(no, words, label) AS (VALUES {templates}),
a AS (SELECT doc_id, phrase, label, unnest(range(0, len(w) - len(string_split(phrase, ' ')) + 1)) AS pos, w FROM d, p WHERE list_has_all(w, string_split(phrase, ' '))),
f AS (SELECT doc_id, pos, label FROM a WHERE array_to_string(w[pos + 1:pos + len(string_split(phrase, ' '))], ' ') = phrase),
b AS (
  SELECT doc_id, i, list_distinct(w[i * 24 + 1:i * 24 + 48]) AS s FROM (SELECT doc_id, unnest(range(0, (len(w) + 23) // 24)) AS i, w FROM d)),
k AS (SELECT doc_id, i, no, label, list_intersect(list_distinct(string_split(words, ' ')), s) AS shared, len(list_distinct(string_split(words, ' '))) AS size FROM b, t),
m AS (SELECT * FROM k WHERE 10 * len(shared) >= 9 * size),
y AS (
  SELECT DISTINCT doc_id, label FROM m
  WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND o.i = m.i AND len(o.shared) > len(m.shared) AND list_has_all(o.shared, m.shared))),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM f UNION SELECT doc_id, label FROM y) GROUP BY doc_id),
best AS (SELECT doc_id, max(len(shared) / size) AS score FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0)::DOUBLE END AS score
FROM d LEFT JOIN base ON d.doc_id = base.doc_id LEFT JOIN every ON d.doc_id = every.doc_id LEFT JOIN best ON d.doc_id = best.doc_id
"""


def _rows(pairs, numbered: bool) -> str:
    return ", ".join("(" + (f"{n}, " if numbered else "") + f"'{a}', '{b}')" for n, (a, b) in enumerate(pairs))


LICENSES = _LICENSES.format(phrases=_rows(PHRASES.items(), False), templates=_rows(TEMPLATES.items(), True))

AUDIT = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY x) AS least FROM t),
q AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN q ON w.doc_id = q.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM m GROUP BY part, fails),
f(letter) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT '' AS names UNION ALL SELECT names || letter FROM o JOIN f ON position(letter IN names) = 0),
s AS (SELECT names AS filter_order, i AS step, names[i] AS own, names[1:i - 1] AS before FROM (SELECT names, unnest(range(1, 6)) AS i FROM o WHERE length(names) = 5)),
j AS (
  SELECT c.*, s.*, position(own IN fails) > 0 AS own_fails, length(translate(fails, before, '')) < length(fails) AS gone FROM c, s),
e AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT own_fails), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (NOT gone AND own_fails), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (gone AND own_fails), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n_good) FILTER (NOT gone AND own_fails), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n_toxic) FILTER (NOT gone AND own_fails), 0) AS BIGINT) AS toxic_lost
  FROM j GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM e
"""

#: From the rows l (key, pos, n, node) of trees the nodes of all levels, then for each run of a level what stands left and right of a node.
_TREE = """
nodes{k} AS (
  SELECT tree, 0 AS level, pos, n, node FROM leaves{k}
  UNION ALL
  SELECT tree, level + 1, pos // 8, max((n + 7) // 8), sha256(string_agg(node, '' ORDER BY pos)) FROM nodes{k} WHERE n > 1 GROUP BY tree, level, pos // 8),
sides{k} AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes{k} a JOIN nodes{k} b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos)"""

MANIFEST = r"""
WITH RECURSIVE bits AS (
  SELECT doc_id, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(d) + 1), lambda i: CAST(ascii(d[i]) AS BIGINT))), lambda crc, x:
    list_reduce(list_prepend(xor(crc, x), [CAST(0 AS BIGINT) for k in range(8)]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
  FROM (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS d FROM documents WHERE doc_id IS NOT NULL)),
d AS (
  SELECT documents.*, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed
  FROM documents LEFT JOIN bits ON documents.doc_id = bits.doc_id),
h AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, sha256(head || {text}) AS node, sha256(head || {changed}) AS now
  FROM (SELECT *, {doc_id} || {source} || {lang} || {n_chars} AS head FROM d)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM h),
leaves0 AS (SELECT tree, pos, n, node FROM leaves),{parts},
subs AS (SELECT tree AS part, node FROM nodes0 WHERE n = 1),
leaves1 AS (SELECT '' AS tree, row_number() OVER (ORDER BY encode(part)) - 1 AS pos, count(*) OVER () AS n, node, part FROM subs),{whole},
walk0 AS (
  SELECT doc_id, tree, node AS leaf, 0 AS level, pos, '' AS proof, now AS folded FROM leaves
  UNION ALL
  SELECT doc_id, w.tree, leaf, w.level + 1, w.pos // 8, proof || l || r, sha256(l || folded || r) FROM walk0 w JOIN sides0 s ON w.tree = s.tree AND w.level = s.level AND w.pos = s.pos),
walk1 AS (
  SELECT doc_id, w.tree, leaf, 0 AS level, p.pos, proof, folded FROM walk0 w JOIN nodes0 t ON w.tree = t.tree AND w.level = t.level AND w.pos = t.pos AND t.n = 1 JOIN leaves1 p ON p.part = w.tree
  UNION ALL
  SELECT doc_id, w.tree, leaf, w.level + 1, w.pos // 8, proof || l || r, sha256(l || folded || r) FROM walk1 w JOIN sides1 s ON w.level = s.level AND w.pos = s.pos)
SELECT doc_id, leaf, s.node AS subroot, t.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.node AS verified
FROM walk1 w JOIN nodes1 t ON w.level = t.level AND w.pos = t.pos AND t.n = 1 JOIN subs s ON s.part = w.tree
"""


def _field(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END)"


MANIFEST = MANIFEST.format(parts=_TREE.format(k=0), whole=_TREE.format(k=1), **{c: _field(c) for c in ("doc_id", "source", "lang", "n_chars", "text", "changed")})

ORACLE = {
    "op1_ball_tree_top_k": TOP_K,
    "op3_license_scan": LICENSES,
    "op6_url_filter": URLS,
    "op8_ngram_jaccard": JACCARD,
    "op10_substring_dedup": REPEATS,
    "op11_filter_audit": AUDIT,
    "op13_merkle_manifest": MANIFEST,
}
