"""Queries of the text, page and entity operators over the test tables, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agendum.catalog import table
from agendum.functions import editorial as ed
from agendum.functions import text as tx
from agendum.functions import web
from agendum.operators import gazetteer
from agendum.operators import entities

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_FOLD = "lower(translate(text, '" + tx.ACCENTED.replace("'", "''") + "', '" + tx.PLAIN + "'))"
_FOLDED = f"replace(replace(replace(regexp_replace({_FOLD}, '[\\x{{0300}}-\\x{{036f}}]', '', 'g'), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')"
_KEY = f"trim(regexp_replace({_FOLDED}, '[^a-z0-9]+', ' ', 'g'))"


@query(f"""
SELECT folded, doc_id, n, first_doc FROM (SELECT md5({_KEY}) AS folded, doc_id, count(*) OVER (PARTITION BY md5({_KEY})) AS n, min(doc_id) OVER (PARTITION BY md5({_KEY})) AS first_doc FROM documents) WHERE n > 1
""")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each member, so that no group is gathered."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.folded_key(F.col("text"))).alias("folded"))
    groups = docs.groupBy("folded").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")
    return docs.join(groups, "folded").select("folded", "doc_id", "n", "first_doc")


_HITS = {n: f"len(list_filter(string_split({_KEY}, ' '), lambda w: w IN ({', '.join(repr(w) for w in lex)})))" for n, lex in tx.FUNCTION_WORDS.items()}


@query(f"SELECT doc_id, {', '.join(f'{h} AS hits_{n}' for n, h in _HITS.items())} FROM documents")
def lang_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.language_hits(F.col("text")).alias("hits"))
    scores = tx.language_scores(F.col("hits"))
    return docs.select("doc_id", *[s.cast("long").alias(f"hits_{n}") for n, s in scores.items()])


@query(f"""
WITH h AS (SELECT doc_id, lang, {', '.join(f'{h} AS {n}' for n, h in _HITS.items())} FROM documents),
r AS (SELECT doc_id, lang, list_reverse_sort([{{'s': en, 'n': 'en'}}, {{'s': de, 'n': 'de'}}, {{'s': fr, 'n': 'fr'}}, {{'s': es, 'n': 'es'}}]) AS o, en + de + fr + es AS total FROM h)
SELECT lang, coalesce(CASE WHEN total >= 15 AND o[1].s >= 2 * o[2].s THEN o[1].n END, 'undecided') AS decided, count(*) AS n FROM r GROUP BY 1, 2
""")
def lang_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", tx.language_hits(F.col("text")).alias("hits"))
    verdict = F.coalesce(tx.decided_language(tx.language_scores(F.col("hits"))), F.lit("undecided"))
    return docs.select("lang", verdict.alias("decided")).groupBy("lang", "decided").agg(F.count(F.lit(1)).alias("n"))


_SENTENCES = r"list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"


@query(rf"""
SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words, len({_SENTENCES}) AS sentences, len(list_filter({_SENTENCES}, lambda s: len(regexp_extract_all(s, '\S+')) > 20)) AS long_sentences FROM documents
""")
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[c.cast("long").alias(n) for n, c in tx.readability(F.col("text")).items()])


#: Names of the corpus: the first two words of every document, and its third alone if it is long.
_TOKENS = "SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+') AS w FROM documents"
_PLAIN = "replace(replace(replace(lower(strip_accents({c})), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')"
_PLACES = f"""SELECT DISTINCT {_PLAIN.format(c="w[1] || ' ' || w[2]")} AS name, 2 AS size FROM t WHERE len(w) >= 2 UNION SELECT DISTINCT {_PLAIN.format(c='w[3]')}, 1 FROM t WHERE length(w[3]) >= 9"""


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    start = F.regexp_extract(F.coalesce("text", F.lit("")), r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++){1,6}", 0)  # no query looks at more words
    docs = table(spark, sf_dir, "documents").withColumn("w", F.regexp_extract_all(start, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    pairs = docs.filter(F.size("w") >= 2).select(F.array_join(F.slice("w", 1, 2), " ").alias("name"))
    long = docs.filter(F.length(F.get("w", F.lit(2))) >= 9).select(F.get("w", F.lit(2)).alias("name"))
    return docs, pairs.unionByName(long)


@query(f"""
WITH t AS ({_TOKENS}), p AS ({_PLACES}),
u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
r AS (SELECT doc_id, i, 1 AS size, {_PLAIN.format(c='w[i]')} AS name, w[i][1] AS c FROM u UNION ALL SELECT doc_id, i, 2, {_PLAIN.format(c="w[i] || ' ' || w[i + 1]")}, w[i][1] FROM u WHERE i < len(w))
SELECT doc_id, r.name, count(*) AS n, sum(i - 1) AS places, count(*) FILTER (upper(c) = c AND lower(c) <> c) AS capitals FROM r JOIN p ON r.name = p.name AND r.size = p.size GROUP BY doc_id, r.name
""")
def names_with_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every name in every document, added up by document and name."""
    docs, places = _places(spark, sf_dir)
    return gazetteer.names_counted(docs, "doc_id", "text", places, "name")


@query(f"""
WITH t AS ({_TOKENS}), p AS ({_PLACES}),
d AS (SELECT doc_id, text, w, CASE WHEN doc_id % 3 = 0 THEN 'qqqq zzzz' ELSE array_to_string(w[1:6], ' ') END AS title, CASE WHEN len(w) >= 2 THEN CASE doc_id % 4 WHEN 0 THEN w[1] || ' ' || w[2] WHEN 1 THEN NULL ELSE 'Nowhere ' || doc_id END END AS town FROM t),
u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
r AS (SELECT doc_id, 1 AS size, {_PLAIN.format(c='w[i]')} AS name, w[i][1] AS c FROM u UNION ALL SELECT doc_id, 2, {_PLAIN.format(c="w[i] || ' ' || w[i + 1]")}, w[i][1] FROM u WHERE i < len(w)),
f AS (SELECT DISTINCT doc_id, r.name FROM r JOIN p ON r.name = p.name AND r.size = p.size WHERE upper(c) = c AND lower(c) <> c),
o AS (SELECT *, coalesce(array_to_string(regexp_extract_all({_PLAIN.format(c='town')}, '[a-z0-9]+'), ' '), '') AS own, ' ' || array_to_string(regexp_extract_all({_PLAIN.format(c="coalesce(text, '')")}, '[a-z0-9]+'), ' ') || ' ' AS line,
  list_distinct(list_filter(regexp_extract_all({_PLAIN.format(c="concat_ws(' ', title, town)")}, '[a-z0-9]+'), lambda x: length(x) >= 4)) AS who FROM d),
e AS (SELECT f.doc_id, list_sort(list(f.name)) AS others FROM f JOIN o ON f.doc_id = o.doc_id WHERE own <> '' AND NOT contains(own, f.name) AND NOT contains(f.name, own) GROUP BY f.doc_id),
s AS (
  SELECT o.doc_id, others, others IS NOT NULL AND NOT contains(line, ' ' || own || ' ') AS away,
    trim(coalesce(text, '')) <> '' AND len(who) > 0 AND NOT list_has_any(who, list_filter(string_split(line, ' '), lambda x: length(x) >= 4)) AS foreign_text
  FROM o LEFT JOIN e ON o.doc_id = e.doc_id)
SELECT doc_id, CASE WHEN away THEN array_to_string(others[1:3], ', ') END AS elsewhere, CASE WHEN away AND foreign_text THEN 'blocked' WHEN away THEN 'elsewhere' WHEN foreign_text THEN 'foreign' ELSE 'silent' END AS verdict FROM s
""")
def text_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents tell of their titles and towns; every third title is strange, and only every fourth town is named."""
    docs, places = _places(spark, sf_dir)
    first = lambda n: F.array_join(F.slice("w", 1, n), " ")
    town = F.when(F.size("w") >= 2, F.when(F.col("doc_id") % 4 == 0, first(2)).when(F.col("doc_id") % 4 != 1, F.concat(F.lit("Nowhere "), F.col("doc_id"))))
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "qqqq zzzz").otherwise(first(6)).alias("title"), town.alias("town"))
    return gazetteer.coherence(rows, places, "doc_id", "text", ["title", "town"], "town", "name")


TERMS = ["worthless", "disgusting", "trash", "scum", "stupid", "idiot"]


_EDGE = r"[^\p{L}\p{M}\p{N}]"
_FOUND = ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|{_EDGE}){t}($|{_EDGE})') THEN '{t}' END" for t in TERMS)


@query(f"SELECT doc_id, array_to_string(list_filter(t, lambda w: w IS NOT NULL), ',') AS terms FROM (SELECT doc_id, [{_FOUND}] AS t FROM documents) WHERE len(list_filter(t, lambda w: w IS NOT NULL)) > 0")
def forbidden_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", tx.found_terms(F.col("text"), TERMS).alias("t"))
    return found.filter(F.size("t") > 0).select("doc_id", F.array_join("t", ",").alias("terms"))


@query(r"""
SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS raw_title, len(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS n_links,
  len(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1))) AS n_targets FROM pages
""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    raw = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", raw.alias("raw_title"), F.size(web.links(html)).cast("long").alias("n_links"), F.size(F.array_distinct(web.links(html))).cast("long").alias("n_targets"))


_OPEN = "x"
for _e, _c in web.ENTITIES:
    _OPEN = f"replace({_OPEN}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"


@query(rf"""
WITH s AS (
  SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS x FROM pages)
SELECT page_id, md5(trim(regexp_replace({_OPEN}, '[\s\x{{A0}}]+', ' ', 'g'))) AS text_md5, length(trim(regexp_replace({_OPEN}, '[\s\x{{A0}}]+', ' ', 'g'))) AS n_chars FROM s
""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", web.visible_text(F.col("html")).alias("t"))
    return pages.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


#: What a page's row holds: its navigation, its page, its page with a feed's address, or nothing; and what is found again: the navigation or the page.
_HELD = r"CASE page_id % 4 WHEN 0 THEN regexp_extract(html, '(?is)<nav>.*?</nav>') WHEN 1 THEN html WHEN 2 THEN html || ' https://feeds.example.org/RSS/7' ELSE '' END"
_AGAIN = r"CASE WHEN page_id % 3 = 0 THEN regexp_extract(html, '(?is)<nav>.*?</nav>') ELSE html END"
_SEEN = rf"length(trim(regexp_replace({_OPEN}, '[\s\x{{A0}}]+', ' ', 'g')))"
_BARE = r"regexp_replace(regexp_replace({c}, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query(f"""
WITH d AS (SELECT page_id, {_HELD} AS old, {_AGAIN} AS new FROM pages),
o AS (SELECT page_id, {_SEEN} AS seen FROM (SELECT page_id, {_BARE.format(c='old')} AS x FROM d)), n AS (SELECT page_id, {_SEEN} AS seen FROM (SELECT page_id, {_BARE.format(c='new')} AS x FROM d)),
c AS (
  SELECT d.page_id, n.seen AS n_new, o.seen AS n_old, CASE WHEN page_id % 8 = 5 THEN 'incoherent' WHEN trim(old) = '' THEN NULL WHEN contains(lower(old), 'feeds.example.org/rss') THEN 'feed link' WHEN length(old) >= 200 AND o.seen < 120 THEN 'hollow' END AS cause
  FROM d JOIN o USING (page_id) JOIN n USING (page_id))
SELECT page_id, cause, cause IS NOT NULL AND n_new >= 80 AND CASE WHEN cause = 'incoherent' THEN page_id % 16 <> 5 ELSE n_new > n_old END AS accepted FROM c
""")
def polluted_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose descriptions lost their substance, and whether what the page holds now takes their place."""
    nav, html, key = F.regexp_extract("html", r"(?is)<nav>.*?</nav>", 0), F.col("html"), F.col("page_id")
    old = F.when(key % 4 == 0, nav).when(key % 4 == 1, html).when(key % 4 == 2, F.concat(html, F.lit(" https://feeds.example.org/RSS/7"))).otherwise("")
    rows = table(spark, sf_dir, "pages").select("page_id", old.alias("old"), F.when(key % 3 == 0, nav).otherwise(html).alias("new"))
    cause = F.when(key % 8 == 5, "incoherent").otherwise(ed.pollution(F.col("old"), ["feeds.example.org/rss"]))
    rows = rows.withColumn("cause", cause)
    return rows.select("page_id", "cause", ed.accepted(F.col("cause"), F.col("old"), F.col("new"), key % 16 == 5).alias("accepted"))


@query(r"""
WITH p AS (SELECT regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT CASE WHEN path IN ('', '/') THEN 'home' WHEN regexp_matches(path, '^/[a-z]{2}/?$') THEN 'language home' WHEN regexp_matches(path, '\.html?$') THEN 'page' WHEN regexp_matches(path, '/\d+/?$') THEN 'item' ELSE 'other' END AS family,
  count(*) AS n FROM p GROUP BY 1
""")
def url_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(web.url_family(F.col("url")).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""
WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS bare FROM pages),
k AS (SELECT page_id, regexp_replace(bare, '\?.*$', '') AS base,
  array_to_string(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '{web.TRACKING}')), '&') AS q FROM u)
SELECT page_id, CASE WHEN q = '' THEN base ELSE base || '?' || q END AS clean_url FROM k
""")
def clean_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.without_tracking(F.col("url")).alias("clean_url"))


BLOCKED = ["example.net", "spam-farm.example.org"]


@query(f"""
SELECT page_id FROM pages WHERE NOT ({' OR '.join(f"regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) = '{b}' OR suffix(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '.{b}')" for b in BLOCKED)})
""")
def host_suffix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = F.array(*[F.lit(b) for b in BLOCKED])
    hit = F.arrays_overlap(web.host_suffixes(web.host(F.col("url"))), blocked)
    return table(spark, sf_dir, "pages").filter(~F.coalesce(hit, F.lit(False))).select("page_id")


@query(r"""
SELECT conv_id, turn, substr(sha1(coalesce(role, '') || '|' || coalesce(text, '')), 1, 16) AS fingerprint FROM conversations
""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.fingerprint(F.col("role"), F.col("text")).alias("fingerprint"))


@query("""
WITH t AS (SELECT p_partkey AS id, p_brand, list_distinct(string_split(p_name, ' ')) AS w FROM part)
SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS shared FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.id < b.id WHERE len(list_intersect(a.w, b.w)) >= 2
""")
def title_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return entities.token_pairs(parts, "id", F.split("p_name", " "), ["p_brand"], 2).withColumn("shared", F.col("shared").cast("long"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, 100000000 + l_suppkey AS b FROM lineitem), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
w(node, root) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM s
  UNION SELECT s.b, min(w.root) FROM w JOIN s ON w.node = s.a JOIN recurring.w AS own ON own.node = s.b GROUP BY s.b, own.root HAVING min(w.root) < own.root)
SELECT node, root FROM w
""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return entities.components(lines.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 100_000_000).alias("b")))


@query("""
WITH r AS (SELECT c_nationkey, c_custkey, c_name, c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS k FROM customer)
SELECT c_nationkey, arg_min(c_custkey, k) AS c_custkey, arg_min(balance, k) FILTER (balance IS NOT NULL) AS balance, count(*) AS members FROM r GROUP BY c_nationkey
""")
def merge_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_mktsegment", "c_acctbal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    out = entities.merge_winner(rows, "c_nationkey", [F.asc("c_mktsegment"), F.desc("c_acctbal"), F.asc("c_custkey")], ["balance"])
    return out.select("c_nationkey", "c_custkey", "balance", "members")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 60 AS e FROM orders),
m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o)
SELECT o_custkey, o_orderkey, CAST(sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS BIGINT) AS part FROM m
""")
def period_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("s"), F.date_add(F.col("o_orderdate").cast("date"), 60).alias("e"))
    return entities.period_groups(orders, "o_custkey", "o_orderkey", "s", "e").select("o_custkey", "o_orderkey", "part")
