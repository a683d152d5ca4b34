"""Queries of lists, queues, registers and repairs over a catalogue made of the orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agendum.catalog import table
from agendum.functions import catalogue, scoring, web
from agendum.functions import editorial as ed
from agendum.functions import text as tx
from agendum.operators import aggregates
from agendum.operators import matching
from agendum.operators import worklists as wl

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


_EVENTS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey - o_orderkey % 3 END AS parent,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'published' ELSE 'rejected' END AS status, o_orderpriority AS territory, 'Fair ' || o_custkey AS title, o_orderkey % 7 <> 0 AS image,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS s, CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) END AS e,
  o_orderkey % 101 = 0 AS featured, nullif(o_orderkey % 23, 0) AS position, CAST(coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 11 END, floor(o_totalprice / 50000)) AS BIGINT) AS score,
  o_custkey % 4999 AS post, o_custkey, o_totalprice FROM orders"""
_ORDER = "featured DESC, coalesce(position, 999999), image DESC, score DESC, coalesce(s, DATE '9999-12-31'), id"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "published").otherwise("rejected")
    score = wl.effective_score(F.when(key % 4 == 0, key % 11), F.floor(F.col("o_totalprice") / 50_000))
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.when(key % 3 != 0, key - key % 3).alias("parent"), status.alias("status"), F.col("o_orderpriority").alias("territory"), F.concat(F.lit("Fair "), "o_custkey").alias("title"),
        (key % 7 != 0).alias("image"), F.when(key % 17 != 0, day).alias("start"), F.when((key % 17 != 0) & (key % 5 != 0), F.date_add(day, (key % 40).cast("int"))).alias("end"),
        (key % 101 == 0).alias("featured"), F.nullif(key % 23, F.lit(0)).alias("position"), score.cast("long").alias("score"), (F.col("o_custkey") % 4999).alias("post"), "o_custkey", "o_totalprice",
    )


def _day(text: str):
    return F.lit(text).cast("date")


@query(f"""
WITH ev AS ({_EVENTS}), hit AS (SELECT id, parent FROM ev WHERE contains(lower(title), 'fair 7'))
SELECT id, status, score FROM ev WHERE status IN ('pending', 'published') AND territory IN ('1-URGENT', '2-HIGH', '5-LOW') AND image AND s IS NOT NULL
  AND coalesce(e, s) >= DATE '1996-01-01' AND s <= DATE '1998-01-31' AND id IN (SELECT id FROM hit UNION SELECT parent FROM hit WHERE parent IS NOT NULL)
""")
def faceted_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wl.list_filter(
        _events(spark, sf_dir), ["pending", "published"], ["1-URGENT", "2-HIGH", "5-LOW"], "Fair 7", with_image=True, dated=True, first=_day("1996-01-01"), last=_day("1998-01-31"),
    )
    return found.select("id", "status", "score")


@query(f"""
WITH p AS (SELECT id, row_number() OVER (ORDER BY {_ORDER}) AS place, count(*) OVER () AS n FROM ({_EVENTS}) WHERE status = 'pending')
SELECT id, CAST(place AS INTEGER) AS place, n > 300 AS truncated FROM p WHERE place <= 300
""")
def quality_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wl.first_page(_events(spark, sf_dir).filter("status = 'pending'"), wl.quality_order(), 300).select("id", "place", "truncated")


@query(f"""
WITH ev AS ({_EVENTS}), p AS (SELECT id FROM ev WHERE parent IS NULL ORDER BY {_ORDER} LIMIT 200)
SELECT p.id AS id, string_agg(CAST(k.id AS VARCHAR) || ':' || k.status, ',' ORDER BY k.id) AS twins FROM p LEFT JOIN ev k ON k.parent = p.id GROUP BY p.id
""")
def page_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    page = events.filter("parent is null").orderBy(*wl.quality_order()).limit(200)
    out = wl.with_twins(page, events, ["status"])
    return out.select("id", F.array_join(F.transform("twins", lambda t: F.concat(t["twin"].cast("string"), F.lit(":"), t["status"])), ",").alias("twins"))


@query(f"""
SELECT id, score, s AS start FROM ({_EVENTS}) WHERE status = 'pending' AND score >= 6 AND s > DATE '1997-06-01' AND NOT (parent IS NOT NULL) ORDER BY score DESC, s, id LIMIT 40
""")
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    needed = [F.col("status") == "pending", F.col("score") >= 6, F.col("start") > _day("1997-06-01"), F.col("parent").isNull()]
    return wl.work_queue(events, needed, [F.desc("score"), F.asc("start"), F.asc("id")], 40).select("id", "score", "start")


@query(f"""
WITH r AS (SELECT *, CASE WHEN contains(title, ' 13') THEN 'number' WHEN territory = '5-LOW' THEN 'low' END AS hit FROM ({_EVENTS}))
SELECT CASE WHEN status = 'pending' AND hit IS NOT NULL THEN 'rejected' ELSE status END AS status, CASE WHEN status = 'pending' THEN hit END AS reason, count(*) AS n FROM r GROUP BY 1, 2
""")
def retro_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = aggregates.first_reason([("number", F.contains("title", F.lit(" 13"))), ("low", F.col("territory") == "5-LOW")], None)
    out = wl.retro_clean(_events(spark, sf_dir), F.col("status") == "pending", reason)
    return out.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


PLACES = ["nation_1", "Nation_12", "NATION_2 centre", "nowhere", "tion_7"]
_TOWNS = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN n_name || ' nord' ELSE n_name END AS town, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_GEO = f"""
t AS (SELECT * FROM {_TOWNS}), k AS (SELECT DISTINCT town, lower(trim(town)) AS l FROM t), p AS (SELECT place, lower(trim(place)) AS p FROM (SELECT unnest({PLACES!r}) AS place)),
m AS (SELECT town, place FROM k JOIN p ON l = p OR (length(p) >= 5 AND contains(l, p)) OR (length(l) >= 5 AND contains(p, l)) QUALIFY row_number() OVER (PARTITION BY town ORDER BY l = p DESC, length(p) DESC, place DESC) = 1)
"""


def _towns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    town = F.when(F.col("c_custkey") % 5 == 0, F.concat("n_name", F.lit(" nord"))).otherwise(F.col("n_name"))
    towns = rows.select(F.col("c_custkey").alias("id"), town.alias("town"), "c_acctbal")
    return towns, spark.createDataFrame([(p,) for p in PLACES], "place string")


@query(f"WITH {_GEO} SELECT town, place FROM m")
def geo_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    towns, places = _towns(spark, sf_dir)
    return wl.geo_match(towns, places, "town", "place")


@query(f"WITH {_GEO} SELECT town, count(*) AS n, count(*) FILTER (c_acctbal > 5000) AS ready, count(*) FILTER (c_acctbal > 5000) >= 8 AS graduates FROM t ANTI JOIN m USING (town) GROUP BY town")
def geo_graduation(spark: SparkSession, sf_dir: str) -> DataFrame:
    towns, places = _towns(spark, sf_dir)
    return wl.graduation(towns, wl.geo_match(towns, places, "town", "place"), "town", F.col("c_acctbal") > 5000)


@query("""
WITH h AS (SELECT page_id, string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '.') AS labels FROM pages), n(name) AS (VALUES ('example'), ('org'), ('www'))
SELECT page_id, name AS town FROM (SELECT DISTINCT page_id, unnest(labels) AS label FROM h) JOIN n ON label = name
""")
def domain_towns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host labels meet the names of a list by equality."""
    names = spark.createDataFrame([("example",), ("org",), ("www",)], "town string")
    labels = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.split(web.host(F.col("url")), r"\."))).alias("town"))
    return labels.join(F.broadcast(names), "town").select("page_id", "town")


_SITES = "SELECT p_partkey AS id, p_brand, p_size, CASE WHEN p_type = 'PROMO' THEN 'site' || p_partkey END AS site FROM part"


@query(f"WITH e AS ({_SITES}) SELECT a.id AS id, arg_min(b.site, b.id) AS known FROM e a JOIN e b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.site IS NULL AND b.site IS NOT NULL GROUP BY a.id")
def known_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size", F.when(F.col("p_type") == "PROMO", F.concat(F.lit("site"), "p_partkey")).alias("site"))
    return wl.known_site(rows, [F.col("p_brand"), F.col("p_size")], "site")


@query(f"""
SELECT count(*) FILTER (DATE '1997-06-07' - s BETWEEN 0 AND 6) AS came, count(*) FILTER (DATE '1997-06-07' - e BETWEEN 0 AND 6) AS went, count(*) FILTER (DATE '1997-06-07' - e BETWEEN 0 AND 6 AND status = 'rejected') AS rejected FROM ({_EVENTS})
""")
def weekly_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wl.flow(_events(spark, sf_dir), "start", "end", F.col("status") == "rejected", _day("1997-06-07"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"))


@query(f"""
WITH w AS (SELECT unnest(generate_series(0, 26)) AS i), r AS (
  SELECT territory, DATE '1997-01-06' + CAST(7 * i AS INTEGER) AS day, id, score FROM ({_EVENTS}), w WHERE s - (DATE '1997-01-06' + CAST(7 * i AS INTEGER)) BETWEEN 0 AND 60),
h AS (SELECT territory, day, id FROM r QUALIFY row_number() OVER (PARTITION BY territory, day ORDER BY score DESC, id) = 1),
c AS (SELECT *, CASE WHEN lag(id) OVER p IS NOT DISTINCT FROM id THEN 0 ELSE 1 END AS new FROM h WINDOW p AS (PARTITION BY territory ORDER BY day)),
g AS (SELECT territory, sum(new) OVER (PARTITION BY territory ORDER BY day) AS run FROM c), n AS (SELECT territory, run, count(*) AS n FROM g GROUP BY ALL)
SELECT territory, max(n) AS longest_run, count(*) - 1 AS changes FROM n GROUP BY territory
""")
def weekly_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who would lead each territory on 27 Mondays to come."""
    rank = lambda day: F.when(F.datediff("start", day).between(0, 60), F.col("score"))
    return wl.head_runs(_events(spark, sf_dir).select("id", "territory", "start", "score"), ["territory"], _day("1997-01-06"), 27, rank)


@query("""
WITH m AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
n AS (SELECT *, min(pos) FILTER (event_type = 'purchase') OVER w AS next_head, min(pos) FILTER (event_type = 'signup') OVER w AS near FROM m WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT user_id, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN next_head IS NULL OR near < next_head THEN near END AS INTEGER) AS near FROM n WHERE event_type = 'purchase'
""")
def nearest_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"))
    return wl.nearest_below(marks, "user_id", "pos", F.col("event_type") == "purchase", F.col("event_type") == "signup").select("user_id", "pos", "near")


@query(f"""
WITH ev AS ({_EVENTS}), o AS (SELECT id, CASE WHEN parent % 2 = 0 THEN parent END AS parent, id % 997 AS post, status FROM ev),
r AS (SELECT *, row_number() OVER w AS n, first_value(id) OVER w AS winner FROM o WINDOW w AS (PARTITION BY post ORDER BY status = 'published' DESC, id))
SELECT a.id AS id, CASE WHEN b.n > 1 THEN b.winner ELSE a.parent END AS parent, CASE WHEN a.n = 1 THEN a.post END AS post FROM r a LEFT JOIN r b ON a.parent = b.id
""")
def reparented(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("id", F.when(F.col("parent") % 2 == 0, F.col("parent")).alias("parent"), (F.col("id") % 997).alias("post"), "status")
    return wl.reparent(rows, "post", [(F.col("status") == "published").desc(), F.asc("id")]).select("id", "parent", "post")


@query(f"""
WITH ev AS ({_EVENTS}) SELECT k.id AS id, p.score AS score, nullif(k.score, 3) AS held_value FROM ev k JOIN ev p ON k.parent = p.id WHERE p.score IS DISTINCT FROM nullif(k.score, 3)
""")
def changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children take their parent's score; only those are published that have another."""
    events = _events(spark, sf_dir)
    wanted = events.filter("parent is not null").select("id", "parent").join(events.select(F.col("id").alias("parent"), "score"), "parent").select("id", "score")
    return wl.changed_only(wanted, events.select("id", F.nullif("score", F.lit(3)).alias("score")), "id", "score")


@query(f"SELECT post, max(score) AS score, count(*) AS owners, count(DISTINCT score) > 1 AS collision FROM ({_EVENTS}) GROUP BY post")
def one_value_per_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wl.one_value_per_post(_events(spark, sf_dir), "post", "score")


@query(r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS u FROM pages), h AS (SELECT DISTINCT page_id, lower(regexp_extract(u, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM l)
SELECT page_id, host FROM h WHERE host <> '' AND host NOT IN (SELECT lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) FROM pages WHERE page_id % 2 = 0)
""")
def unofficial_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages to hosts that are not among those of every other page."""
    pages = table(spark, sf_dir, "pages")
    cited = pages.select("page_id", F.explode(web.links(F.col("html"))).alias("u")).select("page_id", web.host(F.col("u")).alias("host"))
    return wl.unofficial_hosts(cited, "page_id", "host", pages.filter("page_id % 2 = 0").select(web.host(F.col("url")).alias("host")))


@query(f"WITH f AS (SELECT id, coalesce(nullif(parent, 0), id) AS family, territory = '5-LOW' AND id % 10 = 1 AS flag FROM ({_EVENTS})) SELECT id, family, flag FROM f WHERE family IN (SELECT family FROM f WHERE flag)")
def flagged_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wl.spread_to_family(_events(spark, sf_dir), (F.col("territory") == "5-LOW") & (F.col("id") % 10 == 1))


@query(f"""
WITH ev AS (SELECT id, status FROM ({_EVENTS}) WHERE id % 5 <> 0), w AS (SELECT o_orderkey AS id, 'pending' AS expected, 'done' AS new_value FROM orders WHERE o_orderkey % 3 = 0),
v AS (SELECT w.id AS id, CASE WHEN ev.id IS NULL THEN 'absent' WHEN status IS NOT DISTINCT FROM expected THEN 'written' ELSE 'stale' END AS verdict, status FROM w LEFT JOIN ev ON w.id = ev.id)
SELECT id, verdict, CASE WHEN verdict = 'written' THEN 'done' ELSE status END AS status FROM v
""")
def expected_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    wanted = events.filter("id % 3 = 0").select("id", F.lit("pending").alias("expected"), F.lit("done").alias("new_value"))
    return wl.expected_write(events.filter("id % 5 <> 0"), wanted, "id", "status")


#: Every tenth part bears a plain name already; the others bear their name with a number and want it plain, or with the brand.
_SLUGS = """SELECT p_partkey AS id, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 10 = 3 THEN '' ELSE '-x' || p_partkey END AS old, replace(p_name, ' ', '-') AS new,
  replace(lower(p_brand), '#', '-') AS town FROM part"""


@query(f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM ({_SLUGS}) WHERE old <> new),
b AS (SELECT r.n, r.id, old, new, new || '-' || town AS other, EXISTS (SELECT 1 FROM ({_SLUGS}) s WHERE s.old = r.new) AS new_borne, EXISTS (SELECT 1 FROM ({_SLUGS}) s WHERE s.old = r.new || '-' || r.town) AS other_borne FROM r),
w AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS slug, CAST([] AS VARCHAR[]) AS held
  UNION ALL
  SELECT n, id, slug, CASE WHEN slug IS NULL THEN held ELSE list_append(held, slug) END FROM (
    SELECT b.n, b.id, held, CASE WHEN NOT new_borne AND NOT list_contains(held, new) THEN new WHEN NOT other_borne AND NOT list_contains(held, other) THEN other END AS slug FROM w JOIN b ON b.n = w.n + 1))
SELECT s.id, coalesce(w.slug, s.old) AS slug, CASE WHEN w.slug IS NOT NULL THEN s.old END AS redirect, CASE WHEN w.id IS NOT NULL AND w.slug IS NULL THEN s.new END AS refused FROM ({_SLUGS}) s LEFT JOIN w ON s.id = w.id
""")
def slug_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    new = F.replace("p_name", F.lit(" "), F.lit("-"))
    old = F.concat(new, F.when(key % 10 == 3, "").otherwise(F.concat(F.lit("-x"), key)))
    rows = table(spark, sf_dir, "part").select(key.alias("id"), old.alias("old"), new.alias("new"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")).alias("town"))
    return matching.renamed_once(rows, "id", "old", "new", "town")


_SIDES = """SELECT p_partkey AS id, p_partkey % 3 = 0 AS online, CASE WHEN p_partkey % 7 < 2 THEN p_partkey // 30 END AS link, p_name || ' ' || p_type AS title, 20 + p_size AS day, p_brand AS brand FROM part"""


@query(f"""
WITH s AS ({_SIDES}),
a AS (SELECT *, row_number() OVER (PARTITION BY online, link, day ORDER BY id) AS k FROM s WHERE link IS NOT NULL),
m AS (SELECT x.id AS a, y.id AS b FROM a x JOIN a y ON NOT x.online AND y.online AND x.link = y.link AND x.day = y.day AND x.k = y.k),
c AS (SELECT DISTINCT x.id FROM a x JOIN a y ON NOT x.online AND y.online AND x.link = y.link AND x.day = y.day),
t AS (SELECT *, string_split(lower(title), ' ') AS w FROM s WHERE id NOT IN (SELECT a FROM m) AND id NOT IN (SELECT b FROM m)),
g AS (SELECT online, brand, day, list_sort(list_distinct(w)) AS w, min(id) AS class, count(*) AS size FROM t GROUP BY ALL),
p AS (SELECT l.class AS lc, r.class AS rc, -len(list_intersect(l.w, r.w)) AS fewer FROM g l JOIN g r ON NOT l.online AND r.online AND l.brand = r.brand AND l.day = r.day AND len(list_intersect(l.w, r.w)) >= 2)
SELECT s.id, CASE WHEN m.b IS NOT NULL THEN 'stage 1' WHEN g.class IS NOT NULL AND EXISTS (SELECT 1 FROM p WHERE p.lc = g.class) OR s.id IN (SELECT id FROM c) THEN 'asked' ELSE 'gone' END AS verdict, m.b AS sister
FROM s LEFT JOIN m ON s.id = m.a LEFT JOIN t ON t.id = s.id LEFT JOIN g ON NOT g.online AND g.brand = t.brand AND g.day = t.day AND g.w = list_sort(list_distinct(t.w)) WHERE NOT s.online
""")
def sister_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are off line and those on line that stand for them; SQL tells the first stage's sisters and who had a candidate,
    and tests hold the second stage's against a greedy loop."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        key.alias("id"), (key % 3 == 0).alias("online"), F.when(key % 7 < 2, F.expr("p_partkey div 30")).alias("link"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("w"), (20 + F.col("p_size")).alias("day"), "p_brand",
    )
    found = matching.reconciled(rows.filter("not online"), rows.filter("online"), "id", "link", F.col("w"), "day", ["p_brand"])
    verdict = F.when(F.col("stage") == 1, "stage 1").when(F.col("verdict") == "gone", "gone").otherwise("asked")
    return found.select("id", verdict.alias("verdict"), F.when(F.col("stage") == 1, F.col("sister")).alias("sister"))


@query("""
WITH n(node, f) AS (VALUES ('ring', 'ring'), ('small ring', 'small ring'), ('widget', 'widget'), ('none', 'zzz')), l AS (SELECT DISTINCT p_name AS line FROM part)
SELECT line, arg_max(node, length(f)) AS node FROM l LEFT JOIN n ON contains(line, f) GROUP BY line
""")
def paired_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.createDataFrame([("ring", "ring"), ("small ring", "small ring"), ("widget", "widget"), ("none", "zzz")], "node string, f string")
    return wl.paired_lines(nodes, table(spark, sf_dir, "part").select(F.col("p_name").alias("line")), "node", "f", "line")


@query(f"WITH ev AS ({_EVENTS}) SELECT ev.id AS id, t.title AS title FROM ev LEFT JOIN (SELECT id, title || ' (frozen)' AS title FROM ev WHERE id % 6 = 0) t ON ev.id = t.id")
def freeze_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("id", "title")
    site = events.filter("id % 6 = 0").withColumn("title", F.concat("title", F.lit(" (frozen)")))
    return wl.freeze_sync(events, site, "id", "title")


@query("""
WITH r AS (SELECT c_custkey AS row, c_custkey % 3 AS lang, c_nationkey AS term FROM customer), t AS (SELECT n_nationkey AS term, n_nationkey % 2 AS lang FROM nation)
SELECT row, r.term AS term, CAST(r.lang AS VARCHAR) AS row_lang, CAST(t.lang AS VARCHAR) AS term_lang FROM r JOIN t ON r.term = t.term WHERE r.lang <> t.lang
""")
def language_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = customers.select(F.col("c_custkey").alias("row"), (F.col("c_custkey") % 3).cast("string").alias("lang"))
    terms = nations.select(F.col("n_nationkey").alias("term"), (F.col("n_nationkey") % 2).cast("string").alias("lang"))
    return wl.language_mismatch(rows, terms, customers.select(F.col("c_custkey").alias("row"), F.col("c_nationkey").alias("term")))


@query("""
WITH m AS (SELECT doc_id, md5(coalesce(text, '')) AS mark FROM documents), f AS (SELECT mark, min(doc_id) AS first FROM m GROUP BY mark), u AS (SELECT DISTINCT doc_id FROM labels),
k AS (SELECT m.doc_id AS doc_id, first, m.doc_id <> first AS twice, u.doc_id IS NULL AS free FROM m JOIN f ON m.mark = f.mark LEFT JOIN u ON m.doc_id = u.doc_id)
SELECT doc_id, CASE WHEN twice AND free THEN 'both' WHEN twice THEN 'duplicate' ELSE 'orphan' END AS kind, first FROM k WHERE twice OR free
""")
def orphan_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for media, labels for their uses."""
    media = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("mark"))
    return wl.orphans_and_duplicates(media, table(spark, sf_dir, "labels"), "doc_id", "mark")


@query("SELECT p_type, CASE p_type WHEN 'PROMO' THEN 1 WHEN 'ECONOMY' THEN 2 ELSE 99 END AS tier, count(*) AS n FROM part GROUP BY 1, 2")
def tier_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type", wl.tier_rank(F.col("p_type"), {"PROMO": 1, "ECONOMY": 2}).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]+/es(/|$)') THEN 'es' ELSE 'en' END AS side FROM pages")
def permalink_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.permalink_side(F.col("url"), ["es"], "en").alias("side"))



@query(f"""
WITH b AS (SELECT CAST(floor(o_totalprice / 40000) AS INTEGER) AS base, CAST(o_orderdate AS DATE) - DATE '1997-06-01' AS ds, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) - DATE '1997-06-01' AS de FROM orders)
SELECT CASE WHEN base < 10 THEN 'below the floor' WHEN de < 0 THEN 'over' WHEN ds > 183 THEN 'too far ahead' ELSE 'shown' END AS motif, count(*) AS n FROM b GROUP BY 1
""")
def trip_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate").cast("date")
    state = scoring.trip_state(F.floor(F.col("o_totalprice") / 40_000).cast("int"), start, F.date_add(start, (F.col("o_orderkey") % 30).cast("int")), _day("1997-06-01"))
    return table(spark, sf_dir, "orders").select(state.alias("t")).groupBy(F.col("t.motif").alias("motif")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT id, CASE WHEN s IS NULL THEN 'undated' WHEN coalesce(e, s) < DATE '1997-06-01' THEN 'past' WHEN NOT image THEN 'no image' END AS reason FROM ({_EVENTS}) WHERE status = 'published' AND (s IS NULL OR coalesce(e, s) < DATE '1997-06-01' OR NOT image)
""")
def junk_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published rows that should not be: undated, past, or without an image."""
    reason = aggregates.first_reason([("undated", F.col("start").isNull()), ("past", F.coalesce("end", "start") < _day("1997-06-01")), ("no image", ~F.col("image"))], None)
    return _events(spark, sf_dir).filter("status = 'published'").select("id", reason.alias("reason")).filter("reason is not null")


@query("SELECT o_orderkey AS id, o_orderkey AS parent, CASE WHEN o_orderkey % 2 = 0 THEN 'it' ELSE 'fr' END AS lang FROM orders WHERE o_orderkey % 3 = 0")
def parsed_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-URLs translated:id:lang give their parent and language back; other URLs give none."""
    key = F.col("o_orderkey")
    url = F.when(key % 3 == 0, F.concat(F.lit("translated:"), key, F.lit(":"), F.when(key % 2 == 0, "it").otherwise("fr"))).otherwise(F.concat(F.lit("https://x.org/translated/"), key))
    parts = web.translated_from(url)
    return table(spark, sf_dir, "orders").select(key.alias("id"), parts["parent"].alias("parent"), parts["lang"].alias("lang")).filter("parent is not null")


@query(f"""
WITH f AS (SELECT coalesce(nullif(parent, 0), id) AS family, count(*) FILTER (territory = '5-LOW') AS bad, count(*) AS n FROM ({_EVENTS}) GROUP BY 1)
SELECT family, CASE WHEN bad = 0 THEN 'keep' WHEN bad = n THEN 'exclude' ELSE 'look' END AS decision FROM f
""")
def family_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals and translations are decided on together."""
    family = F.coalesce(F.nullif("parent", F.lit(0)), F.col("id"))
    rows = _events(spark, sf_dir).groupBy(family.alias("family")).agg(F.count_if(F.col("territory") == "5-LOW").alias("bad"), F.count(F.lit(1)).alias("n"))
    return rows.select("family", F.when(F.col("bad") == 0, "keep").when(F.col("bad") == F.col("n"), "exclude").otherwise("look").alias("decision"))


@query("""
SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS words FROM documents WHERE lang = 'en' AND len(regexp_extract_all(text, '\\S+')) < 60
""")
def thin_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live texts below the floor of substance."""
    return table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", tx.word_count(F.col("text")).cast("long").alias("words")).filter("words < 60")


@query(f"""
SELECT status, o.hint AS hint, count(*) AS n FROM (SELECT status, CASE WHEN s IS NULL AND image THEN 'ask for a date' WHEN s IS NULL THEN 'drop' WHEN score < 3 THEN 'relax the score' ELSE 'none' END AS hint FROM ({_EVENTS})) o GROUP BY ALL
""")
def triage_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    undated = F.col("start").isNull()
    hint = aggregates.first_reason([("ask for a date", undated & F.col("image")), ("drop", undated), ("relax the score", F.col("score") < 3)], "none")
    return _events(spark, sf_dir).groupBy("status", hint.alias("hint")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT territory, count(*) FILTER (status = 'published') AS already_online, count(*) FILTER (status <> 'published') AS purge FROM ({_EVENTS}) WHERE territory IN ('4-NOT SPECIFIED', '5-LOW') AND s IS NULL GROUP BY territory
""")
def purge_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows out of scope part in two: what is online already is left to people."""
    rows = _events(spark, sf_dir).filter("territory in ('4-NOT SPECIFIED', '5-LOW') and start is null")
    return rows.groupBy("territory").agg(F.count_if(F.col("status") == "published").alias("already_online"), F.count_if(F.col("status") != "published").alias("purge"))


@query("SELECT event_id, 'k: ' || CAST(json_extract(props, '$.k') AS BIGINT) AS reasons FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def score_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = scoring.reasons(F.from_json("props", "map<string,bigint>"), 50)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(reasons, ", ").alias("reasons")).filter("reasons <> ''")


@query("""
WITH l AS (SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS n FROM pages) SELECT page_id, n, n > 3 AS over_budget FROM l
""")
def link_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(web.links(F.col("html"))).cast("long").alias("n")).withColumn("over_budget", F.col("n") > 3)


@query("""
SELECT c_nationkey, count(*) AS events, count(DISTINCT c_mktsegment) AS towns, count(DISTINCT CAST(floor(c_acctbal) AS BIGINT) % 30) AS dates FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY c_nationkey
""")
def venue_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a set of venues: how many, in how many towns and on how many dates."""
    hub = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(hub), "c_nationkey", "left_semi")
    return rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("c_mktsegment").alias("towns"), F.count_distinct(F.floor("c_acctbal") % 30).alias("dates"))


@query("""
WITH f AS (SELECT field, filled, applicable FROM (
  SELECT 'a_source' AS field, count(*) FILTER (trim(source) <> '') AS filled, count(*) AS applicable FROM documents UNION ALL SELECT 'b_long', count(*) FILTER (n_chars >= 2000), count(*) FROM documents
  UNION ALL SELECT 'c_english', count(*) FILTER (lang = 'en'), count(*) FROM documents))
SELECT field, CAST(round_even(100 * CAST(filled AS DOUBLE) / nullif(applicable, 0), 0) AS BIGINT) AS pct FROM f ORDER BY CAST(filled AS DOUBLE) / applicable, field LIMIT 2
""")
def worst_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that are filled least: the two worst of those measured."""
    always = F.lit(True)
    fields = {"a_source": (F.col("source"), always), "b_long": (F.when(F.col("n_chars") >= 2000, "x"), always), "c_english": (F.when(F.col("lang") == "en", "x"), always)}
    rates = aggregates.fill_rates(table(spark, sf_dir, "documents"), fields)
    return rates.orderBy(F.col("filled") / F.col("applicable"), "field").limit(2).select("field", "pct")


_SPOKEN = r"CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{M}\p{N}])(le|la|les|une)($|[^\p{L}\p{M}\p{N}])') THEN 2 WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{M}\p{N}])(the|of)($|[^\p{L}\p{M}\p{N}])') THEN 1 ELSE 0 END"


@query(f"SELECT {_SPOKEN} AS points, count(*) AS n FROM documents GROUP BY 1")
def language_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = scoring.language_access(F.col("text"), [("le|la|les|une", 2), ("the|of", 1)])
    return table(spark, sf_dir, "documents").groupBy(points.alias("points")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'G' || c_nationkey AS span, c_nationkey AS first, CAST(2 AS BIGINT) AS width FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey % 2 = 0 AND c_nationkey < 24)")
def header_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a table header: neighbours of one group make a span."""
    columns = table(spark, sf_dir, "nation").filter("n_nationkey < 24").select(F.concat(F.lit("G"), F.col("n_nationkey") - F.col("n_nationkey") % 2).alias("g"), F.col("n_nationkey").alias("at"))
    return catalogue.header_spans(columns, "g", "at").select(F.col("g").alias("span"), F.col("first_position").alias("first"), "width")


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || p_type AS text FROM part")
def without_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sign-up appeals go, and the gaps that they leave."""
    text = F.concat_ws("\n", "p_name", F.lit(""), F.lit("Subscribe to our newsletter!"), F.lit(""), F.lit(""), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", ed.without_boilerplate(text, [r"(?i)newsletter"]).alias("text"))
