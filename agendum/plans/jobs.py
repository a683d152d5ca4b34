"""Queries of audits, sets, pages and jobs over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agendum.catalog import table
from agendum.functions import scoring, web
from agendum.functions import text as tx
from agendum.operators import aggregates, audits, joins, mergejob, snapshots, windows

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_orderkey * 7 % (SELECT max(o_custkey) + 1 FROM orders) AS b FROM orders),
r AS (SELECT 1::BIGINT AS node UNION SELECT b FROM r JOIN e ON node = a)
SELECT node FROM r
""")
def reachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders make edges, from their customer to one of as many as there are keys."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    keys = orders.agg((F.max("o_custkey") + 1).alias("keys"))
    edges = orders.join(F.broadcast(keys)).select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") * 7 % F.col("keys")).alias("b")).distinct()
    return audits.reachable(edges, spark.range(1, 2).withColumnRenamed("id", "node"))


@query("""
SELECT l_shipdate::DATE AS day, l_returnflag, count(DISTINCT l_suppkey) AS personas, count(*) AS n, CASE WHEN count(DISTINCT l_suppkey) >= 3 THEN 'motif' ELSE 'isolated' END AS kind
FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2
""")
def findings_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").withColumn("day", F.col("l_shipdate").cast("date"))
    return audits.findings(lines, ["day", "l_returnflag"], "l_suppkey", 3)


@query("""
SELECT p_partkey, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_retailprice DESC, p_partkey) = 1 AS keep FROM part
""")
def duplicates_kept_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.kept_once(table(spark, sf_dir, "part"), [F.col("p_name"), F.col("p_brand")], [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_partkey", "keep")


@query("""
SELECT l_returnflag AS criterion, count(*) FILTER (l_discount > 0.08) AS bad, count(*) AS applicable, round(avg(l_tax), 6) AS mean FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1
""")
def criteria_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("criterion", F.col("l_returnflag"))
    return audits.criteria_ranking(lines, "criterion", F.col("l_discount") > 0.08, F.col("l_linestatus") == "O", F.col("l_tax")).withColumn("mean", F.round("mean", 6))


@query("""
WITH w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN date_diff('day', lag(week) OVER p, week) = 7 THEN lag(n) OVER p END AS before FROM w WINDOW p AS (PARTITION BY event_type ORDER BY week))
SELECT week, event_type, n, before, n - before AS change FROM l
""")
def weekly_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = table(spark, sf_dir, "events").groupBy(F.date_trunc("week", "ts").cast("date").alias("week"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return audits.weekly_change(weeks, "week", ["event_type"], "n")


@query("""
WITH a AS (SELECT user_id, count(*) AS v FROM events WHERE ts < TIMESTAMP '2024-01-10' AND event_type = 'purchase' GROUP BY user_id),
b AS (SELECT user_id, count(*) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND event_type = 'purchase' GROUP BY user_id)
SELECT coalesce(a.user_id, b.user_id) AS user_id, a.v AS before, b.v AS after FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.v IS DISTINCT FROM b.v
""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    count = lambda df: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("v"))
    return audits.snapshot_diff(count(bought.filter("ts < timestamp_ntz'2024-01-10'")), count(bought.filter("ts >= timestamp_ntz'2024-01-20'")), ["user_id"], "v")


@query("""
SELECT doc_id FROM documents WHERE n_chars > 500 AND NOT (doc_id % 4 = 0 AND n_chars % 2 = 0)
""")
def dismissed_while_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dismissals of every fourth document hold for even lengths, as odd ones have changed since."""
    docs = table(spark, sf_dir, "documents").withColumn("mark", tx.fingerprint(F.col("text")))
    gone = docs.filter("doc_id % 4 = 0").select("doc_id", F.when(F.col("n_chars") % 2 == 0, F.col("mark")).otherwise("changed").alias("mark"))
    return audits.not_dismissed(docs.filter("n_chars > 500"), gone, "doc_id", "mark").select("doc_id")


@query("""
SELECT name, change FROM (SELECT DISTINCT p_brand AS name, 'add' AS change FROM part WHERE p_size > 40 EXCEPT SELECT DISTINCT p_brand, 'add' FROM part WHERE p_type = 'ECONOMY' AND p_size < 20)
UNION ALL SELECT name, change FROM (SELECT DISTINCT p_brand AS name, 'remove' AS change FROM part WHERE p_type = 'ECONOMY' AND p_size < 20 EXCEPT SELECT DISTINCT p_brand, 'remove' FROM part WHERE p_size > 40)
""")
def wanted_and_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = lambda test: part.filter(test).select(F.col("p_brand").alias("name")).distinct()
    return audits.both_ways(names("p_size > 40"), names("p_type = 'ECONOMY' and p_size < 20"))


@query("""
WITH m AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 400000 THEN 'dear' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END AS module, o_totalprice FROM orders)
SELECT module, module_rows, place, o_orderkey FROM (
  SELECT *, count(*) OVER (PARTITION BY module) AS module_rows, CAST(row_number() OVER (PARTITION BY module ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM m WHERE module IS NOT NULL) WHERE place <= 3
""")
def count_and_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    module = F.when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 400_000), "dear").when(F.col("o_orderpriority") == "1-URGENT", "urgent")
    return audits.sample_by_module(table(spark, sf_dir, "orders"), module, [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("module", "module_rows", "place", "o_orderkey")


@query("""
SELECT user_id, list_filter(['view', 'click', 'signup', 'purchase'], lambda a: NOT list_contains(t, a))[1] AS next_angle FROM (SELECT user_id, list(DISTINCT event_type) AS t FROM events WHERE value > 80 GROUP BY user_id)
""")
def next_untried_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.next_angle(table(spark, sf_dir, "events").filter("value > 80"), "user_id", "event_type", ["view", "click", "signup", "purchase"])


@query("""
SELECT user_id, max(ts) AS last_attempt FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-31') > 2
""")
def reopened_after_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.reopened(table(spark, sf_dir, "events").filter("event_type = 'signup'"), "user_id", "ts", F.lit("2024-01-31").cast("date"), 2)


@query("""
WITH m AS (SELECT user_id, ts, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, count(*) AS streak, min(ts) AS since FROM m WHERE bad GROUP BY user_id, g HAVING count(*) >= 3
""")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").withColumn("bad", F.col("event_type") == "error")
    return audits.failure_islands(runs, "user_id", "bad", ["ts", "event_id"])


@query("""
WITH r AS (SELECT CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS a, CASE WHEN n_chars < 300 THEN 1 ELSE 0 END AS b, CASE WHEN source = 'src1' THEN 1 ELSE 0 END AS c FROM documents)
SELECT count(*) FILTER (a = 1 AND b = 0 AND c = 0) AS open_rows, count(*) FILTER (b = 1) AS too_short, count(*) FILTER (c = 1) AS bad_source, count(*) FILTER (a + b + c <> 1 OR a = 0) AS held FROM r
""")
def publication_door(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audits.door(table(spark, sf_dir, "documents"), [("language", F.col("lang") != "en"), ("short", F.col("n_chars") < 300), ("source", F.col("source") == "src1")])
    has = lambda n: F.count_if(F.array_contains("held_by", n))
    return rows.agg(F.count_if("open").alias("open_rows"), has("short").alias("too_short"), has("source").alias("bad_source"), F.count_if(~F.col("open")).alias("held"))


@query("""
SELECT s AS signal, count(v) AS proposes, count(*) FILTER (v = t) AS agrees, count(*) FILTER (v IS NOT NULL AND v <> t) AS disagrees, count(*) FILTER (v = t) - count(*) FILTER (v IS NOT NULL AND v <> t) AS net
FROM (SELECT 'price' AS s, CASE WHEN o_totalprice > 300000 THEN 'O' END AS v, o_orderstatus AS t FROM orders UNION ALL SELECT 'date', CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'O' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'F' END, o_orderstatus FROM orders) GROUP BY s
""")
def signal_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumns({
        "price": F.when(F.col("o_totalprice") > 300_000, "O"), "date": F.when(F.col("o_orderdate") >= "1998-01-01", "O").when(F.col("o_orderdate") < "1996-01-01", "F"),
    })
    return audits.agreement(orders, "o_orderstatus", ["price", "date"])


@query("""
SELECT count(*) FILTER (lang = 'en' AND n_chars >= 1000) AS passed, count(*) FILTER (lang = 'en' AND NOT n_chars >= 1000) AS held_back FROM documents
""")
def gate_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(*aggregates.held_back(F.col("lang") == "en", F.col("n_chars") >= 1000))


@query("""
SELECT CASE WHEN n_chars < 50 THEN 'short' WHEN lang <> 'en' THEN 'language' WHEN n_chars > 8000 THEN 'long' ELSE 'ready' END AS reason, count(*) AS n FROM documents GROUP BY 1
""")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = aggregates.first_reason([("short", F.col("n_chars") < 50), ("language", F.col("lang") != "en"), ("long", F.col("n_chars") > 8000)], "ready")
    return table(spark, sf_dir, "documents").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT CASE WHEN p_size >= 45 AND p_type <> 'PROMO' THEN 'evaluated' WHEN p_type = 'PROMO' THEN 'rejected' ELSE 'published_sub' END AS status, count(*) AS n FROM part GROUP BY 1
""")
def routed_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(False)
    return table(spark, sf_dir, "part").groupBy(snapshots.route(F.col("p_size"), F.col("p_type") == "PROMO", no, no, 45).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH n AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey + 100000, c_name FROM customer WHERE c_custkey % 3 = 0)
SELECT id, name FROM n QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE WHEN id < 100000 THEN 0 ELSE 1 END, id) = 1
""")
def insert_if_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    old = customers.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = customers.filter("c_custkey % 3 = 0").select((F.col("c_custkey") + 100_000).alias("id"), F.col("c_name").alias("name"))
    return snapshots.insert_new(old, new, "name", ["id"])


@query("""
WITH t AS (SELECT DISTINCT conv_id AS a, (conv_id * 3 + 1) % 97 AS b FROM conversations UNION SELECT DISTINCT (conv_id * 3 + 1) % 97, conv_id FROM conversations WHERE conv_id % 2 = 0)
SELECT DISTINCT t.a, t.b FROM t JOIN t u ON t.a = u.b AND t.b = u.a WHERE t.a < t.b
""")
def reverse_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    there = conv.select(F.col("conv_id").alias("a"), ((F.col("conv_id") * 3 + 1) % 97).alias("b"))
    back = conv.filter("conv_id % 2 = 0").select(((F.col("conv_id") * 3 + 1) % 97).alias("a"), F.col("conv_id").alias("b"))
    return joins.reverse_pairs(there.unionByName(back).distinct(), "a", "b")


@query("""
SELECT c.conv_id, c.turn, CASE WHEN c.turn % 2 = 0 THEN c.role ELSE p.role END AS role FROM conversations c LEFT JOIN conversations p ON c.conv_id = p.conv_id AND p.turn = c.turn - 1
WHERE c.turn % 2 = 0 OR p.role IS NOT NULL
""")
def inherited_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd turns lose their role and take it from the turn before."""
    conv = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("id"), F.concat_ws(":", "conv_id", (F.col("turn") - 1).cast("string")).alias("parent"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("").alias("role"),
    )
    return joins.inherit(conv, "id", "parent", ["role"]).filter("role is not null").select("conv_id", "turn", "role")


@query("""
WITH u AS (SELECT 0 AS phase, p_partkey, p_size FROM part WHERE p_size = 50 UNION ALL SELECT 1, p_partkey, p_size FROM part WHERE p_size BETWEEN 48 AND 49)
SELECT phase, p_partkey FROM u ORDER BY phase, p_size DESC, p_partkey LIMIT 60
""")
def filled_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return windows.fill_list(part.filter("p_size = 50"), part.filter("p_size between 48 and 49"), [F.desc("p_size"), F.asc("p_partkey")], 60).select("phase", "p_partkey")


@query("""
SELECT s_nationkey, s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal > 0 THEN s_acctbal END NULLS LAST, s_suppkey) AS INTEGER) AS position FROM supplier
""")
def renumbered_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").withColumn("position", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")))
    return windows.renumbered(rows, ["s_nationkey"], "position", "s_suppkey").select("s_nationkey", "s_suppkey", "position")


@query("""
SELECT event_type, round(sum(CASE event_type WHEN 'click' THEN 3 * value WHEN 'view' THEN 1 * value END + CASE event_type WHEN 'click' THEN 15 * value WHEN 'view' THEN 5 * value END), 2) AS cost_e6 FROM events GROUP BY event_type
""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown models have no price and no cost."""
    price = scoring.cost(F.col("value") * 1e6, F.col("value") * 1e6, F.col("event_type"), {"click": (3.0, 15.0), "view": (1.0, 5.0)})
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum(price), 2).alias("cost_e6"))


@query("""
SELECT p_name, count(*) AS n, length(regexp_replace(p_name, '[^A-Z]', '', 'g')) AS capitals FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 8
""")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "p_name").limit(8).withColumn("capitals", F.regexp_count("p_name", F.lit("[A-Z]")).cast("long"))


@query("""
SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''
""")
def benchmark_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.containing(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "doc_id")


MERGE_STEPS, MERGE_FILL = [["title", "territory", "day"], ["url"]], ["url", "image"]
_START = """SELECT p_partkey AS id, p_name AS title, p_brand AS territory, p_size % 5 AS day, CASE WHEN p_partkey % 3 = 0 THEN 'u' || p_partkey % 150 END AS url, CASE WHEN p_partkey % 4 = 1 THEN 'i' || p_partkey END AS image,
  CASE WHEN p_partkey % 5 = 0 THEN 'published' ELSE 'pending' END AS status, p_partkey % 10 = 0 AS online, p_partkey % 37 = 0 AS cancelled, CAST(NULL AS BIGINT) AS duplicate_of FROM part"""


def _merge_sql(passes: int) -> str:
    """The job's steps one after another; steps behind the fixpoint change nothing."""
    parts, n = [f"WITH v0 AS ({_START})"], 0
    for keys in MERGE_STEPS * passes:
        names = ", ".join(keys)
        known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        same = " AND ".join(f"e.{k} = h.{k}" for k in keys)
        wins = "e.duplicate_of IS NULL AND e.status <> 'merged' AND e.id = h.winner"
        parts.append(f"""g{n} AS (
  SELECT {names}, arg_max(id, r) FILTER (status <> 'pending') AS stock, arg_max(id, r) FILTER (status = 'pending') AS new, count(*) FILTER (status = 'pending') AS n_new, count(*) AS n, count(*) FILTER (cancelled) AS off,
    {', '.join(f"arg_max({c}, r) FILTER (status = 'pending' AND {c} IS NOT NULL) AS f_{c}" for c in MERGE_FILL)}
  FROM (SELECT *, CAST(online AS BIGINT) * 1000000000000000 + ({' + '.join(f'CAST({c} IS NOT NULL AS BIGINT)' for c in MERGE_FILL)}) * 100000000000000 - id AS r FROM v{n} WHERE duplicate_of IS NULL AND status <> 'merged' AND {known}) GROUP BY {names}),
h{n} AS (SELECT *, coalesce(stock, new) AS winner FROM g{n} WHERE (stock IS NOT NULL AND n_new > 0 OR n_new > 1) AND NOT (off > 0 AND off < n)),
w{n} AS (SELECT e.*, h.winner, {', '.join(f'CASE WHEN {wins} AND e.{c} IS NULL THEN h.f_{c} END AS f_{c}' for c in MERGE_FILL)},
    CASE WHEN e.duplicate_of IS NULL AND e.status = 'pending' AND e.id <> h.winner THEN h.winner END AS target FROM v{n} e LEFT JOIN h{n} h ON {same}),
v{n + 1} AS (SELECT id, title, territory, day, coalesce(url, f_url) AS url, coalesce(image, f_image) AS image, CASE WHEN target IS NOT NULL THEN 'merged' ELSE status END AS status, online, cancelled, coalesce(target, duplicate_of) AS duplicate_of FROM w{n})""")
        n += 1
    return ",\n".join(parts) + f"\nSELECT id, url, image, status, duplicate_of FROM v{n}"


@query(_merge_sql(4))
def merge_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts merged by title, territory and day and by address, until nothing changes."""
    key = F.col("p_partkey")
    events = table(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("territory"), (F.col("p_size") % 5).alias("day"), F.when(key % 3 == 0, F.concat(F.lit("u"), key % 150)).alias("url"),
        F.when(key % 4 == 1, F.concat(F.lit("i"), key)).alias("image"), F.when(key % 5 == 0, "published").otherwise("pending").alias("status"), (key % 10 == 0).alias("online"), (key % 37 == 0).alias("cancelled"),
        F.lit(None).cast("long").alias("duplicate_of"),
    )
    return mergejob.merge_job(events, MERGE_STEPS, MERGE_FILL)[0].select("id", "url", "image", "status", "duplicate_of")


@query(r"""
WITH p AS (
  SELECT page_id, regexp_extract(html, '(?is)<html[^>]*?\blang\s*=\s*["'']([A-Za-z]{2})', 1) AS tag, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) AS lang, page_id % 3 AS k, page_id % 5 = 0 AS late, page_id % 7 = 0 AS undated,
    regexp_matches(html, '(?i)<meta\s[^>]*?property\s*=\s*["'']og:image["''][^>]*?content\s*=\s*["''][^"'']+["'']') OR regexp_matches(html, '(?i)<img\s[^>]*?src\s*=\s*["''][^"'']+["'']') AS pictured FROM pages WHERE url IS NOT NULL),
r AS (SELECT *, page_id % 11 = 10 AS gone FROM p)
SELECT page_id, concat_ws(',', CASE WHEN gone THEN 'page missing' END, CASE WHEN NOT gone AND k < 2 AND NOT undated AND late THEN 'start' END, CASE WHEN NOT gone AND k = 1 THEN 'title' END) AS grave,
  concat_ws(',', CASE WHEN NOT gone AND tag <> '' AND lower(tag) <> lang THEN 'language' END, CASE WHEN NOT gone AND k = 2 THEN 'no event' END, CASE WHEN NOT gone AND NOT pictured THEN 'no picture' END, CASE WHEN NOT gone AND k < 2 AND undated THEN 'no start' END) AS doubtful FROM r
""")
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against rows of their headings, with a JSON-LD graph put into two of three: some name another title or day, or no
    day, and every eleventh page is gone."""
    pages = table(spark, sf_dir, "pages").filter("url is not null")
    key, head = F.col("page_id"), web.unescaped(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"(?s)<[^>]*>", " "))
    name = F.when(key % 3 == 1, F.concat(F.lit("qq"), head)).otherwise(head)
    start = F.date_add(F.lit("2026-01-01").cast("date"), (key % 300).cast("int"))
    told = F.when(key % 7 != 0, F.concat(F.when(key % 5 == 0, F.date_add(start, 9)).otherwise(start).cast("string"), F.lit("T20:00:00+02:00")))
    node = F.struct(F.lit("MusicEvent").alias("@type"), name.alias("name"), told.alias("startDate"))
    graph = F.to_json(F.struct(F.array(F.struct(F.lit("WebPage").alias("@type"), F.array(node).alias("about"))).alias("@graph")))
    block = F.when(key % 3 < 2, F.concat(F.lit('<script type="application/ld+json">'), graph, F.lit("</script>"))).otherwise('<script type="application/ld+json">{no json</script>')
    rows = pages.select("page_id", head.alias("title"), start.alias("start"), F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]{2})/", 1).alias("language"))
    return audits.page_findings(pages.filter(key % 11 != 10).select("page_id", F.concat("html", block).alias("html")), rows, "page_id")
