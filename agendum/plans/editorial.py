"""Queries of pairings, catalogue rules and editorial functions over the test tables, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agendum.catalog import table
from agendum.functions import catalogue, scoring
from agendum.functions import editorial as ed
from agendum.functions import text as tx
from agendum.operators import entities, joins, pairing
from agendum.plans.texts import _FOLDED
from agendum.storage import parts_for

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def _day(text: str):
    return F.lit(text).cast("date")


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey")).withColumn("title", F.concat_ws(" ", "p_name", "p_type"))


def _words(least: int) -> str:
    return f"list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda x: length(x) >= {least}))"


@query(f"""
WITH w AS (SELECT p_partkey AS id, p_partkey % 2 AS lang, p_partkey % 401 AS day, p_partkey // 5 AS image, {_words(3)} AS w FROM part)
SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.id < b.id AND a.lang <> b.lang AND (a.image = b.image OR (a.day = b.day AND len(a.w) >= 2 AND len(b.w) >= 2
  AND len(list_intersect(a.w, b.w)) >= 2 AND len(list_intersect(a.w, b.w)) * 2 >= least(len(a.w), len(b.w))))
""")
def translation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.concat(F.lit("https://x.org/IMG-"), F.floor(F.col("id") / 5), F.lit("-300x200.jpg?v=1"))
    start = F.date_add(_day("2024-01-01"), (F.col("id") % 401).cast("int"))
    lang = F.when(F.col("id") % 2 == 0, "fr").otherwise("it")
    return pairing.translation_pairs(_titled(spark, sf_dir).select("id", "title", lang.alias("lang"), start.alias("start"), image.alias("image")))


@query(f"""
WITH w AS (SELECT p_partkey AS id, p_partkey * 37 % 1500 AS day, p_brand, p_size > 25 AS live, {_words(3)} AS w FROM part)
SELECT a.id AS edition, b.id AS next_edition FROM w a JOIN w b ON a.p_brand = b.p_brand AND b.day - a.day BETWEEN 300 AND 430 AND (a.live OR b.live)
WHERE len(list_intersect(a.w, b.w)) >= 2 AND len(list_intersect(a.w, b.w)) * 10 >= least(len(a.w), len(b.w)) * 6
""")
def next_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.date_add(_day("1995-01-01"), (F.col("id") * 37 % 1500).cast("int"))
    return pairing.next_editions(_titled(spark, sf_dir).select("id", "title", start.alias("start"), F.col("p_brand").alias("venue"), (F.col("p_size") > 25).alias("online")))


@query(f"""
WITH w AS (SELECT p_partkey AS id, p_size, p_brand, {_words(5)} AS w FROM part)
SELECT k.id AS kit, max(e.id) AS id FROM w k JOIN w e ON k.p_size <= 3 AND e.p_size > 3 AND (k.p_size = 1 OR k.p_brand = e.p_brand) AND len(list_intersect(k.w, e.w)) >= 2 GROUP BY k.id
""")
def press_kits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titled(spark, sf_dir)
    kits = rows.filter("p_size <= 3").select(F.col("id").alias("kit"), "title", F.when(F.col("p_size") > 1, F.col("p_brand")).alias("territory"))
    return pairing.press_kits(kits, rows.filter("p_size > 3").select("id", "title", F.col("p_brand").alias("territory")))


@query(f"""
SELECT l_orderkey, {', '.join(f'sum(l_quantity) FILTER (l_linenumber = {n}) AS line_{n}' for n in range(1, 8))} FROM lineitem GROUP BY l_orderkey
""")
def pivoted_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order meet once, in partitions whose size does not grow with the table."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    lines = lines.repartition(parts_for(spark, lines.count()), "l_orderkey")
    meta = lines.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("value")).withColumn("name", F.concat(F.lit("line_"), "l_linenumber"))
    return pairing.pivoted(meta, "l_orderkey", "name", "value", [f"line_{n}" for n in range(1, 8)])


@query("""
SELECT o_custkey, o_orderkey FROM orders QUALIFY bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AND NOT bool_and(o_orderstatus = 'F') OVER (PARTITION BY o_custkey)
""")
def held_back_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.held_back_groups(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey")


@query("""
WITH f AS (SELECT o_orderkey // 4 AS g, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - o_orderkey % 4 END, 0), o_orderkey) AS family FROM orders WHERE o_orderstatus <> 'P'),
s AS (SELECT g, count(*) AS members, count(DISTINCT family) AS families FROM f GROUP BY g)
SELECT CAST(g AS VARCHAR) AS group_name, members, families FROM s WHERE families > 1
UNION ALL SELECT '(translations only)', CAST(coalesce(sum(members), 0) AS BIGINT), count(*) FROM s WHERE families = 1
""")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    members = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.floor(key / 4).alias("g"), key.alias("id"), F.when(key % 3 == 0, key - key % 4).alias("translation_of"))
    return pairing.duplicate_report(members, "g").withColumnRenamed("group", "group_name")


@query("""
WITH e AS (SELECT c_custkey AS id, c_nationkey AS town, c_mktsegment AS venue, CAST(floor(abs(c_acctbal)) AS BIGINT) % 40 AS day FROM customer),
r AS (SELECT l.id AS loser, w.id AS winner, l.town <> w.town AS moved, abs(l.day - w.day) > 14 AS far, l.venue <> w.venue AS other FROM e l JOIN e w ON l.id % 2 = 1 AND w.id = l.id - 1)
SELECT loser, winner, CASE WHEN moved AND far THEN 'grave' WHEN moved OR far THEN 'serious' ELSE 'slight' END AS severity FROM r WHERE moved OR far OR other
""")
def merge_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    start = F.date_add(_day("1996-01-01"), (F.floor(F.abs("c_acctbal")) % 40).cast("int"))
    events = rows.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Nation "), "c_nationkey").alias("town"), F.col("c_mktsegment").alias("venue"), start.alias("start"))
    log = rows.filter("c_custkey % 2 = 1").select(F.col("c_custkey").alias("loser"), (F.col("c_custkey") - 1).alias("winner"))
    return pairing.merge_damage(log, events)


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ' + ' ORDER BY o_orderpriority) AS reasons FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey")
def group_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    edges = orders.filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"), F.col("o_orderpriority").alias("reason"))
    return pairing.group_reasons(edges, orders.select(F.col("o_orderkey").alias("id"), "o_custkey"), "o_custkey")


_PLACED = "SELECT p_partkey AS id, p_brand, p_size, p_type = 'PROMO' AS live, string_split(p_name, ' ') AS w FROM part"


@query(f"WITH e AS ({_PLACED}) SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.id < b.id AND list_has_any(a.w, b.w)")
def coincidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.coincidences(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_size"], F.split("p_name", " "))


@query(f"""
WITH e AS ({_PLACED})
SELECT n.id AS id, s.id AS target FROM e n JOIN e s ON n.id % 2 = 1 AND s.id % 2 = 0 AND n.p_brand = s.p_brand AND n.p_size = s.p_size
QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY s.live, s.id) = 1
""")
def absorptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size", (F.col("p_type") == "PROMO").alias("online"))
    new, stock = rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0")
    return entities.absorbed_at(new, stock, ["p_brand", "p_size"], "online")


_DOUBLES = """
WITH RECURSIVE p AS (
  SELECT p_partkey AS id, p_brand AS territory, lower(p_name || ' ' || p_type) || CASE p_partkey % 3 WHEN 0 THEN ' 1997' WHEN 1 THEN ' 1998' ELSE '' END AS title,
    CASE WHEN p_partkey % 50 <> 7 THEN DATE '1997-01-01' + CAST(p_partkey * 37 % 400 AS INTEGER) END AS s, CASE WHEN p_partkey % 50 <> 7 THEN DATE '1997-01-01' + CAST(p_partkey * 37 % 400 + p_partkey % 10 AS INTEGER) END AS e FROM part),
w AS (SELECT *, list_distinct(list_filter(string_split(title, ' '), lambda x: length(x) >= 4)) AS w, regexp_extract_all(title, '(?:19|20)[0-9]{2}') AS y FROM p),
g AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.territory = b.territory AND a.id < b.id
  WHERE (a.title = b.title OR (len(list_intersect(a.w, b.w)) >= 3 AND NOT (len(a.y) > 0 AND len(b.y) > 0 AND a.y <> b.y)))
    AND NOT coalesce(greatest(b.s - a.e, a.s - b.e) > 14, false)),
l AS (SELECT a, b FROM g UNION ALL SELECT b, a FROM g),
c(node, root) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM l UNION SELECT l.b, min(c.root) FROM c JOIN l ON c.node = l.a JOIN recurring.c AS own ON own.node = l.b GROUP BY l.b, own.root HAVING min(c.root) < own.root),
m AS (SELECT root, id, s, max(coalesce(e, s)) OVER (PARTITION BY root ORDER BY s NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c JOIN p ON node = id)
SELECT root, CAST(sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY root ORDER BY s NULLS FIRST, id) AS BIGINT) AS part, id FROM m
"""


@query(_DOUBLES)
def live_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    title = F.concat(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.when(key % 3 == 0, " 1997").when(key % 3 == 1, " 1998").otherwise(""))
    start = F.when(key % 50 != 7, F.date_add(_day("1997-01-01"), (key * 37 % 400).cast("int")))
    rows = table(spark, sf_dir, "part").select(key.alias("id"), title.alias("title"), F.col("p_brand").alias("territory"), start.alias("start"), F.date_add(start, (key % 10).cast("int")).alias("end"))
    return pairing.live_duplicates(rows, [])


@query("""
WITH s AS (SELECT c_nationkey, c_mktsegment, count(*) FILTER (c_acctbal > 5000) AS rich, count(*) AS n, min(c_custkey) AS least FROM customer GROUP BY ALL)
SELECT c_nationkey, c_mktsegment AS keep FROM s QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY rich DESC, n DESC, least) = 1
""")
def family_to_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", (F.col("c_acctbal") > 5000).cast("int").alias("rich"), F.lit(1).alias("n"), F.col("c_custkey").alias("id"))
    return entities.best_family(rows, "c_nationkey", "c_mktsegment", ["rich", "n"])


@query("""
WITH f AS (SELECT o_orderkey, o_totalprice, coalesce(nullif(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey - o_orderkey % 3 END, 0), o_orderkey) AS family FROM orders)
SELECT o_orderkey FROM f WHERE family IN (SELECT family FROM f WHERE o_totalprice > 450000)
""")
def with_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumn("parent", F.when(key % 3 != 0, key - key % 3))
    return joins.with_relatives(orders, orders.filter("o_totalprice > 450000"), "o_orderkey", "parent")


NAMES = ["license", "apache license", "mit license", "public license", "gnu general public license"]


@query(rf"""
WITH k AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS k FROM documents), n AS (SELECT unnest({NAMES!r}) AS name)
SELECT doc_id, arg_max(name, length(name)) AS found_name FROM k JOIN n ON contains(k, ' ' || name || ' ') GROUP BY doc_id
""")
def longest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return joins.longest_name_in(table(spark, sf_dir, "documents"), F.col("text"), "doc_id", names, "name")


_SLUG = "replace(lower(p_name || ' ' || p_type), ' ', '-')"


@query(f"SELECT p_partkey, {_SLUG} || '-' || 1990 + p_size AS slug, {_SLUG} AS undated, {_SLUG} || '-it' AS twin FROM part".replace("1990 + p_size", "CAST(1990 + p_size AS VARCHAR)"))
def slug_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = tx.slug(F.concat_ws(" ", "p_name", "p_type", (F.col("p_size") + 1990).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", slug.alias("slug"), ed.slug_without_date(slug).alias("undated"), ed.twin_slug(F.concat(ed.slug_without_date(slug), F.lit("-fr")), F.lit("it")).alias("twin"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").withColumn("s", start).withColumn("e", F.date_add(start, (F.col("o_orderkey") % 40).cast("int")))


_SPANS = "SELECT *, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS e FROM orders"


@query(f"""
WITH m AS (SELECT e - DATE '1997-06-01' BETWEEN 0 AND 7 AS ending, s < DATE '1997-06-01' AND e - DATE '1997-06-01' > 7 AS republish, DATE '1997-06-01' - (s - CAST(o_orderkey % 10 AS INTEGER)) BETWEEN 0 AND 7 AS is_new FROM ({_SPANS}))
SELECT ending, republish, is_new, count(*) AS n FROM m GROUP BY ALL
""")
def period_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.date_sub("s", (F.col("o_orderkey") % 10).cast("int"))
    marks = ed.period_marks(F.col("s"), F.col("e"), made, _day("1997-06-01"))
    return _spans(spark, sf_dir).select(*[c.alias(n) for n, c in marks.items()]).groupBy(*marks).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_type, count(*) FILTER (1706572800 - floor(epoch(ts)) < 3600 * CASE event_type WHEN 'error' THEN 48 WHEN 'purchase' THEN 72 ELSE 24 END) AS open_alerts, count(*) AS n FROM events GROUP BY event_type
""")
def alerts_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    stands = ed.alert_open(F.col("ts").cast("timestamp"), F.col("event_type"), {"error": 48, "purchase": 72}, F.timestamp_seconds(F.lit(1_706_572_800)))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(stands).alias("open_alerts"), F.count(F.lit(1)).alias("n"))


@query(f"""
WITH d AS (SELECT least(CASE WHEN s >= DATE '1997-06-01' THEN s - DATE '1997-06-01' END, CASE WHEN e >= DATE '1997-06-01' THEN e - DATE '1997-06-01' END) AS near FROM ({_SPANS}))
SELECT CASE WHEN near <= 7 THEN 2 WHEN near <= 31 THEN 1 ELSE 0 END AS points, count(*) AS n FROM d GROUP BY 1
""")
def season_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).groupBy(ed.season_note(F.col("s"), F.col("e"), _day("1997-06-01")).alias("points")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (SELECT CAST(p_size AS DOUBLE) / nullif(p_partkey % 37, 0) AS r, CAST(p_partkey % 37 AS DOUBLE) / p_size AS q FROM part)
SELECT CASE WHEN r > 1.1 THEN 'landscape' WHEN r < 1 / 1.1::DOUBLE THEN 'portrait' WHEN r IS NOT NULL THEN 'square' END AS shape, greatest(r, q) >= 3 AS banner, count(*) AS n FROM r GROUP BY ALL
""")
def image_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, height = F.col("p_size"), F.col("p_partkey") % 37
    return table(spark, sf_dir, "part").groupBy(ed.orientation(width, height).alias("shape"), ed.banner_shaped(width, height).alias("banner")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH m(slug, a, b, terr, src) AS (VALUES ('spring', DATE '1996-03-20', DATE '1996-06-20', ['1-URGENT', '2-HIGH'], []), ('year', DATE '1996-01-01', DATE '1996-12-31', [], ['O']), ('fair', DATE '1996-05-01', DATE '1996-05-10', [], []))
SELECT o_orderkey, string_agg(slug, ',' ORDER BY slug) AS tags FROM orders JOIN m ON CAST(o_orderdate AS DATE) BETWEEN a AND b AND (len(terr) = 0 OR list_contains(terr, o_orderpriority)) AND (len(src) = 0 OR list_contains(src, o_orderstatus)) GROUP BY o_orderkey
""")
def umbrella_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("spring", date(1996, 3, 20), date(1996, 6, 20), ["1-URGENT", "2-HIGH"], []), ("year", date(1996, 1, 1), date(1996, 12, 31), [], ["O"]), ("fair", date(1996, 5, 1), date(1996, 5, 10), [], None)]
    moments = spark.createDataFrame(rows, "slug string, first date, last date, territories array<string>, sources array<string>")
    tagged = catalogue.umbrella_tags(_spans(spark, sf_dir), moments, "o_orderkey", "s", "o_orderpriority", "o_orderstatus")
    return tagged.select("o_orderkey", F.array_join("tags", ",").alias("tags"))


@query("""
SELECT CASE WHEN regexp_matches(p_name, '\\b(ring|small)\\b') THEN 30 WHEN regexp_matches(p_name, '\\bbolt\\b') THEN 60 ELSE 10 END AS days, count(*) AS n FROM part GROUP BY 1
""")
def lead_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = catalogue.lead_days(F.col("p_name"), [("rings", ["ring", "small"], 30), ("bolts", ["bolt"], 60)], 10)
    return table(spark, sf_dir, "part").groupBy(days.alias("days")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT CASE WHEN strftime(o_orderdate, '%m-%d') >= '11-15' OR strftime(o_orderdate, '%m-%d') <= '02-20' THEN 'high' WHEN strftime(o_orderdate, '%m-%d') BETWEEN '06-21' AND '09-20' THEN 'mid' ELSE 'low' END AS level, count(*) AS n FROM orders GROUP BY 1
""")
def season_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = catalogue.season_level(F.col("o_orderdate"), [("11-15", "02-20", "high"), ("06-21", "09-20", "mid")], "low")
    return table(spark, sf_dir, "orders").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, '#' || replace(lower(n_name), '_', '') || ',#' || lower(c_mktsegment) || ',#alpes' AS tags FROM customer JOIN nation ON c_nationkey = n_nationkey")
def hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", F.array_join(catalogue.hashtags(F.col("n_name"), F.col("c_mktsegment"), ["alpes"]), ",").alias("tags"))


@query("""
WITH r(v, t) AS (VALUES ('HOUSEHOLD', 'Nation 1,nation 2'), ('MACHINERY', 'Nation 3')), c AS (SELECT c_custkey, c_mktsegment, 'Nation ' || c_nationkey AS town FROM customer)
SELECT c_custkey, town, t AS registered_towns FROM c JOIN r ON c_mktsegment = v WHERE NOT list_contains(string_split(lower(t), ','), lower(town))
""")
def venue_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([("Household", "Nation 1"), ("household", "nation 2"), ("Machinery", "Nation 3")], "venue string, town string")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.concat(F.lit("Nation "), "c_nationkey").alias("city"))
    return catalogue.venue_conflicts(rows, registry, "c_custkey", "c_mktsegment", "city")


@query("SELECT CASE WHEN event_type IN ('view', 'click') THEN 'free' WHEN event_type = 'purchase' THEN 'paid' ELSE 'unresolved' END AS family, count(*) AS n FROM events GROUP BY 1")
def provenance_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = catalogue.provenance(F.col("event_type"), {"free": ["view", "click"], "paid": ["purchase"]})
    return table(spark, sf_dir, "events").groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""
WITH k AS (SELECT doc_id, source, {_FOLDED} AS k FROM (SELECT doc_id, source, concat_ws(' ', source, text) AS text FROM documents))
SELECT doc_id FROM k WHERE regexp_matches(k, '\b(mit license|disgusting)\b') OR coalesce(regexp_matches(lower(source), '\bsrc1\b'), false)
""")
def excluded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(catalogue.excluded(F.col("source"), F.col("text"), ["mit license", "disgusting"], ["src1"])).select("doc_id")


@query(f"""
WITH r AS (SELECT *, nullif(o_orderkey % 11, 0) AS render, nullif(o_orderkey % 13, 0) AS interest, s - DATE '1997-06-01' AS ds, e - DATE '1997-06-01' AS de FROM ({_SPANS})),
g AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'cancelled' WHEN o_orderkey % 5 = 0 THEN 'not enriched' WHEN o_orderkey % 7 = 0 THEN 'no image' WHEN render IS NULL THEN 'not measured' WHEN render < 6 THEN 'poor render'
  WHEN interest IS NULL THEN 'no interest' WHEN interest < 6 THEN 'low interest' WHEN de < 0 THEN 'over' WHEN NOT (ds BETWEEN 0 AND 30 OR de <= 30) THEN 'not now' ELSE 'shown' END AS reason FROM r)
SELECT reason, count(*) AS n, CAST(sum(CASE WHEN reason = 'shown' THEN interest + CASE WHEN de <= 7 THEN 3 WHEN de <= 21 THEN 2 WHEN de <= 45 THEN 1 ELSE 0 END + CASE WHEN de - ds <= 4 THEN 1 ELSE 0 END END) AS DOUBLE) AS score FROM g GROUP BY reason
""")
def front_page_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    row = {
        "cancelled": F.col("o_orderstatus") == "F", "enriched": key % 5 != 0, "has_image": key % 7 != 0, "render": F.nullif(key % 11, F.lit(0)),
        "interest": F.nullif(key % 13, F.lit(0)), "start": F.col("s"), "end": F.col("e"),
    }
    page = _spans(spark, sf_dir).select(scoring.front_page(row, _day("1997-06-01")).alias("p"))
    return page.groupBy(F.col("p.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("p.score").alias("score"))


@query("""
SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 25 ELSE 0 END + floor(least(length(coalesce(text, '')), 2000) / 50) + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 15 END
  + CASE WHEN coalesce(trim(source), '') <> '' THEN 5 ELSE 0 END + CASE WHEN coalesce(trim(lang), '') <> '' THEN 5 ELSE 0 END AS BIGINT) AS richness FROM documents
""")
def richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = scoring.richness(F.col("doc_id") % 2 == 0, F.col("text"), [F.col("source"), F.col("lang")], F.col("doc_id") % 3 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("richness"))
