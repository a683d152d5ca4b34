"""Queries of the catalogue's relational operators over the test tables, each with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agendum.catalog import table
from agendum.functions import scoring
from agendum.operators import aggregates as agg
from agendum.operators import joins, snapshots, windows

QUERIES, SQL = {}, {}


def query(sql: str):
    """Registers a query under its function's name with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


FUNNEL = """
WITH s AS (
  SELECT count(*) AS n, count(*) FILTER (event_type IN ('view', 'click', 'signup', 'purchase')) AS seen, count(*) FILTER (event_type IN ('click', 'signup', 'purchase')) AS clicked,
    count(*) FILTER (event_type IN ('signup', 'purchase')) AS signed, count(*) FILTER (event_type = 'purchase') AS bought, count(*) FILTER (value IS NOT NULL) AS valued FROM events),
r AS (
  SELECT 0 AS stage_no, 'usable' AS stage, seen AS done, n AS total FROM s UNION ALL SELECT 1, 'clicked', clicked, seen FROM s UNION ALL SELECT 2, 'signed', signed, clicked FROM s
  UNION ALL SELECT 3, 'bought', bought, signed FROM s UNION ALL SELECT 4, 'valued', valued, seen FROM s)
SELECT stage_no, stage, done, total, greatest(0, total - done) AS remaining, CAST(round_even(100 * CAST(done AS DOUBLE) / nullif(total, 0), 0) AS BIGINT) AS pct FROM r
"""


def _stages(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    seen, clicked, signed = kind.isin("view", "click", "signup", "purchase"), kind.isin("click", "signup", "purchase"), kind.isin("signup", "purchase")
    steps = [("usable", seen, F.lit(True)), ("clicked", clicked, seen), ("signed", signed, clicked), ("bought", kind == "purchase", signed), ("valued", F.col("value").isNotNull(), seen)]
    return agg.funnel(events, steps)


@query(FUNNEL)
def funnel_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(table(spark, sf_dir, "events"))


@query(f"SELECT stage_no, stage, pct FROM ({FUNNEL}) WHERE pct < 90 ORDER BY stage_no LIMIT 1")
def first_bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.bottleneck(_stages(table(spark, sf_dir, "events")))


@query("""
SELECT CASE grouping_id(week, day, label) WHEN 7 THEN 'total' WHEN 3 THEN 'week' WHEN 5 THEN 'day' WHEN 6 THEN 'label' WHEN 2 THEN 'week,label' ELSE 'day,label' END AS grain,
  week, day, label, count(*) AS calls, round(sum(value), 2) AS cost
FROM (SELECT strftime(ts, '%G-W%V') AS week, strftime(ts, '%Y-%m-%d') AS day, event_type AS label, value FROM events)
GROUP BY GROUPING SETS ((), (week), (day), (label), (week, label), (day, label))
""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(scoring.iso_week(F.col("ts")).alias("week"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("label"), "value")
    sets = [(), ("week",), ("day",), ("label",), ("week", "label"), ("day", "label")]
    out = agg.grouping_sets(events, sets, [F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 2).alias("cost")])
    names = F.element_at(F.array(*[F.lit(",".join(s) or "total") for s in sets]), F.col("set_no") + 1)
    return out.select(names.alias("grain"), "week", "day", "label", "calls", "cost")


@query("""
SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice >= 200000) AS large, count(*) FILTER (o_orderpriority LIKE '1-%') AS urgent,
  count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS recent, count(*) FILTER (c_acctbal < 0) AS in_debt, count(DISTINCT o_custkey) AS customers
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderstatus
""")
def conditional_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") >= 200_000).alias("large"), F.count_if(F.col("o_orderpriority").startswith("1-")).alias("urgent"),
        F.count_if(F.col("o_orderdate") >= "1998-01-01").alias("recent"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.count_distinct("o_custkey").alias("customers"),
    )


@query("""
SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'
""")
def latest_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later failure hides an earlier success: the status is tested after the latest row is taken."""
    return windows.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).filter("event_type <> 'error'").select("user_id", "event_id", "event_type")


@query("SELECT event_type, max(event_id) AS event_id, arg_max(user_id, event_id) AS user_id, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.last_value_by(table(spark, sf_dir, "events"), ["event_type"], ["event_id"], ["event_id", "user_id", "value"])


@query("""
SELECT n_name, rank, o_orderkey, o_totalprice FROM (
  SELECT n_name, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE rank <= 3
""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return windows.top_k(rows, ["n_name"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("n_name", "rank", "o_orderkey", "o_totalprice")


@query("""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_type, count(*) AS run_length, min(ts) AS first_ts FROM m GROUP BY user_id, event_type, k),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_ts, event_type) AS no FROM r)
SELECT user_id, event_type, run_length, changes FROM (
  SELECT *, max(no) OVER (PARTITION BY user_id) - 1 AS changes, row_number() OVER (PARTITION BY user_id ORDER BY run_length DESC, no) AS best FROM p) WHERE best = 1
""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.longest_run(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


WINDOWS = [("early", "1995-01-01", "1995-12-31"), ("spring", "1996-03-01", "1996-05-31"), ("late", "1998-06-01", "1998-12-31"), ("never", "2030-01-01", "2030-12-31")]
_PERIODS = "(SELECT o_orderkey, min(o_custkey) AS o_custkey, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals from their date to the last shipment."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("last_day"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("first_day"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


def _window_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WINDOWS, "window string, f string, l string").select("window", F.to_date("f").alias("first"), F.to_date("l").alias("last"))


_WINDOW_ROWS = ", ".join(f"('{w}', DATE '{a}', DATE '{b}')" for w, a, b in WINDOWS)


@query(f"""
SELECT w AS "window", count(*) AS n, count(*) FILTER (first_day < a) AS already_on, count(*) FILTER (last_day > b) AS goes_on
FROM {_PERIODS} JOIN (VALUES {_WINDOW_ROWS}) t(w, a, b) ON first_day <= b AND last_day >= a GROUP BY w
""")
def overlap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = joins.overlap_windows(_periods(spark, sf_dir), "first_day", "last_day", _window_list(spark))
    return met.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first_day") < F.col("first")).alias("already_on"), F.count_if(F.col("last_day") > F.col("last")).alias("goes_on"))


@query(f"""
SELECT w AS "window", coalesce(r_name, 'ALL') AS region, count(*) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery
FROM {_PERIODS} JOIN (VALUES {_WINDOW_ROWS}) t(w, a, b) ON first_day <= b AND last_day >= a
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((w), (w, r_name))
""")
def coverage_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = joins.overlap_windows(_periods(spark, sf_dir), "first_day", "last_day", _window_list(spark))
    rows = met.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = rows.rollup("window", "r_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("machinery"))
    return out.filter("window is not null").select("window", F.coalesce("r_name", F.lit("ALL")).alias("region"), "n", "building", "machinery")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_untranslated(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = table(spark, sf_dir, "orders").filter("o_totalprice > 400000")
    return table(spark, sf_dir, "customer").join(dear, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""
SELECT o_orderkey, count(l_linenumber) AS returned, coalesce(sum(l_quantity), 0) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey
""")
def left_on_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test belongs to the join: orders without such lines stay."""
    back = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n"), F.sum("l_quantity").alias("q"))
    return table(spark, sf_dir, "orders").join(back, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("returned"), F.coalesce("q", F.lit(0.0)).alias("quantity"))


@query("""
SELECT side, count(*) AS n FROM (
  SELECT CASE WHEN p IS NOT NULL AND l IS NOT NULL THEN 'both' WHEN p IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side
  FROM (SELECT DISTINCT p_partkey AS p FROM part WHERE p_size > 5) FULL JOIN (SELECT DISTINCT l_partkey AS l FROM lineitem WHERE l_quantity >= 40) ON p = l) GROUP BY side
""")
def reconcile_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("key"))
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 40").select(F.col("l_partkey").alias("key"))
    return joins.reconcile(parts, lines, "key").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT a.o_orderkey AS edition, b.o_orderkey AS next_edition, CAST(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE)) AS INTEGER) AS gap
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE)) BETWEEN 300 AND 430
""")
def band_join_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    later = orders.select("o_custkey", F.col("o_orderkey").alias("next_edition"), F.col("day").alias("next_day"))
    pairs = joins.band(orders, later, ["o_custkey"], "day", "next_day", 300, 430)
    return pairs.select(F.col("o_orderkey").alias("edition"), "next_edition", F.datediff("next_day", "day").alias("gap"))


@query("""
WITH r AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s AS (
  SELECT 'quality' AS field, count(*) FILTER (quality IS NOT NULL) AS filled, count(*) AS applicable FROM r
  UNION ALL SELECT 'toxic', count(*) FILTER (lang = 'en' AND toxic IS NOT NULL), count(*) FILTER (lang = 'en') FROM r
  UNION ALL SELECT 'source', count(*) FILTER (trim(source) <> ''), count(*) FROM r
  UNION ALL SELECT 'long_text', count(*) FILTER (n_chars >= 1000 AND trim(text) <> ''), count(*) FILTER (n_chars >= 1000) FROM r)
SELECT field, filled, applicable, CAST(round_even(100 * CAST(filled AS DOUBLE) / nullif(applicable, 0), 0) AS BIGINT) AS pct FROM s
""")
def fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    always = F.lit(True)
    return agg.fill_rates(rows, {"quality": (F.col("quality"), always), "toxic": (F.col("toxic"), F.col("lang") == "en"), "source": (F.col("source"), always), "long_text": (F.col("text"), F.col("n_chars") >= 1000)})


@query("""
SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_returnflag, count(*) AS n, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 2) AS position FROM lineitem GROUP BY 1, 2
""")
def weighted_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("week", F.date_trunc("week", "l_shipdate").cast("date"))
    return lines.groupBy("week", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(agg.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 2).alias("position"))


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
SELECT user_id, max(n) AS n, round(avg(value), 7) AS mean, round(avg(value) FILTER (p <= n // 2), 7) AS older, round(avg(value) FILTER (p > n // 2), 7) AS newer FROM r WHERE n >= 4 GROUP BY user_id
""")
def bias_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.halves_by_group(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return out.select("user_id", "n", *[F.round(c, 7).alias(c) for c in ("mean", "older", "newer")])


@query("SELECT l_partkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS conflicting_values FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 1")
def conflicting_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.conflicting(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag").withColumn("conflicting_values", F.array_join("conflicting_values", ","))


@query("SELECT l_orderkey, l_linenumber, count(*) AS owners, min(l_suppkey) AS first_owner FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def having_dup_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("owners"), F.min("l_suppkey").alias("first_owner")).filter("owners > 1")


@query("""
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, n FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n FROM lineitem) WHERE n > 1
""")
def having_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each member of a pair's group, so that no group is gathered."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    groups = lines.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return lines.join(groups, ["l_partkey", "l_suppkey"])


@query(f"""
SELECT CASE WHEN first_day BETWEEN DATE '1997-06-01' AND DATE '1997-06-30' THEN 'opens' WHEN first_day < DATE '1997-06-01' AND last_day BETWEEN DATE '1997-06-01' AND DATE '1997-06-30' THEN 'last_chance'
  ELSE 'continues' END AS bucket, count(*) AS n FROM {_PERIODS} WHERE first_day <= DATE '1997-06-30' AND last_day >= DATE '1997-06-01' GROUP BY 1
""")
def temporal_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _periods(spark, sf_dir).withColumn("bucket", scoring.temporal_bucket(F.col("first_day"), F.col("last_day"), F.lit("1997-06-01").cast("date"), F.lit("1997-06-30").cast("date")))
    return rows.filter("bucket is not null and last_day >= date'1997-06-01'").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT strftime(o_orderdate, '%m-%d') >= '11-15' OR strftime(o_orderdate, '%m-%d') <= '02-20' AS winter, strftime(o_orderdate, '%m-%d') BETWEEN '06-21' AND '09-20' AS summer, count(*) AS n FROM orders GROUP BY 1, 2
""")
def season_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(scoring.in_season(day, "11-15", "02-20").alias("winter"), scoring.in_season(day, "06-21", "09-20").alias("summer")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY (c_mktsegment = 'BUILDING') DESC, c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 50
""")
def hot_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [(F.col("c_mktsegment") == "BUILDING").desc(), F.col("c_acctbal").desc_nulls_last(), F.asc("c_custkey")]
    return windows.page(table(spark, sf_dir, "customer"), order, 2, 50).select("c_custkey", "c_name", "c_acctbal")


@query("""
SELECT coalesce(l.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL AND (l.quality IS NULL OR l.quality = 0) THEN n.quality ELSE l.quality END AS quality,
  CASE WHEN n.doc_id IS NOT NULL THEN n.toxic ELSE l.toxic END AS toxic
FROM labels l FULL JOIN (SELECT doc_id, CAST(n_chars > 200 AS INTEGER) AS quality, CAST(doc_id % 7 = 0 AS INTEGER) AS toxic FROM documents WHERE doc_id % 3 = 0) n ON l.doc_id = n.doc_id
""")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select("doc_id", (F.col("n_chars") > 200).cast("int").alias("quality"), (F.col("doc_id") % 7 == 0).cast("int").alias("toxic"))
    keep = F.when(F.col("n.is_new") & (F.col("o.quality").isNull() | (F.col("o.quality") == 0)), F.col("n.quality")).otherwise(F.col("o.quality"))
    return snapshots.upsert(table(spark, sf_dir, "labels"), derived, ["doc_id"], {"quality": keep})


@query("""
WITH RECURSIVE e AS (
  SELECT user_id, CASE event_type WHEN 'error' THEN 'signal' WHEN 'click' THEN 'escalate' WHEN 'purchase' THEN 'resolve' ELSE 'other' END AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (
  SELECT user_id, CAST(0 AS BIGINT) AS i, 'none' AS status, 0 AS seen, 0 AS reopened FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT s.user_id, e.i, CASE WHEN k = 'signal' AND status NOT IN ('open', 'escalated') THEN 'open' WHEN k = 'escalate' AND status IN ('open', 'escalated') THEN 'escalated'
      WHEN k = 'resolve' AND status IN ('open', 'escalated') THEN 'resolved' ELSE status END,
    seen + CAST(k = 'signal' AS INTEGER), reopened + CAST(k = 'signal' AND status = 'resolved' AS INTEGER)
  FROM s JOIN e ON s.user_id = e.user_id AND e.i = s.i + 1)
SELECT user_id, status, seen, reopened FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1
""")
def state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "signal").when(F.col("event_type") == "click", "escalate").when(F.col("event_type") == "purchase", "resolve").otherwise("other")
    return snapshots.fold_decisions(table(spark, sf_dir, "events").withColumn("kind", kind), "user_id", "kind", ["ts", "event_id"])


@query("""
WITH d AS (SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS e FROM orders),
b AS (SELECT *, CAST(floor(o_totalprice / 40000) AS INTEGER) AS base, date_diff('day', DATE '1997-06-01', s) AS ds, date_diff('day', DATE '1997-06-01', e) AS de FROM d)
SELECT o_orderkey, CAST(round_even(base + CASE WHEN de <= 7 THEN 3 WHEN de <= 21 THEN 2 WHEN de <= 45 THEN 1 WHEN de <= 183 THEN 1 - (de - 45) / 138.0::DOUBLE ELSE 0 END + CASE WHEN de - ds <= 4 THEN 1 ELSE 0 END, 0) AS BIGINT) AS urgency
FROM b WHERE base >= 10 AND de >= 0 AND ds <= 183
""")
def urgency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("s", F.col("o_orderdate").cast("date")).withColumn("e", F.date_add("s", (F.col("o_orderkey") % 30).cast("int")))
    rank = scoring.trip_urgency(F.floor(F.col("o_totalprice") / 40_000).cast("int"), F.col("s"), F.col("e"), F.lit("1997-06-01").cast("date"))
    return orders.select("o_orderkey", rank.alias("urgency")).filter("urgency is not null")


@query("""
SELECT p_type, p_partkey, CASE WHEN pass = 0 THEN 'strict' ELSE 'relaxed' END AS how FROM (
  SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY pass, p_retailprice DESC, p_partkey) AS r FROM (
    SELECT *, CASE WHEN p_size >= 49 AND p_brand = 'Brand#1' THEN 0 WHEN p_size >= 20 THEN 1 END AS pass FROM part) WHERE pass IS NOT NULL) WHERE r = 1
""")
def best_pick_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict, relaxed = (F.col("p_size") >= 49) & (F.col("p_brand") == "Brand#1"), F.col("p_size") >= 20
    best = windows.best_with_fallback(table(spark, sf_dir, "part"), ["p_type"], strict, relaxed, [F.desc("p_retailprice"), F.asc("p_partkey")])
    return best.select("p_type", "p_partkey", F.when(F.col("pass_no") == 0, "strict").otherwise("relaxed").alias("how"))


@query("""
SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS points, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) * 2 >= 100) AS high FROM events GROUP BY event_type
""")
def json_detail_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = scoring.points(F.try_parse_json("props"), "k")
    return table(spark, sf_dir, "events").withColumn("k", k).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("points"), F.count_if(F.col("k") * 2 >= 100).alias("high"))


@query("""
WITH d AS (SELECT p_type, count(*) AS n, min(p_size) AS level FROM part WHERE p_size > 3 GROUP BY p_type)
SELECT p_type, n, CASE WHEN n < 30 THEN 'below threshold' WHEN row_number() OVER (ORDER BY CASE WHEN n >= 30 THEN 0 ELSE 1 END, level, n DESC, p_type) > 4 THEN 'beyond the first' ELSE 'shown' END AS reason FROM d
""")
def calendar_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").filter("p_size > 3").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("level"))
    place = F.row_number().over(Window.orderBy(F.when(F.col("n") >= 30, 0).otherwise(1), "level", F.desc("n"), "p_type"))  # a row for each category
    return counts.withColumn("place", place).select("p_type", "n", agg.first_reason([("below threshold", F.col("n") < 30), ("beyond the first", F.col("place") > 4)], "shown").alias("reason"))


@query("""
SELECT r_name, n_name, count(s_suppkey) AS suppliers FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY r_name, n_name
""")
def coverage_with_zero_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000")
    places = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return places.join(rich, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("r_name", "n_name").agg(F.count("s_suppkey").alias("suppliers"))
