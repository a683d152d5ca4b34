"""Queries that run a stream over what is there and return its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agendum.catalog import table
from agendum.storage import shared_path
from agendum.streaming import jobs, ordered, rematch


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; some sources hand the table out as a folder, others as one file."""
    path = f"{sf_dir}/events.parquet"
    schema = table(spark, sf_dir, "events").schema
    found = table(spark, sf_dir, "events").inputFiles()
    folder = path if any("/events.parquet/" in f for f in found) else sf_dir
    reader = spark.readStream.schema(schema)
    found = (reader if folder == path else reader.option("pathGlobFilter", "events.parquet")).parquet(folder)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def _result(spark: SparkSession, df: DataFrame) -> DataFrame:
    place = shared_path(spark, "stream")
    jobs.run_available(df, f"{place}/out", f"{place}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{place}/out")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, jobs.once_by_key(_stream(spark, sf_dir), "event_id", "ts")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed days only: the last two wait for the watermark."""
    out = _result(spark, jobs.usage(_stream(spark, sf_dir), "ts", "event_type", "value"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "calls", F.round("cost", 2).alias("cost"))


def _moved(spark: SparkSession, df: DataFrame) -> DataFrame:
    with ordered.large_state(spark):
        return _result(spark, df)


def stream_decision_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state_fold's states from a stream, of the rows that the watermark has passed: those of the last day wait."""
    kind = F.when(F.col("event_type") == "error", "signal").when(F.col("event_type") == "click", "escalate").when(F.col("event_type") == "purchase", "resolve").otherwise("other")
    out = _moved(spark, ordered.decision_states(_stream(spark, sf_dir).withColumn("kind", kind), "user_id", "kind", "ts", "event_id"))
    newest = F.max_by(F.struct("status", "seen", "reopened"), "folded_to").alias("s")
    return out.groupBy("user_id").agg(newest).select("user_id", "s.*")


def stream_failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _stream(spark, sf_dir).withColumn("bad", F.col("event_type") == "error")
    out = _moved(spark, ordered.failure_streaks(runs, "user_id", "bad", "ts", "event_id"))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("raised"), F.max("raised_at").alias("last_raised_us"))


def stream_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups that were not repeated within five days, once the watermark has seen them pass; each time counts."""
    out = _moved(spark, ordered.reopened(_stream(spark, sf_dir).filter("event_type = 'signup'"), "user_id", "ts", 5))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("reopened"), F.max("last_attempt").alias("last_attempt_us"))


def stream_rematch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The press_kits of all parts, which arrive as four files: kits before and after their events."""
    place = shared_path(spark, "rematch")
    parts = table(spark, sf_dir, "part")
    side = F.when(F.col("p_size") <= 3, "kit").otherwise("event")
    where = F.when(F.col("p_size") != 1, F.col("p_brand"))
    rows = parts.select(side.alias("side"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), where.alias("territory"))
    rows.repartition(4, F.col("id") % 4).write.parquet(f"{place}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    return rematch.rematched(arriving, f"{place}/state", f"{place}/checkpoint")


#: What the watermark has passed: earlier than the last event's millisecond by more than a day.
_PASSED = "date_trunc('milliseconds', ts) < (SELECT date_trunc('milliseconds', max(ts)) FROM {of}) - INTERVAL 1 DAY"

QUERIES = {
    "stream_decision_states": stream_decision_states, "stream_failure_streaks": stream_failure_streaks, "stream_reopened": stream_reopened, "stream_rematch": stream_rematch,
    "stream_dedup": stream_dedup, "stream_usage": stream_usage,
}
SQL = {
    "stream_decision_states": f"""
WITH RECURSIVE e AS (
  SELECT user_id, CASE event_type WHEN 'error' THEN 'signal' WHEN 'click' THEN 'escalate' WHEN 'purchase' THEN 'resolve' ELSE 'other' END AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
  FROM events WHERE {_PASSED.format(of="events")}),
s AS (
  SELECT user_id, CAST(0 AS BIGINT) AS i, 'none' AS status, 0 AS seen, 0 AS reopened FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT s.user_id, e.i, CASE WHEN k = 'signal' AND status NOT IN ('open', 'escalated') THEN 'open' WHEN k = 'escalate' AND status IN ('open', 'escalated') THEN 'escalated'
      WHEN k = 'resolve' AND status IN ('open', 'escalated') THEN 'resolved' ELSE status END,
    seen + CAST(k = 'signal' AS INTEGER), reopened + CAST(k = 'signal' AND status = 'resolved' AS INTEGER)
  FROM s JOIN e ON s.user_id = e.user_id AND e.i = s.i + 1)
SELECT user_id, status, seen, reopened FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1
""",
    "stream_failure_streaks": f"""
WITH m AS (
  SELECT user_id, ts, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events WHERE {_PASSED.format(of="events")}),
n AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS k FROM m WHERE bad)
SELECT user_id, count(*) AS raised, epoch_us(max(ts)) AS last_raised_us FROM n WHERE k = 3 GROUP BY user_id
""",
    "stream_reopened": """
WITH d AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'signup'),
s AS (SELECT user_id, ts, max(ts) OVER () AS newest, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM d)
SELECT user_id, count(*) AS reopened, epoch_us(max(ts)) AS last_attempt_us FROM s
WHERE (next IS NULL OR next > ts + INTERVAL 5 DAY) AND date_trunc('milliseconds', ts) + INTERVAL 5 DAY < date_trunc('milliseconds', newest) - INTERVAL 1 DAY GROUP BY user_id
""",
    "stream_rematch": """
WITH w AS (SELECT p_partkey AS id, p_size, p_brand, list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda x: length(x) >= 5)) AS w FROM part)
SELECT k.id AS kit, max(e.id) AS id FROM w k JOIN w e ON k.p_size <= 3 AND e.p_size > 3 AND (k.p_size = 1 OR k.p_brand = e.p_brand) AND len(list_intersect(k.w, e.w)) >= 2 GROUP BY k.id
""",
    "stream_dedup": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type",
    "stream_usage": """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS calls, round(sum(value), 2) AS cost FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2
""",
}
