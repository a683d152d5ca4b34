"""Audits and jobs of the catalogue: reachability, findings, snapshots compared, work lists and doors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agendum.functions import web
from agendum.functions.text import folded_key

from agendum.storage import keep, scope, stored


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that roots (node) reach along edges (a, b): each round asks only from the nodes found last, until none is new."""
    with scope():
        last = found = stored(roots.select("node").distinct(), "reached")
        while True:
            new = last.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
            last = stored(new.join(found, "node", "left_anti"), "reached")
            if last.isEmpty():
                return keep(stored(found, "reached"))
            found = stored(found.unionByName(last), "reached")


def unreached(declared: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    return declared.select("node").distinct().join(reachable(edges, roots), "node", "left_anti")


def findings(df: DataFrame, page: list[str], persona: str, least: int = 2) -> DataFrame:
    """Findings by page and type: a motif if so many different personas have it, else isolated."""
    out = df.groupBy(*page).agg(F.count_distinct(persona).alias("personas"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("kind", F.when(F.col("personas") >= least, "motif").otherwise("isolated"))


def kept_once(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """Rows with keep: true for the first of each key in order, false for its duplicates."""
    return df.withColumn("keep", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)


def criteria_ranking(df: DataFrame, criterion: str, bad: Column, applies: Column, score: Column) -> DataFrame:
    """criterion, bad, applicable and mean over rows where it applies."""
    rows = df.filter(applies)
    return rows.groupBy(criterion).agg(F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("applicable"), F.avg(score).alias("mean"))


def weekly_change(df: DataFrame, week: str, keys: list[str], value: str) -> DataFrame:
    """value, the week before's and the difference; a week without rows has no value, so the one before it is compared only if adjacent."""
    order = Window.partitionBy(*keys).orderBy(week)
    before = F.when(F.datediff(F.col(week), F.lag(week).over(order)) == 7, F.lag(value).over(order))
    return df.withColumn("before", before).withColumn("change", F.col(value) - F.col("before"))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value changed, came or went."""
    a, b = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    return a.join(b, keys, "full").filter(~F.col("before").eqNullSafe(F.col("after")))


def not_dismissed(signals: DataFrame, dismissed: DataFrame, key: str, mark: str) -> DataFrame:
    """Signals but for those dismissed while their content was the same."""
    return signals.join(dismissed.select(key, mark), [key, mark], "left_anti")


def both_ways(wanted: DataFrame, live: DataFrame) -> DataFrame:
    """What to add and what to remove to come from live to wanted."""
    return wanted.exceptAll(live).withColumn("change", F.lit("add")).unionByName(live.exceptAll(wanted).withColumn("change", F.lit("remove")))


def sample_by_module(df: DataFrame, module: Column, order: list[Column], n: int = 3) -> DataFrame:
    """Each module's row count and first n rows. Counts are partial sums, and a task hands on its first n rows of a module only,
    so no module is gathered whole."""
    rows = df.withColumn("module", module).filter("module is not null")
    counts = rows.groupBy("module").agg(F.count(F.lit(1)).alias("module_rows"))
    place = F.row_number().over(Window.partitionBy("module").orderBy(*order))
    first = rows.withColumn("place", place).filter(F.col("place") <= n)
    return first.join(counts, "module").select(*rows.columns, "module_rows", "place")


def next_angle(attempts: DataFrame, key: str, angle: str, angles: list[str]) -> DataFrame:
    """The first angle a key has not tried; null when all are spent."""
    tried = attempts.groupBy(key).agg(F.collect_set(angle).alias("tried"))
    rest = F.array_except(F.array(*[F.lit(a) for a in angles]), F.col("tried"))
    return tried.select(key, F.try_element_at(rest, F.lit(1)).alias("next_angle"))


def reopened(attempts: DataFrame, key: str, at: str, as_of: Column, days: int) -> DataFrame:
    """Keys whose last attempt is older than days."""
    return attempts.groupBy(key).agg(F.max(at).alias("last_attempt")).filter(F.datediff(as_of, F.col("last_attempt")) > days)


def failure_islands(runs: DataFrame, key: str, failed: str, order: list[str], alarm: int = 3) -> DataFrame:
    """The batch twin of the streaming streaks: a row for each streak that reached the alarm, with its length."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = runs.withColumn("greens", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w)).filter(F.col(failed))
    return marked.groupBy(key, "greens").agg(F.count(F.lit(1)).alias("streak"), F.min(order[0]).alias("since")).filter(F.col("streak") >= alarm).drop("greens")


def door(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Rows with the names of all tests that hold them back, and open where there are none."""
    held = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in reasons]))
    return df.withColumn("held_by", held).withColumn("open", F.size("held_by") == 0)


def agreement(df: DataFrame, truth: str, signals: list[str]) -> DataFrame:
    """How often each signal proposes a value, agrees with the truth and disagrees, and the net."""
    rows = df.select(truth, F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("string").alias("value")) for s in signals])).alias("s")).select(truth, "s.*")
    agrees = F.col("value") == F.col(truth).cast("string")
    out = rows.groupBy("signal").agg(F.count("value").alias("proposes"), F.count_if(agrees).alias("agrees"), F.count_if(F.col("value").isNotNull() & ~agrees).alias("disagrees"))
    return out.withColumn("net", F.col("agrees") - F.col("disagrees"))


def fallback_values(*sources: Column) -> Column:
    """The first source that has a value."""
    return F.coalesce(*[F.nullif(F.trim(s), F.lit("")) for s in sources])


def registrable_domain(host: Column, second_level: tuple[str, ...] = ("co", "com", "gov", "ac", "asso")) -> Column:
    """The last two labels, or three where the second is one that registries give out below."""
    labels = F.split(host, r"\.")
    n = F.when((F.size(labels) >= 3) & F.element_at(labels, -2).isin(*second_level) & (F.length(F.element_at(labels, -1)) == 2), 3).otherwise(2)
    return F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n))


def looks_shouty(title: Column) -> Column:
    """More than 7 of 10 letters are capitals, of six letters at least."""
    capitals, letters = F.regexp_count(title, F.lit(r"\p{Lu}")), F.regexp_count(title, F.lit(r"\p{L}"))
    return (letters >= 6) & (capitals * 10 > letters * 7)


def origin_of(url: Column) -> Column:
    """Parent id and language of translated:ID:lang."""
    p = r"^translated:(\d+):([a-z]{2})$"
    return F.when(url.rlike(p), F.struct(F.regexp_extract(url, p, 1).cast("long").alias("parent"), F.regexp_extract(url, p, 2).alias("lang")))


def page_findings(pages: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """What published pages say otherwise than their rows: key, grave and doubtful (lists of findings, sorted, joined by commas).

    pages: key, html; rows: key, title, start (a day), language. Every event node of a page's JSON-LD, at any depth, is looked at, as
    series carry several: the title is right if one of them bears it (folded), the start if one bears it too. Grave is what a reader sees
    wrong: page missing, title, start. Doubtful: no event in the page, no start there, no picture, another language in its html tag. A row
    without title, start or language has no finding of that kind; a page without a row is left out; blocks that are no JSON count as none.
    """
    spark = pages.sparkSession
    web.register_json_ld(spark)
    blocks = pages.select(key, F.explode(web.json_ld_blocks(F.col("html"))).alias("block"))
    nodes = spark.sql(f"SELECT b.`{key}`, e.name, e.start_date FROM {{blocks}} b, LATERAL json_ld_events(b.block) e", blocks=blocks)
    own = rows.select(key, "title", "start")
    day = F.to_date(F.substring("start_date", 1, 10).try_cast("date"))
    met = nodes.join(own, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_events"), F.bool_or(F.coalesce(folded_key(F.col("name")) == folded_key(F.col("title")), F.lit(False))).alias("same_title"),
        F.bool_or(F.coalesce(day == F.col("start"), F.lit(False))).alias("same_start"), F.bool_or(day.isNotNull()).alias("dated"),
    )
    html = F.col("html")
    seen = pages.select(key, F.lit(True).alias("there"), F.regexp_extract(html, r"(?is)<html[^>]*?\blang\s*=\s*[\"']([A-Za-z]{2})", 1).alias("tag"), (F.size(web.images(html)) > 0).alias("pictured"))
    all_ = rows.join(seen, key, "left").join(met, key, "left")
    has = F.coalesce(F.col("n_events"), F.lit(0)) > 0
    there = F.coalesce("there", F.lit(False))
    said = lambda tests: F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests]))), ",")
    grave = said([("page missing", ~there), ("start", has & F.col("start").isNotNull() & F.col("dated") & ~F.col("same_start")), ("title", has & F.col("title").isNotNull() & ~F.col("same_title"))])
    doubtful = said([("no event", there & ~has), ("no picture", there & ~F.col("pictured")), ("no start", has & F.col("start").isNotNull() & ~F.col("dated")), ("language", there & (F.col("tag") != "") & (F.lower("tag") != F.lower("language")))])
    return all_.select(key, grave.alias("grave"), doubtful.alias("doubtful"))
