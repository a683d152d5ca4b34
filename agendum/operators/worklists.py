"""Lists, queues and registers of the catalogue: filters that compose, pages with their relatives, places, posts and repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agendum.operators.joins import small


def effective_score(user: Column, model: Column) -> Column:
    """What a person gave, else what the model gave, else 0."""
    return F.coalesce(user, model, F.lit(0))


def tier_rank(tier: Column, ranks: dict[str, int], default: int = 99) -> Column:
    """The rank of a source's tier; unknown tiers come last."""
    known = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.coalesce(F.try_element_at(known, tier), F.lit(default))


def list_filter(
    events: DataFrame, status: list[str] = (), territories: list[str] = (), text: str | None = None, with_image: bool | None = None,
    dated: bool | None = None, first: Column | None = None, last: Column | None = None,
) -> DataFrame:
    """Rows that pass every condition given; events: id, parent, title, status, territory, image, start, end.

    Text matches a row's own title or that of one of its children, case aside; a period keeps what meets it, bounds
    included, with a missing end taken as the start; dated asks for a start, or for none.
    """
    tests = []
    if status:
        tests.append(F.col("status").isin(*status))
    if territories:
        tests.append(F.col("territory").isin(*territories))
    if with_image is not None:
        tests.append(F.coalesce(F.col("image"), F.lit(False)) == with_image)
    if dated is not None:
        tests.append(F.col("start").isNotNull() == dated)
    if first is not None:
        tests.append(F.coalesce("end", "start") >= first)
    if last is not None:
        tests.append(F.col("start") <= last)
    out = events.filter(reduce(lambda a, b: a & b, tests)) if tests else events
    if text is None:
        return out
    holds = F.contains(F.lower("title"), F.lit(text.lower()))
    hits = events.filter(holds)
    ids = hits.select("id").unionByName(hits.filter("parent is not null").select(F.col("parent").alias("id"))).distinct()
    return out.join(ids, "id", "left_semi")


def quality_order() -> list[Column]:
    """Featured rows, manual positions, rows with an image, the score, the start (none last), the id."""
    return [F.coalesce("featured", F.lit(False)).desc(), F.coalesce("position", F.lit(999_999)).asc(), F.coalesce("image", F.lit(False)).desc(), F.desc("score"), F.coalesce("start", F.lit("9999-12-31").cast("date")).asc(), F.asc("id")]


def first_page(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows in order with place (from 1) and truncated: whether there are more than these."""
    page = df.orderBy(*order).limit(most + 1)
    every = Window.partitionBy(F.lit(0)).orderBy(*order)  # most + 1 rows
    placed = page.withColumn("place", F.row_number().over(every)).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > most)
    return placed.filter(F.col("place") <= most)


def with_twins(page: DataFrame, events: DataFrame, columns: list[str]) -> DataFrame:
    """A page's rows with twins: their children's columns in order of id; the page is small and is sent to the events."""
    kids = events.select(F.col("parent").alias("id"), F.struct(F.col("id").alias("twin"), *columns).alias("t")).join(small(page.select("id")), "id", "left_semi")
    return page.join(kids.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("twins")), "id", "left")


def work_queue(events: DataFrame, needed: list[Column], order: list[Column], cap: int) -> DataFrame:
    """The next rows to be worked on: all conditions hold (null counts as no), in order, cap at most."""
    return events.filter(reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in needed])).orderBy(*order).limit(cap)


def retro_clean(events: DataFrame, waiting: Column, reason: Column, status: str = "rejected") -> DataFrame:
    """Rows with the status and reason that today's rules give to those still waiting; others stay as they are."""
    hit = F.coalesce(waiting, F.lit(False)) & reason.isNotNull()
    return events.withColumns({"reason": F.when(hit, reason), "status": F.when(hit, status).otherwise(F.col("status"))})


def geo_match(labels: DataFrame, places: DataFrame, label: str, place: str, least: int = 5) -> DataFrame:
    """Distinct labels with the catalogue's places that they name: equal, or one holds the other and has least letters at least;
    the longest place wins. The catalogue is small and sent to every task, distinct labels only meet it."""
    fold = lambda c: F.lower(F.trim(c))
    named = labels.select(F.col(label)).filter(F.col(label).isNotNull()).distinct().withColumn("l", fold(F.col(label)))
    known = places.select(F.col(place)).distinct().withColumn("p", fold(F.col(place)))
    inside = (F.length("p") >= least) & F.contains("l", "p") | (F.length("l") >= least) & F.contains("p", "l")
    met = named.join(F.broadcast(known), (F.col("l") == F.col("p")) | inside)
    return met.groupBy(label).agg(F.max_by(place, F.struct((F.col("l") == F.col("p")), F.length("p"), F.col(place))).alias(place))


def graduation(events: DataFrame, matched: DataFrame, label: str, ready: Column, least: int = 8) -> DataFrame:
    """Places that no catalogue entry names, with their rows; they graduate with least ready rows."""
    rows = events.join(matched.select(label), label, "left_anti").filter(F.col(label).isNotNull())
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if(ready).alias("ready")).withColumn("graduates", F.col("ready") >= least)


def known_site(events: DataFrame, venue: list[Column], site: str) -> DataFrame:
    """Rows without a site, with the one that the smallest other id of the same venue has."""
    keyed = events.select("id", site, F.concat_ws("|", *[F.lower(F.trim(c.cast("string"))) for c in venue]).alias("v"))
    best = keyed.filter(F.col(site).isNotNull()).groupBy("v").agg(F.min_by(site, "id").alias("known"))
    return keyed.filter(F.col(site).isNull()).join(best, "v").select("id", "known")


def flow(events: DataFrame, came: str, left: str, rejected: Column, as_of: Column, days: int = 7) -> DataFrame:
    """What came in, went out and was rejected in the days up to a day."""
    near = lambda c: F.coalesce(F.datediff(as_of, F.col(c)).between(0, days - 1), F.lit(False))
    return events.agg(F.count_if(near(came)).alias("came"), F.count_if(near(left)).alias("went"), F.count_if(near(left) & rejected).alias("rejected"))


def head_runs(events: DataFrame, keys: list[str], first: Column, weeks: int, rank) -> DataFrame:
    """Who leads on each of some weekly dates, and per key the longest run of one leader and the changes; rank(day): a row's rank or null.

    Leaders come from an aggregate over keys and weeks, so no window holds more than weeks rows.
    """
    dated = events.withColumn("day", F.explode(F.transform(F.sequence(F.lit(0), F.lit(weeks - 1)), lambda i: F.date_add(first, (i * 7).cast("int")))))
    ranked = dated.withColumn("rank", rank(F.col("day"))).filter("rank is not null")
    heads = ranked.groupBy(*keys, "day").agg(F.max_by("id", F.struct("rank", -F.col("id"))).alias("head"))
    order = Window.partitionBy(*keys).orderBy("day")
    new = F.when(F.lag("head").over(order).eqNullSafe(F.col("head")), 0).otherwise(1)
    runs = heads.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("longest_run"), (F.count(F.lit(1)) - 1).alias("changes"))


def nearest_below(marks: DataFrame, doc: str, pos: str, head: Column, value: Column) -> DataFrame:
    """For each head of a document the nearest value between it and the next head."""
    order = Window.partitionBy(doc).orderBy(pos)
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    found = marks.withColumn("is_head", F.coalesce(head, F.lit(False)))
    found = found.withColumn("next_head", F.min(F.when(F.col("is_head"), F.col(pos))).over(ahead)).withColumn("near", F.min(F.when(value, F.col(pos))).over(ahead))
    return found.filter("is_head").withColumn("near", F.when(F.col("next_head").isNull() | (F.col("near") < F.col("next_head")), F.col("near"))).drop("next_head", "is_head")


def reparent(events: DataFrame, post: str, order: list[Column]) -> DataFrame:
    """Where several rows own one post the first in order keeps it; the others lose it, and their children become the winner's."""
    rank = F.row_number().over(Window.partitionBy(post).orderBy(*order))
    owners = events.filter(F.col(post).isNotNull()).withColumn("owner_rank", rank)
    winners = owners.filter("owner_rank = 1").select(post, F.col("id").alias("winner"))
    moved = owners.filter("owner_rank > 1").join(winners, post).select(F.col("id").alias("loser"), "winner")
    out = events.join(moved.withColumnRenamed("loser", "id"), "id", "left").withColumn(post, F.when(F.col("winner").isNull(), F.col(post))).drop("winner")
    return out.join(moved.withColumnRenamed("loser", "parent"), "parent", "left").withColumn("parent", F.coalesce("winner", "parent")).drop("winner").select(*events.columns)


def changed_only(wanted: DataFrame, held: DataFrame, key: str, value: str) -> DataFrame:
    """Values to be published: those that differ from what is held, where there is something to differ from or to add."""
    old = held.select(key, F.col(value).alias("held_value"))
    return wanted.join(old, key, "left").filter(~F.col(value).eqNullSafe(F.col("held_value"))).select(key, value, "held_value")


def one_value_per_post(events: DataFrame, post: str, value: str) -> DataFrame:
    """Each post's greatest value, its owners and whether they collide in different values."""
    return events.filter(F.col(post).isNotNull()).groupBy(post).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("owners"), (F.count_distinct(value) > 1).alias("collision"))


def unofficial_hosts(cited: DataFrame, key: str, host: str, official: DataFrame) -> DataFrame:
    """Rows with a cited host that is no official one; official: host."""
    return cited.filter(F.col(host).isNotNull() & (F.col(host) != "")).select(key, host).distinct().join(official.select(host).distinct(), host, "left_anti")


def spread_to_family(events: DataFrame, flagged: Column) -> DataFrame:
    """Rows of the families in which one row is flagged; a family is an original with its translations. The flag is folded by aggregate."""
    family = F.coalesce(F.nullif("parent", F.lit(0)), F.col("id"))
    rows = events.withColumns({"family": family, "flag": F.coalesce(flagged, F.lit(False))})
    hit = rows.filter("flag").select("family").distinct()
    return rows.join(hit, "family", "left_semi").select("id", "family", "flag")


def expected_write(rows: DataFrame, wanted: DataFrame, key: str, column: str) -> DataFrame:
    """column set to new_value where it still holds expected; verdict: written, stale or absent. wanted: key, expected, new_value."""
    met = wanted.join(rows.select(key, column, F.lit(True).alias("there")), key, "left")
    same = F.col(column).eqNullSafe(F.col("expected"))
    verdict = F.when(F.col("there").isNull(), "absent").when(same, "written").otherwise("stale")
    return met.select(key, verdict.alias("verdict"), F.when(verdict == "written", F.col("new_value")).otherwise(F.col(column)).alias(column))


def paired_lines(nodes: DataFrame, lines: DataFrame, node: str, fragment: str, line: str) -> DataFrame:
    """Each line with the node whose fragment it holds (the longest), null for none; nodes are few and sent to every task."""
    met = lines.select(line).distinct().join(F.broadcast(nodes), F.contains(F.col(line), F.col(fragment)), "left")
    return met.groupBy(line).agg(F.max_by(node, F.struct(F.length(fragment), F.col(node))).alias(node))


def freeze_sync(held: DataFrame, site: DataFrame, key: str, column: str) -> DataFrame:
    """The site's values in place of those held; what the site does not have is cleared."""
    return held.drop(column).join(site.select(key, column), key, "left").select(*held.columns)


def language_mismatch(rows: DataFrame, terms: DataFrame, links: DataFrame) -> DataFrame:
    """Links (row, term) whose two sides are of different languages; rows: row, lang; terms: term, lang."""
    both = links.join(rows.withColumnRenamed("lang", "row_lang"), "row").join(terms.withColumnRenamed("lang", "term_lang"), "term")
    return both.filter("row_lang <> term_lang").select("row", "term", "row_lang", "term_lang")


def orphans_and_duplicates(media: DataFrame, uses: DataFrame, key: str, mark: str) -> DataFrame:
    """Media that nothing uses, and such as share a mark with one of a smaller key: kind orphan, duplicate or both."""
    first = media.groupBy(mark).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"))
    used = uses.select(key).distinct().withColumn("used", F.lit(True))
    rows = media.select(key, mark).join(first, mark).join(used, key, "left")
    twice, free = F.col(key) != F.col("first"), F.col("used").isNull()
    kind = F.when(twice & free, "both").when(twice, "duplicate").when(free, "orphan")
    return rows.withColumn("kind", kind).filter("kind is not null").select(key, "kind", "first")
