"""One-to-one matching by rank: who gives way to whom when several rows want the same one.

Joins are of sorted sides: what Spark reckons from the size of dictionary-coded files is far too small for a broadcast, which
would go through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agendum.operators.windows import numbered
from agendum.storage import keep, scope, stored


def greedy_matching(pairs: DataFrame, left: str, right: str, rank: list[str], left_size: DataFrame | None = None, right_size: DataFrame | None = None) -> DataFrame:
    """The pairs that are taken when all are looked at in order of rank, and a pair is taken if both sides are still free.

    Ties of rank are settled by left, then right, so there is one result. A side may stand for several rows alike: left_size (left,
    size) and right_size (right, size) say how many (one, where none is given); then a pair takes as many as both have left. Rows
    left, right, rank, units, left_from and right_from: how many were taken, and how many each side had given before.

    A pair that is the best of both its sides is taken by any order that respects rank, so each round takes all such pairs
    and drops what a side without rows left had besides; the rounds end when no pair is left. The sides' best are
    minima with partial sums, so a side that is in very many pairs costs one row for each task. Repeated pairs count once with their best
    rank; pairs with a null side take no part; an empty table gives an empty result.
    """
    order, rank = F.struct(*dict.fromkeys([*rank, left, right])), [c for c in rank if c not in (left, right)]
    sized = lambda df, side, own: df.groupBy(side).agg(F.lit(1).cast("long").alias("size")) if own is None else own.select(side, F.col("size").cast("long").alias("size"))
    with scope():
        rest = pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left, right).agg(F.min(F.struct(*(rank or [left]))).alias("r"))
        rest = stored(rest.select(left, right, *[F.col("r")[c].alias(c) for c in rank]), "pairs")
        free = {side: stored(sized(rest, side, own).filter("size > 0").withColumn("given", F.lit(0).cast("long")), "free") for side, own in ((left, left_size), (right, right_size))}
        for side in (left, right):  # a side that stands for no row has nothing to give
            rest = rest.join(free[side].select(side).hint("merge"), side, "left_semi")
        rest = stored(rest, "pairs")
        taken = rest.limit(0).select(left, right, *rank, *[F.lit(0).cast("long").alias(c) for c in ("units", "left_from", "right_from")])
        while rest.head(1):
            best = lambda side: rest.groupBy(side).agg(F.min(order).alias("best_pair")).select("best_pair.*")  # noqa: B023, E731
            ready = lambda side, p: free[side].select(side, F.col("given").alias(f"{p}_from"), (F.col("size") - F.col("given")).alias(f"{p}_free"))
            won = best(left).join(best(right).select(left, right).hint("merge"), [left, right]).join(ready(left, "left").hint("merge"), left).join(ready(right, "right").hint("merge"), right)
            won = stored(won.select(left, right, *rank, F.least("left_free", "right_free").alias("units"), "left_from", "right_from"), "matched")
            taken = taken.unionByName(won)
            for side in (left, right):
                more = free[side].join(won.select(side, "units").hint("merge"), side, "left").select(side, "size", (F.col("given") + F.coalesce("units", F.lit(0))).alias("given"))
                free[side] = stored(more, "free")
            spent = lambda side: won.select(side).join(free[side].filter("given >= size").select(side).hint("merge"), side)  # noqa: B023, E731
            rest = stored(rest.join(spent(left).hint("merge"), left, "left_anti").join(spent(right).hint("merge"), right, "left_anti"), "pairs")
        return keep(stored(taken, "matching"))


def renamed_once(rows: DataFrame, key: str, old: str, wanted: str, town: str) -> DataFrame:
    """Which slug each row gets: key, slug, redirect (the old one, where it changes) and refused (the wanted one, where it got none).

    A row asks for wanted, and where that is not to be had for wanted with its town. A slug is not to be had if another row bears
    it now, or if a row of a smaller key got it; bearers are not asked to move, so what they bear is not freed. A row that
    gets neither keeps its old slug and is listed by refused. Rows without a wish, or who bear it already, keep theirs.
    """
    slugs = F.array(F.struct(F.lit(1).alias("choice"), F.col(wanted).alias("slug")), F.struct(F.lit(2).alias("choice"), F.concat_ws("-", wanted, F.nullif(F.col(town), F.lit(""))).alias("slug")))
    asking = rows.filter(F.coalesce(F.col(wanted) != "", F.lit(False)) & ~F.col(old).eqNullSafe(F.col(wanted)))
    pairs = asking.select(F.col(key).alias("who"), F.col(old).alias("own"), F.explode(slugs).alias("s")).select("who", "own", "s.*")
    borne = rows.filter(F.col(old).isNotNull()).groupBy(F.col(old).alias("slug")).agg(F.lit(True).alias("borne"))
    pairs = pairs.join(borne.hint("merge"), "slug", "left").filter(F.col("borne").isNull() | F.col("slug").eqNullSafe(F.col("own")))
    got = greedy_matching(pairs.select("who", "slug", "choice"), "who", "slug", ["who", "choice"]).select(F.col("who").alias(key), F.col("slug").alias("new_slug"))
    out = rows.join(got.hint("merge"), key, "left")
    wish = F.coalesce(F.col(wanted) != "", F.lit(False)) & ~F.col(old).eqNullSafe(F.col(wanted))
    slug = F.coalesce("new_slug", old)
    return out.select(key, slug.alias("slug"), F.when(slug != F.col(old), F.col(old)).alias("redirect"), F.when(wish & F.col("new_slug").isNull(), F.col(wanted)).alias("refused"))


def _zipped(taken: DataFrame, sides: DataFrame, stage: int) -> DataFrame:
    """The rows (a, b) behind matched classes: the k-th that a class of one side gives goes to the k-th that the other gives."""
    units = taken.select("lc", "rc", "left_from", "right_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)).alias("u"))
    units = units.select("lc", "rc", (F.col("left_from") + F.col("u") + 1).alias("ln"), (F.col("right_from") + F.col("u") + 1).alias("rn"))
    side = lambda on, c, n, to: sides.filter(F.col("on") == on).select(F.col("class").alias(c), F.col("n").alias(n), F.col("id").alias(to))
    return units.join(side(False, "lc", "ln", "a").hint("merge"), ["lc", "ln"]).join(side(True, "rc", "rn", "b").hint("merge"), ["rc", "rn"]).select("a", "b", F.lit(stage).alias("stage"))


def _classed(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with class (the smallest id of their side that is alike) and n (their number in it), and the classes with size."""
    classes = stored(rows.groupBy("on", *by).agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("size")), "classes")
    other = classes.select(*[F.col(c).alias(f"c_{c}") for c in ("on", *by)], "class")
    named = rows.join(other.hint("merge"), [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in ("on", *by)]).select("on", "id", "class")
    return stored(numbered(named, ["on", "class"], ["id"], "n"), "members"), classes


def _agreeing(classes: DataFrame, same: list[str]) -> DataFrame:
    """Pairs lc, rc of a class off line and one on line with equal values of same, which they keep, whose days are equal or one
    unknown: three pairs at most for each class and day, and none of different days."""
    side = lambda on, p: classes.filter(F.col("on") == on).select(*same, F.col("day").alias(f"{p}d"), F.col("class").alias(f"{p}c"))
    a, b = side(False, "l"), side(True, "r")
    equal = a.filter("ld is not null").join(b.filter("rd is not null").withColumnRenamed("rd", "ld").hint("merge"), [*same, "ld"])
    open_ = a.filter("ld is null").join(b.hint("merge"), same).select(*same, "lc", "rc").unionByName(a.filter("ld is not null").join(b.filter("rd is null").hint("merge"), same).select(*same, "lc", "rc"))
    return equal.select(*same, "lc", "rc").unionByName(open_)


def _alike_sets(sets: DataFrame) -> DataFrame:
    """Pairs ls, rs of a set of words off line and one on line, of one block, that tell of one event, with fewer: minus the words shared."""
    words = sets.select("on", "block", "set", F.size("w").alias("size"), F.explode("w").alias("t"))
    often = words.groupBy("block", "t").agg(F.count(F.lit(1)).alias("n"), F.bool_or("on").alias("there"), F.bool_or(~F.col("on")).alias("here"))
    words = words.join(often.filter("here and there").drop("here", "there").hint("merge"), ["block", "t"])
    ranked = words.groupBy("on", "block", "set", "size").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("s"))
    # Words without a partner on the other side are the rarest of all: what is asked for counts them in.
    asked = F.expr("slice(s, 1, greatest(0, size - greatest(2, cast(ceil(size / 2) as int)) + 1 - (size - size(s))))")
    ranked = stored(ranked.select("on", "block", "set", "size", asked.alias("short"), F.expr("slice(s, 1, size(s) - least(1, size(s)))").alias("long")), "ranked")
    side = lambda on, c, p: ranked.filter(F.col("on") == on).select("block", F.col("set").alias(f"{p}s"), F.col("size").alias(f"{p}n"), F.explode(F.transform(c, lambda x: x["t"])).alias("t"))
    one = side(False, "short", "l").join(side(True, "long", "r").hint("merge"), ["block", "t"]).filter("ln <= rn")
    two = side(False, "long", "l").join(side(True, "short", "r").hint("merge"), ["block", "t"]).filter("ln > rn")
    met = one.select("ls", "rs").unionByName(two.select("ls", "rs")).distinct()
    for on, p in ((False, "l"), (True, "r")):
        met = met.join(sets.filter(F.col("on") == on).select(F.col("set").alias(f"{p}s"), F.col("w").alias(f"{p}w")).hint("merge"), f"{p}s")
    shared, year = F.array_intersect("lw", "rw"), r"^\d{4}$"
    years = lambda c: F.filter(c, lambda w: w.rlike(year))
    contrary = (F.size(years("lw")) > 0) & (F.size(years("rw")) > 0) & ~F.arrays_overlap(years("lw"), years("rw"))
    enough = (F.size(F.filter(shared, lambda w: ~w.rlike(year))) >= 2) & (2 * F.size(shared) >= F.least(F.size("lw"), F.size("rw")))
    return met.filter(enough & ~contrary).select("ls", "rs", (-F.size(shared)).alias("fewer"))


def _stage(rows: DataFrame, by: list[str], pairs_of, number: int) -> tuple[DataFrame, DataFrame]:
    """The rows (a, b, stage) that are taken, and the ids off line that had a candidate. pairs_of: the ranked class pairs of classes."""
    members, classes = _classed(rows, by)
    pairs = stored(pairs_of(classes), "candidates")
    sizes = lambda on, c: classes.filter(F.col("on") == on).select(F.col("class").alias(c), "size")
    taken = greedy_matching(pairs, "lc", "rc", ["fewer"], sizes(False, "lc"), sizes(True, "rc"))
    had = members.filter("not on").join(pairs.select(F.col("lc").alias("class")).distinct().hint("merge"), "class", "left_semi").select("id")
    return stored(_zipped(taken, members, number), "zipped"), had


def reconciled(offline: DataFrame, online: DataFrame, key: str, link: str, words: Column, day: str, blocks: list[str]) -> DataFrame:
    """For each row that is off line the one on line that stands for it: key, verdict (sister, conflict or gone), sister, stage.

    Stage 1 takes rows of one link, a merge's winner say; stage 2, of what is left on both sides, rows of equal blocks whose
    titles share two words that are no years and half of the shorter one's, and hold no contrary years. Blocks hold the language, so an
    original and its translation, which should both be on line, never stand for each other. In both stages days agree: they
    are equal, or one is unknown. Each row on line stands for one at most. Pairs are taken in order of the words shared, most first,
    then of their classes' smallest ids; a class is the rows of a side that are alike in all that is looked at, and gives its rows by
    id. A row that had a candidate and got none is a conflict. Rows without an id take no part; words: an array, repeats count once.

    Titles are compared as distinct sets of words, not as rows. Of two sets that share enough, one of the shorter one's words but the
    commonest half stands in the other: these are asked for, so common words that nearly all titles have make no pairs.
    """
    columns = lambda df, on: df.select(
        F.lit(on).alias("on"), F.col(key).cast("long").alias("id"), F.col(link).alias("link"), F.array_sort(F.array_distinct(words)).alias("w"), F.col(day).alias("day"),
        F.to_json(F.struct(*blocks), {"ignoreNullFields": "false"}).alias("block"),
    )

    def by_words(classes: DataFrame) -> DataFrame:
        sets = stored(classes.groupBy("on", "block", "w").agg(F.min("class").alias("set")), "sets")
        alike = stored(_alike_sets(sets).withColumn("met", F.monotonically_increasing_id()), "alike")
        dated = classes.join(sets.hint("merge"), ["on", "block", "w"]).select("on", "set", "day", "class")
        met = [dated.filter(F.col("on") == on).join(alike.hint("merge"), F.col("set") == F.col(c)).select("on", "day", "class", "met", "fewer") for on, c in ((False, "ls"), (True, "rs"))]
        return _agreeing(met[0].unionByName(met[1]), ["met", "fewer"]).select("lc", "rc", "fewer")

    with scope():
        rows = stored(columns(offline, False).unionByName(columns(online, True)).filter("id is not null"), "sides")
        first, had = _stage(rows.filter("link is not null"), ["link", "day"], lambda classes: _agreeing(classes, ["link"]).select("lc", "rc", F.lit(0).alias("fewer")), 1)
        used = first.select(F.lit(False).alias("on"), F.col("a").alias("id")).unionByName(first.select(F.lit(True).alias("on"), F.col("b").alias("id")))
        left = stored(rows.join(used.hint("merge"), ["on", "id"], "left_anti").filter(F.size("w") >= 2), "left")
        second, had2 = _stage(left, ["block", "w", "day"], by_words, 2)
        had = had.unionByName(had2).distinct().select(F.col("id").alias("a"), F.lit(True).alias("had"))
        out = rows.filter("not on").select(F.col("id").alias("a")).join(first.unionByName(second).hint("merge"), "a", "left").join(had.hint("merge"), "a", "left")
        verdict = F.when(F.col("b").isNotNull(), "sister").when(F.col("had"), "conflict").otherwise("gone")
        return keep(stored(out.select(F.col("a").alias(key), verdict.alias("verdict"), F.col("b").alias("sister"), "stage"), "reconciled"))
