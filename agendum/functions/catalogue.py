"""Rules of the event catalogue that work on lists of words, windows and places; the lists are parameters."""

from __future__ import annotations

import re
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agendum.functions import text as tx
from agendum.functions.text import whole
from agendum.operators.joins import small


def _any_word(words: list[str]) -> str:
    return whole("|".join(sorted((re.escape(w) for w in words), key=len, reverse=True)))


def excluded(title: Column, body: Column, everywhere: list[str], in_title: list[str]) -> Column:
    """Words that exclude an event wherever they stand, and words that do so in its title only; folded."""
    both = tx.fold(F.concat_ws(" ", title, body))
    tests = [both.rlike(_any_word(everywhere))] if everywhere else []
    tests += [tx.fold(title).rlike(_any_word(in_title))] if in_title else []
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def out_of_scope(text: Column, perimeter: list[str], outside: list[str]) -> Column:
    """A place outside is named and none inside."""
    t = tx.fold(text)
    return F.coalesce(t.rlike(_any_word(outside)) & ~t.rlike(_any_word(perimeter)), F.lit(False))


def first_match(text: Column, reasons: list[tuple[str, str]]) -> Column:
    """The name of the first pattern that the folded text holds; null if none."""
    t = tx.fold(text)
    return F.coalesce(*[F.when(t.rlike(pattern), F.lit(name)) for name, pattern in reasons])


def canonical(value: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first rule whose part stands in the folded value."""
    t = tx.fold(value)
    return F.coalesce(*[F.when(t.contains(part), F.lit(name)) for part, name in rules], F.lit(default))


def doubt_or_absence(label: Column, absent: str, doubt: str) -> Column:
    """What a check's label says: absence patterns come first and win, then a question mark, then doubt patterns."""
    t = tx.fold(label)
    return F.when(t.rlike(absent), "absence").when(F.contains(label, F.lit("?")), "doubt").when(t.rlike(doubt), "doubt").otherwise("absence")


def umbrella_tags(events: DataFrame, moments: DataFrame, key: str, start: str, territory: str, source: str) -> DataFrame:
    """Tags of umbrella events for each event: every declared condition must hold. moments: slug, first, last, territories,
    sources; an empty list demands nothing; the event's start, not its span, must lie in the window. Moments are few."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    fits = (F.col(start).between(F.col("first"), F.col("last"))) & (none("territories") | F.array_contains("territories", F.col(territory))) & (none("sources") | F.array_contains("sources", F.col(source)))
    return events.join(small(moments), fits).groupBy(key).agg(F.sort_array(F.collect_set("slug")).alias("tags"))


def lead_days(title: Column, themes: list[tuple[str, list[str], int]], default: int) -> Column:
    """How many days ahead an event of a named theme is published: the first theme whose word the title holds."""
    t = tx.fold(title)
    return F.coalesce(*[F.when(t.rlike(_any_word(words)), F.lit(days)) for _, words, days in themes], F.lit(default))


def season_level(day: Column, windows: list[tuple[str, str, str]], otherwise: str) -> Column:
    """The level of the first MM-dd window (first, last, level) that holds the day; windows may wrap the New Year."""
    from agendum.functions.scoring import in_season

    return F.coalesce(*[F.when(in_season(day, a, b), F.lit(level)) for a, b, level in windows], F.lit(otherwise))


def next_changes(spark, windows: list[tuple[str, str, str]], otherwise: str, as_of: date, days: int = 365) -> DataFrame:
    """Days within the next days on which the level changes, with the level before and after."""
    grid = spark.range(0, days + 1).select(F.date_add(F.lit(as_of), F.col("id").cast("int")).alias("day"))
    level = grid.withColumn("level", season_level(F.col("day"), windows, otherwise))
    before = F.lag("level").over(Window.orderBy("day"))  # a row for each day of a year
    return level.withColumn("before", before).filter("before is not null and before <> level").select("day", "before", "level")


def practical_info(text: Column, families: dict[str, str]) -> Column:
    """map of family to the first match of its pattern in the text; families that do not match are left out."""
    found = F.create_map(*[x for name, p in families.items() for x in (F.lit(name), F.nullif(F.trim(F.regexp_extract(text, p, 0)), F.lit("")))])
    return F.map_filter(found, lambda _, v: v.isNotNull())


def unfolded_info(info: Column, families: list[str]) -> dict[str, Column]:
    """A column for each family's first value of a JSON map of arrays."""
    parsed = F.from_json(info, "map<string, array<string>>")
    return {f"ip_{n}": F.get(F.try_element_at(parsed, F.lit(n)), F.lit(0)) for n in families}


def labelled_value(text: Column, labels: list[str]) -> Column:
    """What follows the first of the labels and a colon, up to the end of its line."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?im)^\s*(?:" + "|".join(map(re.escape, labels)) + r")\s*[:：]\s*(.+?)\s*$", 1)), F.lit(""))


def reporting_tense(text: Column, past: str, upcoming: str, around: int = 80) -> Column:
    """Excerpts that tell of an event as over: a past sign with no upcoming one in the same stretch."""
    stretches = F.regexp_extract_all(text, F.lit(rf"(?is)(.{{0,{around}}}(?:{past}).{{0,{around}}})"), 1)
    return F.filter(stretches, lambda s: ~tx.fold(s).rlike(upcoming))


def acronyms(text: Column, known: dict[str, str]) -> Column:
    """Known acronyms that stand in the text without their long form."""
    return F.array_compact(F.array(*[F.when(text.rlike(whole(re.escape(a))) & ~F.lower(text).contains(long.lower()), F.lit(a)) for a, long in known.items()]))


def expanded_once(text: Column, known: dict[str, str]) -> Column:
    """The first mention of each acronym followed by its long form in brackets, unless the text has it."""
    for a, long in known.items():
        text = F.when(F.lower(text).contains(long.lower()), text).otherwise(F.regexp_replace(text, rf"(?s)^(.*?){whole(re.escape(a))}", f"$1{a} ({long})"))
    return text


def hashtags(town: Column, category: Column, fixed: list[str], most: int = 5) -> Column:
    """Tags of letters and digits only, without repeats."""
    tag = lambda c: F.concat(F.lit("#"), F.replace(tx.folded_key(c), F.lit(" "), F.lit("")))
    tags = F.array(F.when(F.length(F.trim(town)) > 0, tag(town)), F.when(F.length(F.trim(category)) > 0, tag(category)), *[F.lit(f"#{t}") for t in fixed])
    return F.slice(F.array_distinct(F.array_compact(tags)), 1, most)


def schema_org_event(row: dict[str, Column]) -> Column:
    """A schema.org Event as JSON; what is null or empty is left out."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    place = F.when(filled(row["place"]).isNotNull() | filled(row["town"]).isNotNull(), F.struct(F.lit("Place").alias("@type"), filled(row["place"]).alias("name"), filled(row["town"]).alias("address")))
    return F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), filled(row["title"]).alias("name"), row["start"].cast("string").alias("startDate"),
        F.coalesce(row["end"], row["start"]).cast("string").alias("endDate"), place.alias("location"), filled(row["image"]).alias("image"), filled(row["url"]).alias("url"),
    ))


def header_spans(columns: DataFrame, group: str, position: str) -> DataFrame:
    """Spans of neighbouring columns of one group: group, first position and width."""
    order = Window.orderBy(position)  # a row for each column of a sheet
    mark = columns.withColumn("changed", (~F.col(group).eqNullSafe(F.lag(group).over(order))).cast("int")).withColumn("span", F.sum("changed").over(order))
    return mark.groupBy("span", group).agg(F.min(position).alias("first_position"), F.count(F.lit(1)).alias("width")).drop("span")


def similarity_ratio(name_a: str, name_b: str):
    """A pandas function of two title columns: 2 * matched characters / all, by longest common blocks (difflib), folded first.

    Only pairs that share tokens should come here; lengths that cannot reach the floor give 0 at once.
    """
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def of(x, y):
            if not x or not y:
                return 0.0
            m = SequenceMatcher(None, x, y, autojunk=False)
            return m.ratio() if m.real_quick_ratio() >= 0.5 and m.quick_ratio() >= 0.5 else 0.0

        return pd.Series([of(x, y) for x, y in zip(a, b, strict=True)])

    return ratio(tx.folded_key(F.col(name_a)), tx.folded_key(F.col(name_b)))


def best_matches(pairs: DataFrame, key: str, name_a: str, name_b: str, other: str, floor: float = 0.5, k: int = 3) -> DataFrame:
    """The k most similar titles of each key above the floor; ties to the smaller id."""
    scored = pairs.withColumn("ratio", similarity_ratio(name_a, name_b)).filter(F.col("ratio") >= floor)
    rank = Window.partitionBy(key).orderBy(F.desc("ratio"), other)
    return scored.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def venue_conflicts(events: DataFrame, registry: DataFrame, key: str, venue: str, town: str) -> DataFrame:
    """Events whose venue the registry has in another town; registry: venue, town."""
    known = registry.select(tx.folded_key(F.col("venue")).alias("v"), F.col("town").alias("registered_town"))
    known = known.groupBy("v").agg(F.collect_set("registered_town").alias("towns"))
    rows = events.select(key, F.col(town).alias("town"), tx.folded_key(F.col(venue)).alias("v")).join(known, "v")
    fits = F.exists("towns", lambda t: tx.folded_key(t) == tx.folded_key(F.col("town")))
    return rows.filter(F.col("town").isNotNull() & ~fits).select(key, "town", F.array_join(F.sort_array("towns"), ",").alias("registered_towns"))


def provenance(source: Column, families: dict[str, list[str]], otherwise: str = "unresolved") -> Column:
    """The family whose list names the source; totals over families add up to all rows."""
    return F.coalesce(*[F.when(source.isin(*names), F.lit(family)) for family, names in families.items()], F.lit(otherwise))
