"""Aggregations of the catalogue, each in one pass over its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Half-even whole percent; null where there is nothing to divide by."""
    return F.bround(100 * F.try_divide(part.cast("double"), whole.cast("double"))).cast("long")


def funnel(df: DataFrame, stages: list[tuple[str, Column, Column]]) -> DataFrame:
    """stage_no, stage, done, total, remaining and pct of each (name, done, total) stage, from one conditional aggregate.

    Stages need not be nested, so what remains is cut off at 0. An empty table has zero counts and null percents.
    """
    sums = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"{k}{n}") for n, (_, done, total) in enumerate(stages) for k, c in (("d", done), ("t", total))])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("stage_no"), F.lit(s[0]).alias("stage"), F.col(f"d{n}").alias("done"), F.col(f"t{n}").alias("total")) for n, s in enumerate(stages)]))
    out = sums.select(rows.alias("s")).select("s.*")
    return out.withColumns({"remaining": F.greatest(F.lit(0), F.col("total") - F.col("done")), "pct": percent(F.col("done"), F.col("total"))})


def bottleneck(stages: DataFrame, below: int = 90) -> DataFrame:
    """The first stage of a funnel with a lower percent; no row if there is none."""
    return stages.filter(F.col("pct") < below).agg(F.min_by(F.struct("stage_no", "stage", "pct"), "stage_no").alias("s")).filter("s is not null").select("s.*")


def grouping_sets(df: DataFrame, sets: list[tuple[str, ...]], measures: list[Column], view: str = "agendum_sets") -> DataFrame:
    """measures for each of the column sets, with null in the columns a set leaves out, and set_no."""
    columns = sorted({c for s in sets for c in s})
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.grouping_id().alias("gid"), *measures)
    number = F.coalesce(*[F.when(F.col("gid") == sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s), n) for n, s in enumerate(sets)])
    return out.withColumn("set_no", number).drop("gid")


def fill_rates(df: DataFrame, columns: dict[str, tuple[Column, Column]]) -> DataFrame:
    """field, filled, applicable and pct for each name's (value, applicable) pair: not applicable is not missing."""
    tests = []
    for name, (value, applies) in columns.items():
        applies = F.coalesce(applies, F.lit(False))
        has = F.coalesce(F.trim(value.cast("string")) != "", F.lit(False))
        tests.append((name, F.count_if(applies & has), F.count_if(applies)))
    sums = df.agg(*[c.alias(f"{k}{n}") for n, (_, a, b) in enumerate(tests) for k, c in (("f", a), ("a", b))])
    rows = F.explode(F.array(*[F.struct(F.lit(t[0]).alias("field"), F.col(f"f{n}").alias("filled"), F.col(f"a{n}").alias("applicable")) for n, t in enumerate(tests)]))
    return sums.select(rows.alias("r")).select("r.*").withColumn("pct", percent(F.col("filled"), F.col("applicable")))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def conflicting(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with more than one value, and the sorted values."""
    return df.filter(F.col(value).isNotNull()).groupBy(*key).agg(F.sort_array(F.collect_set(value)).alias("conflicting_values")).filter(F.size("conflicting_values") > 1)


def halves_by_group(df: DataFrame, group: str, order: list[str], value: str, least: int = 4) -> DataFrame:
    """Mean and count by group, and the means of the older n // 2 rows and of the rest; groups with fewer than least rows are left out."""
    place = Window.partitionBy(group).orderBy(*order)
    known = df.filter(F.col(value).isNotNull())
    sizes = known.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    old = F.col("place") <= F.floor(F.col("n") / 2)
    ranked = known.withColumn("place", F.row_number().over(place)).join(sizes, group)
    return ranked.groupBy(group).agg(F.max("n").alias("n"), F.avg(value).alias("mean"), F.avg(F.when(old, F.col(value))).alias("older"), F.avg(F.when(~old, F.col(value))).alias("newer"))


def first_reason(reasons: list[tuple[str, Column]], otherwise: str | None) -> Column:
    """The name of the first test that holds, else otherwise (null for None)."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in reasons], F.lit(otherwise))


def held_back(without_gate: Column, gate: Column) -> list[Column]:
    """How many rows a gate lets through and holds back, in one pass."""
    return [F.count_if(without_gate & gate).alias("passed"), F.count_if(without_gate & ~F.coalesce(gate, F.lit(False))).alias("held_back")]
