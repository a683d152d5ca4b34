"""The merge of duplicates as one job: versions of the table, run until nothing changes, with a log that undoes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agendum.storage import keep, scope, stored

#: What a merged row is called, and what one is that waits.
MERGED, PENDING = "merged", "pending"


def _rank(fill: list[str]) -> Column:
    """Who wins: rows on line, then those with most of the columns to fill, then the smallest id."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in fill), F.lit(0))
    return F.struct(F.coalesce(F.col("online"), F.lit(False)).alias("online"), filled.alias("filled"), (-F.col("id")).alias("least"))


def merge_step(events: DataFrame, keys: list[str], fill: list[str]) -> DataFrame:
    """events with target (the row that a row is merged into, null for none) and, for rows that gain values, these in fill columns.

    Rows of equal keys are one event; null keys meet none, and merged rows take no part. A pending row goes to the best row of the
    stock that has its keys, or where there is none to the best of the pending ones; rows of the stock are not merged into one another.
    A group of which some but not all rows are cancelled is held back. The winner's empty columns are filled from the
    best pending row that has a value. Groups are aggregates with partial sums, so one of any size is no task's burden.
    """
    live = F.col("duplicate_of").isNull() & (F.col("status") != MERGED)
    waits, rank = F.col("status") == PENDING, _rank(fill)
    known = live
    for k in keys:
        known = known & F.col(k).isNotNull()
    gained = [F.max_by(c, F.when(waits & F.col(c).isNotNull(), rank)).alias(f"from_{c}") for c in fill]
    groups = events.filter(known).groupBy(*keys).agg(
        F.max_by("id", F.when(~waits, rank)).alias("stock"), F.max_by("id", F.when(waits, rank)).alias("new"), F.count_if(waits).alias("n_new"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.col("cancelled"), F.lit(False))).alias("off"), *gained,
    )
    groups = groups.filter("(stock is not null and n_new > 0 or n_new > 1) and not (off > 0 and off < n)").withColumn("winner", F.coalesce("stock", "new"))
    met = events.join(groups.select(*keys, "winner", *[f"from_{c}" for c in fill]), keys, "left")
    ours = known & F.col("winner").isNotNull()
    out = met.withColumn("target", F.when(ours & waits & (F.col("id") != F.col("winner")), F.col("winner")))
    wins = ours & (F.col("id") == F.col("winner"))
    return out.select(*events.columns, "target", F.struct(*[F.when(wins & F.col(c).isNull(), F.col(f"from_{c}")).alias(c) for c in fill]).alias("gains"))


def merge_job(events: DataFrame, steps: list[list[str]], fill: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table after all merges and the log of what they changed. events: id, status, duplicate_of, online, cancelled, the keys of steps
    and the columns to fill; ids must differ.

    Each pass takes the steps (lists of key columns) in turn, as what a winner gains may be the key of a later step; the passes end
    with one that changes nothing, so a second job changes nothing either. Every step is a version, written once and read
    back. The log has a row for each row that a version changes: version, id, winner, and prior, the whole row as it was.
    An empty table gives an empty table and log.
    """
    columns = events.columns
    with scope():
        now, version, log, quiet = stored(events, "version"), 0, None, 0
        while quiet < len(steps):
            for keys in steps:
                version += 1
                seen = stored(merge_step(now, keys, fill), "step")
                changes = reduce(lambda a, b: a | b, [F.col("gains")[c].isNotNull() for c in fill], F.col("target").isNotNull())
                entry = seen.filter(changes).select(F.lit(version).alias("version"), "id", F.coalesce("target", "id").alias("winner"), F.struct(*columns).alias("prior"))
                entry = stored(entry, "log")
                log = entry if log is None else log.unionByName(entry)
                quiet = 0 if entry.head(1) else quiet + 1
                if quiet == 0:
                    value = {c: F.coalesce(c, F.col("gains")[c]) for c in fill}
                    value |= {"status": F.when(F.col("target").isNotNull(), MERGED).otherwise(F.col("status")), "duplicate_of": F.coalesce("target", "duplicate_of")}
                    now = stored(seen.select(*[value.get(c, F.col(c)).alias(c) for c in columns]), "version")
                if quiet >= len(steps):
                    break
        done = keep(stored(now, "merged"))
        return done, keep(stored(log, "log"))


def undone(events: DataFrame, log: DataFrame, version: int = 1) -> DataFrame:
    """The table before a version: each row that it or a later one changed as the first of them found it."""
    first = log.filter(F.col("version") >= version).groupBy("id").agg(F.min_by("prior", "version").alias("prior"))
    rows = events.join(first, "id", "left")
    return rows.select(*[F.when(F.col("prior").isNotNull(), F.col("prior")[c]).otherwise(F.col(c)).alias(c) for c in events.columns])
