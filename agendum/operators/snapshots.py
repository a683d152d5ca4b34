"""Changes of state as new snapshots: every write of the catalogue is a DataFrame made from the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_new(old: DataFrame, new: DataFrame, key: str, tie: list[str]) -> DataFrame:
    """old and those of new whose key it lacks; the first of new in tie order counts; rows without a key are left out."""
    first = new.filter(F.col(key).isNotNull()).withColumn("first_rank", F.row_number().over(Window.partitionBy(key).orderBy(*tie))).filter("first_rank = 1").drop("first_rank")
    return old.unionByName(first.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], combine: dict[str, Column] | None = None) -> DataFrame:
    """One row for each key of either side; new values replace old ones, or are combined from o.<column> and n.<column>."""
    combine = combine or {}
    values = [c for c in old.columns if c not in keys]
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    test = same[0]
    for s in same[1:]:
        test = test & s
    marked = new.withColumn("is_new", F.lit(True))
    out = old.alias("o").join(marked.alias("n"), test, "full")
    value = lambda c: combine.get(c, F.when(F.col("n.is_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")))
    return out.select(*[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys], *[value(c).alias(c) for c in values])


def fill_if_empty(new: Column, old: Column) -> Column:
    """The new value unless it is empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def keep_date_while_open(old_flagged: Column, old_resolved: Column, now: Column) -> Column:
    """A flag raised again keeps its first date while it is open."""
    return F.when(old_flagged.isNotNull() & old_resolved.isNull(), old_flagged).otherwise(now)


def last_write(parts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row written for each key."""
    rank = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return parts.withColumn("write_rank", F.row_number().over(rank)).filter("write_rank = 1").drop("write_rank")


def route(score: Column, out_of_scope: Column, not_event: Column, professional: Column, floor: int = 7) -> Column:
    """The next status of an evaluated row."""
    no = F.coalesce(out_of_scope, F.lit(False)) | F.coalesce(not_event, F.lit(False)) | F.coalesce(professional, F.lit(False))
    return F.when(no, "rejected").when(score >= floor, "evaluated").otherwise("published_sub")


def fold_decisions(log: DataFrame, key: str, kind: str, order: list[str]) -> DataFrame:
    """State of each key after its signals, escalations and resolutions in order: status, seen, reopened.

    A signal on a resolved key reopens it and clears its escalation; escalations and resolutions count on open keys only. A key's
    steps are sorted, never gathered in one row.
    """
    signal, up, done = (F.col(kind) == k for k in ("signal", "escalate", "resolve"))
    order_ = Window.partitionBy(key).orderBy(*order)
    before = order_.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    rows = log.withColumns({
        "signals_before": F.count_if(signal).over(before), "turn_before": F.last(F.when(signal | done, F.col(kind)), ignorenulls=True).over(before),
        "resolutions": F.count_if(done).over(order_.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    # What stands between two resolutions is folded first: the last such part tells the status.
    reopens = signal & (F.col("turn_before") == "resolve") & (F.col("signals_before") > 0)
    parts = rows.groupBy(key, "resolutions").agg(F.count_if(signal).alias("seen"), F.count_if(reopens).alias("reopened"), F.min(F.when(signal, at)).alias("opened"), F.max(F.when(up, at)).alias("raised"))
    folded = parts.groupBy(key).agg(F.sum("seen").cast("int").alias("seen"), F.sum("reopened").cast("int").alias("reopened"), F.max_by(F.struct("opened", "raised"), "resolutions").alias("last"))
    status = F.when(F.col("seen") == 0, "none").when(F.col("last.opened").isNull(), "resolved").when(F.col("last.raised") > F.col("last.opened"), "escalated").otherwise("open")
    return folded.select(key, status.alias("status"), "seen", "reopened")


def retain_last(df: DataFrame, order: list[str], n: int = 14) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def unmerge(rows: DataFrame, log: DataFrame, undone: DataFrame, key: str) -> DataFrame:
    """Rows with the status that the merge log kept of them, where the merge is undone; log: key, merge_id, prior_status."""
    prior = log.join(undone, "merge_id", "left_semi")
    first = prior.groupBy(key).agg(F.min_by("prior_status", "merge_id").alias("prior_status"))
    out = rows.join(first, key, "left")
    restored = F.col("prior_status").isNotNull()
    return out.withColumns({"status": F.when(restored, F.col("prior_status")).otherwise(F.col("status")), "duplicate_of": F.when(restored, None).otherwise(F.col("duplicate_of"))}).drop("prior_status")
