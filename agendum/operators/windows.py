"""Latest, first and best rows of a key, runs, spans and pages. All orders end in a key without ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agendum.storage import stored


def latest(df: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The n rows of each key that come last in order."""
    rank = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("latest_rank", F.row_number().over(rank)).filter(F.col("latest_rank") <= n).drop("latest_rank")


def last_value_by(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row for each key with the values of its last row: no sort, partial maxima before the shuffle."""
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("last")
    return df.groupBy(*keys).agg(best).select(*keys, "last.*")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of one value in order: keys, value, run_no, run_length, run_first and run_last (of the first order column).

    Equal neighbours share the difference of two row numbers, so one window pass and one group find them.
    """
    all_, same = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys, value).orderBy(*order)
    marked = df.withColumn("run_mark", F.row_number().over(all_) - F.row_number().over(same))
    out = marked.groupBy(*keys, value, "run_mark").agg(F.count(F.lit(1)).alias("run_length"), F.min(order[0]).alias("run_first"), F.max(order[0]).alias("run_last"))
    return out.withColumn("run_no", F.row_number().over(Window.partitionBy(*keys).orderBy("run_first", value))).drop("run_mark")


def longest_run(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The longest run of each key, the earlier among equals, and the number of changes."""
    found = runs(df, keys, order, value)
    best = F.max_by(F.struct(value, "run_length"), F.struct("run_length", -F.col("run_no"))).alias("b")
    return found.groupBy(*keys).agg(best, (F.max("run_no") - 1).alias("changes")).select(*keys, "b.*", "changes")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page number (from 1) of rows in a complete order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def best_with_fallback(df: DataFrame, keys: list[str], strict: Column, relaxed: Column, order: list[Column]) -> DataFrame:
    """For each key the first row that passes the strict test, or else the relaxed one, with how it got there."""
    pass_ = F.when(strict, 0).when(relaxed, 1)
    ranked = df.withColumn("pass_no", pass_).filter("pass_no is not null")
    return ranked.withColumn("best_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("pass_no", *order))).filter("best_rank = 1").drop("best_rank")


def fill_list(first: DataFrame, second: DataFrame, order: list[Column], n: int) -> DataFrame:
    """n rows: those of first in order, then of second."""
    both = first.withColumn("phase", F.lit(0)).unionByName(second.withColumn("phase", F.lit(1)))
    return both.orderBy("phase", *order).limit(n)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds name, each row's number within its keys (from 1) in order, nulls first; keys and order columns of df.

    Rows are dealt out by ranges of keys and order and numbered where they lie, and each range starts after the counts of
    those before it. So a key that holds most rows is spread over all tasks, which a window by key is not; rows of equal
    order are told apart by a salt and may stand in any order among themselves.
    """
    spark, salt = df.sparkSession, f"{name}_salt"
    by = [*keys, *order, salt]
    rows = stored(df.withColumn(salt, F.monotonically_increasing_id()), "unnumbered")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    rows = stored(rows.drop(salt).withColumns({f"{name}_task": F.spark_partition_id(), f"{name}_at": F.monotonically_increasing_id()}), "numbered")
    ranges = rows.groupBy(*keys, f"{name}_task").agg(F.min(f"{name}_at").alias(f"{name}_first"), F.count(F.lit(1)).alias(f"{name}_rows"))
    before = F.sum(f"{name}_rows").over(Window.partitionBy(*keys).orderBy(f"{name}_task")) - F.col(f"{name}_rows")
    ranges = stored(ranges.withColumn(f"{name}_before", before), "ranges").alias("ranges")
    same = [rows[c].eqNullSafe(F.col(f"ranges.`{c}`")) for c in (*keys, f"{name}_task")]
    met = rows.join(ranges.hint("merge"), same)
    return met.select(*[rows[c] for c in df.columns], (F.col(f"{name}_at") - F.col(f"{name}_first") + F.col(f"{name}_before") + 1).alias(name))


def renumbered(df: DataFrame, keys: list[str], position: str, tie: str) -> DataFrame:
    """Positions made 1..n in their order, rows without one last; a key that holds most rows is spread over all tasks."""
    marked = df.withColumn("position_none", F.col(position).isNull())
    placed = numbered(marked, keys, ["position_none", position, tie], "position_new")
    return placed.select(*[F.col("position_new").cast("int").alias(c) if c == position else F.col(c) for c in df.columns])
