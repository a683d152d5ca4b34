"""The catalogue's incremental work as Structured Streaming jobs; each has a batch twin with the same results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder, in the order of their arrival."""
    return spark.readStream.schema(schema).parquet(path)


def once_by_key(events: DataFrame, key: str, time: str, lateness: str = "1 day") -> DataFrame:
    """Each key once; keys are forgotten when the watermark passes them, so the state is bounded."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def usage(events: DataFrame, time: str, label: str, value: str, width: str = "1 day", slide: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Calls and cost of each window and label; a slide makes the windows overlap."""
    frame = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, lateness).groupBy(frame.alias("w"), label).agg(F.count(F.lit(1)).alias("calls"), F.sum(value).alias("cost"))
    return out.select(F.col("w.start").alias("window_start"), label, "calls", "cost")


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    frame = F.session_window(time, gap)
    return events.withWatermark(time, lateness).groupBy(key, frame.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), "n")


def decision_states(log: DataFrame, key: str, kind: str, order: str) -> DataFrame:
    """The fold of signals, escalations and resolutions by key: status, seen and reopened after each batch. Batches must follow
    one another in order; ordered.decision_states() takes rows in any order."""

    def step(keys: tuple, batches, state: GroupState):
        status, seen, reopened = state.get if state.exists else ("none", 0, 0)
        for batch in [pd.concat(list(batches))]:  # a key's rows of one batch come in several pieces
            for k in batch.sort_values(order)[kind]:
                is_open = status in ("open", "escalated")
                if k == "signal":
                    reopened += status == "resolved"
                    status, seen = status if is_open else "open", seen + 1
                elif k == "escalate" and is_open:
                    status = "escalated"
                elif k == "resolve" and is_open:
                    status = "resolved"
        state.update((status, seen, int(reopened)))
        yield pd.DataFrame({key: [keys[0]], "status": [status], "seen": [seen], "reopened": [int(reopened)]})

    kind_of_key = dict(log.dtypes)[key]
    return log.groupBy(key).applyInPandasWithState(step, f"{key} {kind_of_key}, status string, seen int, reopened int", "status string, seen int, reopened int", "update", GroupStateTimeout.NoTimeout)


def failure_streaks(runs: DataFrame, key: str, failed: str, order: str, alarm: int = 3) -> DataFrame:
    """Failures in a row by key; a row each time a streak reaches the alarm, and not again before a success. Batches must follow
    one another in order; ordered.failure_streaks() takes rows in any order."""

    def step(keys: tuple, batches, state: GroupState):
        (streak,) = state.get if state.exists else (0,)
        raised = []
        for batch in [pd.concat(list(batches))]:
            ordered = batch.sort_values(order)
            for bad, at in zip(ordered[failed], ordered[order], strict=True):
                streak = streak + 1 if bad else 0
                if streak == alarm:
                    raised.append(at)
        state.update((streak,))
        yield pd.DataFrame({key: [keys[0]] * len(raised), "raised_at": raised, "streak": [alarm] * len(raised)})

    types = dict(runs.dtypes)
    return runs.groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, raised_at {types[order]}, streak int", "streak int", "append", GroupStateTimeout.NoTimeout)


def stale(runs: DataFrame, key: str, time: str, as_of, tolerance: str) -> DataFrame:
    """Keys whose last run lies further back than the tolerance."""
    last = runs.groupBy(key).agg(F.max(time).alias("last_run"))
    return last.filter(F.col("last_run") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {tolerance}"))


def due(items: DataFrame, scheduled: str, as_of) -> DataFrame:
    return items.filter(F.col(scheduled) <= F.lit(as_of).cast("timestamp"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, written as Parquet; restarts go on from the checkpoint."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_batches(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """work for each batch of what is there now, such as a digest grouped by source or a snapshot's upsert."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(work).trigger(availableNow=True).start().awaitTermination()
