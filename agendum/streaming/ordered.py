"""Folds in order of event time on streams: rows wait in state until the watermark has passed them.

A micro-batch brings a key's rows in any order and in several pieces, and the next batch may bring older ones, so a fold that
takes rows as they come depends on how they were dealt. Here a key keeps the rows that may still be overtaken; a timer, set
to the oldest of a batch, folds what the watermark has passed, in order, and forgets it. What is kept for a key is its fold's
state and the rows of one lateness. The rows of the last lateness wait for later ones to move the watermark on.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 60 * 60 * 1000


@contextmanager
def large_state(spark: SparkSession):
    """Keeps the state of streams that start within on executors' disks; lists and timers need it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _type(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def _append(held, rows: list[tuple]) -> None:
    """Puts rows into a list state in pieces of 10,000: a call of the state and a value there cost far more than a row."""
    if rows:
        held.appendList([(pickle.dumps(rows[n : n + 10_000], 5),) for n in range(0, len(rows), 10_000)])


def _held(held) -> list[tuple]:
    return [r for (piece,) in held.get() for r in pickle.loads(piece)]


def _taken(held, rows: Iterator[pd.DataFrame], columns: list[str]) -> int | None:
    """Puts a batch's rows of a key, their time first, into a list state; the oldest time."""
    oldest = None
    for frame in rows:
        found = [tuple(None if x != x else x for x in r) for r in zip(*(frame[c].tolist() for c in columns), strict=True)]
        _append(held, found)
        oldest = min([r[0] for r in found] + ([] if oldest is None else [oldest]), default=None)
    return oldest


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")


def ordered_fold(rows: DataFrame, key: str, time: str, columns: list[str], start: tuple, step: Callable, out: str, lateness: str = "1 day", last_only: bool = False, buckets: int = 2048) -> DataFrame:
    """What step makes of each key's rows in order of time, then of columns (nulls first); start with large_state().

    step(state, at, values) gives the next state and a list of output rows of schema out, which follow the key; at is the row's
    time in microseconds. last_only: of each turn only a key's last output row is given, so a reader that takes
    the newest one for each key has the fold's result. Rows without a time or a key take no part; rows later than lateness are dropped.

    Keys share a state by buckets of their hash: what a turn of a state costs is that of hundreds of rows, however few a key has. A turn
    rewrites the fold states of a bucket's keys, so with very many keys more buckets are due.
    """
    from pyspark.sql.streaming import StatefulProcessor

    names, taken = [key, *[f.split()[0] for f in out.split(", ")]], ["at", *[f"v{i}" for i in range(len(columns))], "k"]

    class Fold(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.waiting, self.folded = handle, handle.getListState("waiting", "rows binary"), handle.getValueState("folded", "mark bigint, states binary")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            oldest = _taken(self.waiting, rows, taken)
            if oldest is not None:
                self.handle.registerTimer(int(oldest) // 1000 + 1)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            mark = timerValues.getCurrentWatermarkInMs()
            before, states = self.folded.get() or (None, None)
            if before == mark:  # each batch has set a timer; the first to go off has done it
                return
            states, held = pickle.loads(states) if states else {}, _held(self.waiting)
            ready = sorted((r for r in held if r[0] // 1000 < mark), key=lambda r: tuple((x is not None, x) for x in r[:-1]))
            rest = [r for r in held if r[0] // 1000 >= mark]
            made, last = [], {}
            for at, *values, k in ready:
                states[k], given = step(states.get(k, start), at, values)
                if given and last_only:
                    last[k] = (k, *given[-1])
                else:
                    made += [(k, *r) for r in given]
            made += last.values()
            self.folded.update((mark, pickle.dumps(states, 5)))
            self.waiting.clear()
            if rest:
                _append(self.waiting, rest)
                self.handle.registerTimer(int(min(r[0] for r in rest)) // 1000 + 1)
            if made:
                yield pd.DataFrame(made, columns=names)

    dated = rows.withWatermark(time, lateness).filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    dated = dated.select(_bucket(key, buckets), time, F.unix_micros(time).alias("at"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)], F.col(key).alias("k"))
    return dated.groupBy("bucket").transformWithStateInPandas(Fold(), f"{key} {_type(rows, key)}, {out}", "Append", "EventTime")


def decision_states(log: DataFrame, key: str, kind: str, time: str, tie: str, lateness: str = "1 day") -> DataFrame:
    """The fold of signals, escalations and resolutions by key in order of time and tie: a row status, seen, reopened and folded_to
    (microseconds) each time that the watermark has passed more of a key's rows. The newest row is the key's state."""

    def step(state, at, values):
        (status, seen, reopened), (_, k) = state, values
        is_open = status in ("open", "escalated")
        if k == "signal":
            state = (status if is_open else "open", seen + 1, reopened + (status == "resolved"))
        elif k == "escalate" and is_open:
            state = ("escalated", seen, reopened)
        elif k == "resolve" and is_open:
            state = ("resolved", seen, reopened)
        return state, [(*state, at)]

    out = "status string, seen int, reopened int, folded_to bigint"
    return ordered_fold(log, key, time, [tie, kind], ("none", 0, 0), step, out, lateness, last_only=True)


def failure_streaks(runs: DataFrame, key: str, failed: str, time: str, tie: str, alarm: int = 3, lateness: str = "1 day") -> DataFrame:
    """A row (raised_at in microseconds, streak) each time a key has failed alarm times in a row, and not again before a success."""

    def step(state, at, values):
        streak = state[0] + 1 if values[1] else 0
        return (streak,), [(at, streak)] if streak == alarm else []

    return ordered_fold(runs, key, time, [tie, failed], (0,), step, "raised_at bigint, streak int", lateness)


def reopened(attempts: DataFrame, key: str, time: str, days: int, lateness: str = "1 day", buckets: int = 2048) -> DataFrame:
    """A row (last_attempt in microseconds) for each attempt that its key does not repeat within days, once the watermark has
    passed them; equal times count once. A timer goes off when the oldest attempt's days are over, so a key that is never tried again
    is given back too. A key's state is the attempts of its last days and lateness, and nothing after that; keys share states as in ordered_fold()."""
    from pyspark.sql.streaming import StatefulProcessor

    name, wait = key, days * DAY_MS

    class Reopen(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.tried, self.looked = handle, handle.getListState("tried", "rows binary"), handle.getValueState("looked", "mark bigint")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            oldest = _taken(self.tried, rows, ["at", "k"])
            if oldest is not None:
                self.handle.registerTimer(int(oldest) // 1000 + wait + 1)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            mark = timerValues.getCurrentWatermarkInMs()
            if self.looked.get() == (mark,):
                return
            tried, left, rest = defaultdict(set), [], []
            for a, k in _held(self.tried):
                tried[k].add(a)
            for k, times in tried.items():
                times = sorted(times)
                over = [a for a in times if a // 1000 + wait < mark]
                left += [(k, a) for a, b in zip(over, [*times, None][1:], strict=False) if b is None or b > a + 1000 * wait]
                rest += [(a, k) for a in times[len(over) :]]
            self.tried.clear()
            if rest:
                self.looked.update((mark,))
                _append(self.tried, rest)
                self.handle.registerTimer(int(min(a for a, _ in rest)) // 1000 + wait + 1)
            else:
                self.looked.clear()
            if left:
                yield pd.DataFrame(left, columns=[name, "last_attempt"])

    dated = attempts.withWatermark(time, lateness).filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(_bucket(key, buckets), time, F.unix_micros(time).alias("at"), F.col(key).alias("k"))
    return dated.groupBy("bucket").transformWithStateInPandas(Reopen(), f"{key} {_type(attempts, key)}, last_attempt bigint", "Append", "EventTime")
