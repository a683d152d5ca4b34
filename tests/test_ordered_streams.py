"""Streams whose rows come out of order, in several pieces and late, against their batch twins."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from agendum.operators import audits, pairing, snapshots
from agendum.streaming import jobs, ordered, rematch

START = datetime(2026, 1, 1)


def test_a_large_key_in_mixed_order_folds_as_the_batch(spark, tmp_path):
    rng = random.Random(2)
    size = 20_000
    rows = [("big", n, rng.choice(["signal", "resolve", "escalate", "x", None]), START + timedelta(seconds=n // 2), rng.random() < 0.6) for n in range(size)]
    rows += [(f"k{n % 5}", n, rng.choice(["signal", "resolve"]), START + timedelta(seconds=n * 7), n % 3 > 0) for n in range(300)]
    rng.shuffle(rows)
    last = ("end", 0, "signal", START + timedelta(days=9), False)  # moves the watermark past all others
    schema = "k string, n long, kind string, ts timestamp, failed boolean"
    for part in (rows[:15_000], rows[15_000:18_000], rows[18_000:], [last]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    df = spark.createDataFrame(rows, schema)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    size_, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(size_, "2000")
    try:
        with ordered.large_state(spark):
            jobs.run_available(ordered.decision_states(stream(), "k", "kind", "ts", "n"), f"{tmp_path}/o1", f"{tmp_path}/c1")
            jobs.run_available(ordered.failure_streaks(stream(), "k", "failed", "ts", "n"), f"{tmp_path}/o2", f"{tmp_path}/c2")
            jobs.run_available(ordered.failure_streaks(stream(), "k", "failed", "ts", "n"), f"{tmp_path}/o2", f"{tmp_path}/c2")  # nothing new
    finally:
        spark.conf.set(size_, before)
    states = spark.read.parquet(f"{tmp_path}/o1").groupBy("k").agg(F.max_by(F.struct("status", "seen", "reopened"), "folded_to").alias("s")).select("k", "s.*")
    assert sorted(map(tuple, states.collect())) == sorted(map(tuple, snapshots.fold_decisions(df, "k", "kind", ["ts", "n"]).collect()))
    raised = spark.read.parquet(f"{tmp_path}/o2").groupBy("k").count()
    assert {tuple(r) for r in raised.collect()} == {tuple(r) for r in audits.failure_islands(df, "k", "failed", ["ts", "n"]).groupBy("k").count().collect()}


def test_a_key_is_reopened_by_its_timer(spark, tmp_path):
    at = lambda days: START + timedelta(days=days)
    parts = [[("a", at(0)), ("b", at(0)), ("a", at(3))], [("a", at(5)), ("c", at(4))], [("z", at(11.5))], [("z", at(30))]]
    for part in parts:
        spark.createDataFrame(part, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in")
        with ordered.large_state(spark):  # each part in a run of its own: the timers outlive restarts
            jobs.run_available(ordered.reopened(stream, "k", "ts", 4), f"{tmp_path}/out", f"{tmp_path}/c")
    got = sorted((r.k, r.last_attempt) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    micros = lambda days: int((at(days) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert got == [("a", micros(5)), ("b", micros(0)), ("c", micros(4)), ("z", micros(11.5))]


def test_late_events_change_verdicts_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    words = ["festival", "musique", "montagne", "peinture", "théâtre", "lumière", "jardin", "cuisine"]
    rows = [("kit" if n % 3 == 0 else "event", n, " ".join(rng.sample(words, rng.choice([2, 3]))), rng.choice(["nord", "sud", None])) for n in range(60)]
    schema = "side string, id long, title string, territory string"
    df = spark.createDataFrame(rows, schema)
    kits = df.filter("side = 'kit'").select(F.col("id").alias("kit"), "title", "territory")
    want = sorted(map(tuple, pairing.press_kits(kits, df.filter("side = 'event'").select("id", "title", "territory")).collect()))
    rng.shuffle(rows)
    for k, part in enumerate((rows[:20], rows[20:45], rows[45:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")  # restarts between batches
        got = rematch.rematched(stream, f"file://{tmp_path}/state", f"{tmp_path}/c")
        assert k < 2 or sorted(map(tuple, got.select("kit", "id").collect())) == want
    rematch.rematch("kit", "event", f"file://{tmp_path}/state")(spark.createDataFrame(rows[45:], schema), 2)  # the last batch once more
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/state/verdicts/batch-2").select("kit", "id").collect())) == want and want


def test_a_batch_of_a_key_is_few_values_in_its_state():
    class Held:
        def __init__(self):
            self.values = []

        def appendList(self, values):
            self.values += values

        def get(self):
            return iter(self.values)

    rows = [(1_000_000 - n, None if n % 7 == 0 else n, f"k{n}") for n in range(25_000)]
    frame = lambda part: pd.DataFrame({"v1": [r[2] for r in part], "at": [r[0] for r in part], "v0": [r[1] for r in part]})
    held = Held()
    assert ordered._taken(held, iter([frame(rows[:24_000]), frame(rows[24_000:]), frame([])]), ["at", "v0", "v1"]) == 1_000_000 - 24_999
    assert len(held.values) == 4 and ordered._held(held) == rows
    assert ordered._taken(held, iter([]), ["at"]) is None and len(held.values) == 4


def test_keys_share_a_state_by_buckets(spark, tmp_path):
    rows = [(f"k{n % 40}", n, n % 3 > 0, START + timedelta(seconds=n * 7)) for n in range(400)] + [("end", 0, False, START + timedelta(days=9))]
    spark.createDataFrame(rows, "k string, n long, failed boolean, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, n long, failed boolean, ts timestamp").parquet(f"{tmp_path}/in")
    folded = ordered.ordered_fold(stream, "k", "ts", ["n", "failed"], (0,), lambda s, at, v: ((s[0] + v[0],), [(s[0] + v[0],)]), "total long", last_only=True, buckets=2)
    with ordered.large_state(spark):
        jobs.run_available(folded, f"{tmp_path}/o", f"{tmp_path}/c")
    got = spark.read.parquet(f"{tmp_path}/o")
    assert {tuple(r) for r in got.collect()} == {(f"k{m}", sum(n for n in range(400) if n % 40 == m)) for m in range(40)} and got.count() == 40


def test_a_batch_of_copies_leaves_one_row_for_each_set_of_words(spark, tmp_path):
    titles, schema = ["Grande fête musicale", "musicale grande fête", "Montagne peinture", None], "side string, id long, title string, territory string"
    rows = [("kit" if n % 10 == 0 else "event", n, titles[n % 7 % 4], ["nord", "sud", None][n % 3]) for n in range(400)]
    work, df = rematch.rematch("kit", "event", f"file://{tmp_path}"), spark.createDataFrame(rows, schema)
    for number in (0, 1):
        work(df.filter(F.col("id") % 2 == number), number)
    assert [spark.read.parquet(f"{tmp_path}/events/batch-{n}").filter("words is not null").count() for n in (0, 1)] == [6, 6]  # two sets in two places and in all
    shared = lambda a, b: a and b and len({w for w in a.lower().split() if len(w) >= 5} & {w for w in b.lower().split() if len(w) >= 5}) >= 2
    fits = {k: [e for s, e, t, w in rows if s == "event" and shared(title, t) and where in (None, w)] for side, k, title, where in rows if side == "kit"}
    assert {r.kit: r.id for r in spark.read.parquet(f"{tmp_path}/verdicts/batch-1").collect()} == {k: max(es) for k, es in fits.items() if es}
