"""One test for each trap of the reference's semantics."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from agendum import predicates as P
from agendum.operators import aggregates, snapshots, windows

TODAY = date(2026, 9, 6)
PAST, NOW, FUTURE = "2026-09-01", "2026-09-06", "2026-09-20"
ENDS = [None, "", PAST, NOW, FUTURE]


def grid(spark):
    return spark.createDataFrame([(a, b) for a in ENDS for b in ENDS], "s string, e string")


def test_effective_end_is_never_empty(spark):
    for r in grid(spark).select("s", "e", P.effective_end(F.col("s"), F.col("e")).alias("x"), P.effective_start(F.col("s"), F.col("e")).alias("y")).collect():
        assert r.x == (r.e or r.s or None) and r.y == (r.s or r.e or None)


def test_ahead_forms_differ_on_undated_and_empty_ends(spark):
    s, e = F.col("s"), F.col("e")
    rows = grid(spark).select("s", "e", P.ahead(s, e, TODAY).alias("strict"), P.ahead(s, e, TODAY, keep_undated=True).alias("lenient"), P.ahead_empty_end_counts(s, e, TODAY).alias("twin")).collect()
    for r in rows:
        last = r.e or r.s or None
        assert bool(r.strict) == (last is not None and last >= NOW)
        assert bool(r.lenient) == (last is None or last >= NOW)
        twin = r.e if r.e is not None else r.s
        assert bool(r.twin) == ((r.e if r.e is not None else r.s if r.s is not None else "") == "" or (twin or "") >= NOW)


def test_overlap_forms(spark):
    s, e = F.col("s"), F.col("e")
    rows = grid(spark).select("s", "e", P.overlaps_strictly(s, e, NOW, FUTURE).alias("strict"), P.overlaps(s, e, NOW, FUTURE).alias("both")).collect()
    for r in rows:
        assert r.strict == ((r.s or "") <= FUTURE and (r.e or "") >= NOW)
        first, last = r.s or r.e, r.e or r.s
        assert bool(r.both) == bool(first and first <= FUTURE and last >= NOW)


def test_null_status_is_unknown_not_active(spark):
    df = spark.createDataFrame([("pending", None), ("rejected", None), (None, None), ("pending", 3)], "s string, d long")
    assert [bool(r[0]) for r in df.select(P.active(F.col("s"), F.col("d"))).collect()] == [True, False, False, False]


def test_invalid_dates_are_absent(spark):
    df = spark.createDataFrame([("2026-02-31",), ("2026",), ("2026-02-28",), ("",), (None,), ("2026-2-8",)], "s string")
    assert [r[0] for r in df.select(P.as_date(F.col("s"))).collect()] == [None, None, date(2026, 2, 28), None, None, None]


def test_radar_and_mail(spark):
    df = spark.createDataFrame([(" Radar ", None), (None, "X (RADAR)"), ("rss", "x"), (None, None)], "t string, n string")
    assert [r[0] for r in df.select(P.by_radar(F.col("t"), F.col("n"))).collect()] == [True, True, False, False]
    urls = spark.createDataFrame([("GMAIL:1#0",), ("https://x",), (None,)], "u string")
    assert [r[0] for r in urls.select(P.by_mail(F.col("u"))).collect()] == [True, False, False]


def test_not_applicable_is_not_missing(spark):
    df = spark.createDataFrame([("t", "", 1), ("", None, 0), ("t", "2026-01-01", 0)], "title string, start string, recurring int")
    got = df.select(P.missing_fields({"title": F.col("title"), "start": F.col("start")}, {"start": F.col("recurring") == 1})).collect()
    assert [r[0] for r in got] == [[], ["title", "start"], []]


def test_percent_rounds_half_to_even_and_knows_no_zero_denominator(spark):
    df = spark.createDataFrame([(1, 200), (3, 200), (5, 200), (1, 0)], "a long, b long")
    assert [r[0] for r in df.select(aggregates.percent(F.col("a"), F.col("b"))).collect()] == [0, 2, 2, None]


def test_funnel_stages_need_not_be_nested(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    stages = [("a", F.col("x") > 0, F.lit(True)), ("b", F.col("x") > 0, F.col("x") > 2), ("none", F.col("x") > 9, F.col("x") > 9)]
    rows = aggregates.funnel(df, stages).orderBy("stage_no").collect()
    assert [(r.done, r.total, r.remaining, r.pct) for r in rows] == [(3, 3, 0, 100), (3, 1, 0, 300), (0, 0, 0, None)]
    assert aggregates.bottleneck(aggregates.funnel(df, stages)).count() == 0


def test_latest_is_taken_before_the_filter(spark):
    df = spark.createDataFrame([(1, 1, "ok"), (1, 2, "failed"), (2, 1, "failed"), (2, 3, "ok")], "event long, id long, status string")
    assert [(r.event, r.id) for r in windows.latest(df, ["event"], ["id"]).filter("status = 'ok'").collect()] == [(2, 3)]


def test_runs_and_ties(spark):
    df = spark.createDataFrame([(1, n, v) for n, v in enumerate("aabbba")], "k int, n int, v string")
    best = windows.longest_run(df, ["k"], ["n"], "v").first()
    assert (best.v, best.run_length, best.changes) == ("b", 3, 2)
    tie = spark.createDataFrame([(1, n, v) for n, v in enumerate("aabb")], "k int, n int, v string")
    assert windows.longest_run(tie, ["k"], ["n"], "v").first().v == "a"


def test_fold_reopens(spark):
    log = [("x", 1, "signal"), ("x", 2, "escalate"), ("x", 3, "resolve"), ("x", 4, "escalate"), ("x", 5, "signal"), ("y", 1, "resolve")]
    got = snapshots.fold_decisions(spark.createDataFrame(log, "k string, at int, kind string"), "k", "kind", ["at"]).orderBy("k").collect()
    assert [(r.status, r.seen, r.reopened) for r in got] == [("open", 2, 1), ("none", 0, 0)]


def test_upsert_keeps_and_inserts(spark):
    old = spark.createDataFrame([(1, "a", "2026-01-01"), (2, "b", None)], "id long, v string, at string")
    new = spark.createDataFrame([(2, "", "2026-02-02"), (3, "c", "2026-02-02"), (None, "n", "x")], "id long, v string, at string")
    got = snapshots.upsert(old, new, ["id"], {"v": snapshots.fill_if_empty(F.col("n.v"), F.col("o.v"))}).collect()
    assert {(r.id, r.v, r["at"]) for r in got} == {(1, "a", "2026-01-01"), (2, "b", "2026-02-02"), (3, "c", "2026-02-02"), (None, "n", "x")}


@pytest.mark.parametrize(("preset", "want"), [("weekend", ("2026-09-04", "2026-09-06")), ("next", ("2026-09-11", "2026-09-13")), ("month", ("2026-09-01", "2026-09-30"))])
def test_periods_on_a_sunday(preset, want):
    from agendum.functions.scoring import period_bounds

    assert tuple(d.isoformat() for d in period_bounds(TODAY, preset)) == want


def test_iso_week_of_new_year(spark):
    from agendum.functions.scoring import iso_week

    df = spark.sql("select timestamp'2027-01-01 00:00:00' as t")
    assert df.select(iso_week(F.col("t"))).first()[0] == "2026-W53"
