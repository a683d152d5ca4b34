"""The merge job: what it merges, that a second run changes nothing, and that it can be undone."""

from collections import Counter

from agendum.operators import mergejob

SCHEMA = "id long, title string, territory string, url string, image string, status string, online boolean, cancelled boolean, duplicate_of long"
ROWS = [
    (1, "bal", "n", None, None, "published", True, False, None), (2, "bal", "n", "u2", "i2", "pending", None, False, None), (3, "bal", "n", "u3", None, "pending", False, False, None),
    (4, "feu", "n", "u2", None, "pending", None, None, None), (5, "jazz", "s", None, None, "pending", None, True, None), (6, "jazz", "s", None, None, "pending", None, False, None),
    (7, "fin", "s", None, None, "pending", None, True, None), (8, "fin", "s", None, "i8", "pending", None, True, None), (9, None, "s", None, None, "pending", None, None, None), (10, None, "s", None, None, "pending", None, None, None),
    (11, "bal", "n", "u11", None, "merged", None, None, 99), (12, "gala", "n", None, None, "published", False, False, None), (13, "gala", "n", None, None, "published", True, False, None),
]
STEPS, FILL = [["title", "territory"], ["url"]], ["url", "image"]


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_merges_run_to_a_fixpoint_and_can_be_undone(spark):
    start = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    done, log = mergejob.merge_job(start, STEPS, FILL)
    got = {r.id: (r.status, r.duplicate_of, r.url, r.image) for r in done.collect()}
    # 2 and 3 go to 1, which gains the address and image of the fuller one; by that address 4 follows in the next step.
    assert got[1] == ("published", None, "u2", "i2") and got[2] == ("merged", 1, "u2", "i2") and got[3][:2] == ("merged", 1) and got[4][:2] == ("merged", 1)
    assert got[5][:2] == got[6][:2] == ("pending", None)  # one of two is cancelled
    assert got[7][:2] == ("merged", 8) and got[8][:2] == ("pending", None)  # both are
    assert got[9][1] is None and got[10][1] is None and got[11] == ("merged", 99, "u11", None) and got[12][1] is None and got[13][1] is None
    again, nothing = mergejob.merge_job(done, STEPS, FILL)
    assert rows_of(again) == rows_of(done) and nothing.count() == 0
    assert rows_of(mergejob.undone(done, log)) == rows_of(start)
    half = {r.id: r.duplicate_of for r in mergejob.undone(done, log, 2).collect()}
    assert half[4] is None and half[2] == 1
    empty, none = mergejob.merge_job(start.limit(0), STEPS, FILL)
    assert empty.count() == none.count() == 0
