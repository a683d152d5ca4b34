"""Partitions follow the rows, so that a task's share does not grow with the table."""

from agendum import plans
from agendum.operators import entities
from agendum.storage import parts_for, shuffled_for


def test_partitions_follow_the_rows(spark):
    assert [parts_for(spark, n) for n in (0, 4_000_000, 4_000_001, 90_000_000)] == [4, 4, 5, 90]
    with shuffled_for(spark, 30_000_000):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "30"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_lines_of_orders_meet_once(spark, tmp_path):
    rows = [(n // 3, n % 3 + 1 if n % 7 else 9, float(n)) for n in range(60)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = plans.QUERIES["pivoted_meta"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange ") == 1 and "pivotfirst" not in plan.lower()
    want = {o: tuple(sum(q for k, n, q in rows if (k, n) == (o, line)) if any((k, n) == (o, line) for k, n, _ in rows) else None for line in range(1, 8)) for o, _, _ in rows}
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == want


def test_components_of_repeated_edges_in_more_partitions(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3), (7, 6), (6, 7), (9, 9), (None, 4)], "a long, b long")
    asked = []
    monkeypatch.setattr(entities, "shuffled_for", lambda session, rows: asked.append(rows) or shuffled_for(session, 9_000_000))
    assert {tuple(r) for r in entities.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)}
    assert asked == [10] and spark.conf.get("spark.sql.shuffle.partitions") == "4"
