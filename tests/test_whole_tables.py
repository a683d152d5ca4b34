"""Queries over whole tables, against brute force on small fixtures."""

import random

from agendum import plans


def closed(edges):
    """Each node's smallest by union-find."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in root}


def test_components_of_all_edges(spark, tmp_path):
    rows = [(p, s, float(q)) for p, s, q in [(1, 1, 1), (2, 1, 50), (2, 5, 50), (3, 5, 2), (4, 2, 7), (5, 3, 50), (6, 3, 3), (4, 2, 9)]]
    rows += [(n, 10 + n // 2, 1.0) for n in range(10, 60)] + [(n + 1, 10 + n // 2, 49.0) for n in range(11, 50, 4)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = closed((p, s + 100_000_000) for p, s, _ in rows)
    assert {r.node: r.root for r in plans.QUERIES["connected_components"](spark, str(tmp_path)).collect()} == want
    assert len(want) == len({p for p, *_ in rows}) + len({s for _, s, _ in rows}) and len(set(want.values())) > 3


def test_title_pairs_of_parts_of_every_size(spark, tmp_path):
    words = ["blue", "hot", "ring", "bolt", "large"]
    rows = [(n, f"{words[n % 5]} {words[n * 3 % 4]} {words[n // 7 % 5]}", f"Brand#{n % 2}", n % 50 + 1) for n in range(80)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    shared = lambda a, b: len(set(a[1].split()) & set(b[1].split()))
    want = {(a[0], b[0], shared(a, b)) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and shared(a, b) >= 2}
    assert {tuple(r) for r in plans.QUERIES["title_token_pairs"](spark, str(tmp_path)).select("a", "b", "shared").collect()} == want


def test_reach_over_all_orders(spark, tmp_path):
    rng = random.Random(1)
    rows = [(n, rng.randint(1, 4000), 10.0) for n in range(9000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    keys, steps = max(c for _, c, _ in rows) + 1, {}
    for o, c, _ in rows:
        steps.setdefault(c, []).append(o * 7 % keys)
    want, todo = {1}, [1]
    while todo:
        new = set(steps.get(todo.pop(), ())) - want
        want |= new
        todo += new
    assert {r.node for r in plans.QUERIES["reachable_nodes"](spark, str(tmp_path)).collect()} == want and max(want) > 1500
