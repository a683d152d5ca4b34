"""Matching by rank and numbering of hot groups, against loops."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from agendum.operators import matching, windows


def greedy(pairs, left_size, right_size):
    """pairs: (rank..., left, right) in the order of their being looked at."""
    free, out = {("l", k): n for k, n in left_size.items()} | {("r", k): n for k, n in right_size.items()}, []
    given = Counter()
    for *rank, a, b in sorted(set(pairs)):
        n = min(free.get(("l", a), 0), free.get(("r", b), 0))
        if n:
            out.append((a, b, *rank, n, given["l", a], given["r", b]))
            for side in (("l", a), ("r", b)):
                free[side] -= n
                given[side] += n
    return out


def test_greedy_matching_takes_what_a_loop_takes(spark):
    for seed in range(2):
        rng = random.Random(seed)
        pairs = [(rng.randrange(3), rng.randrange(12), rng.randrange(9)) for _ in range(60)]
        left, right = {k: rng.randrange(4) for k in range(12)}, {k: rng.randrange(5) for k in range(9)}
        best = {}
        for r, a, b in pairs:
            best[a, b] = min(r, best.get((a, b), 9))
        df = spark.createDataFrame([*pairs, (0, None, 1), (0, 1, None), pairs[0]], "r int, a long, b long")
        size = lambda d, c: spark.createDataFrame(list(d.items()), f"{c} long, size long")
        found = matching.greedy_matching(df, "a", "b", ["r"], size(left, "a"), size(right, "b")).collect()
        assert sorted(map(tuple, found)) == sorted(greedy([(r, a, b) for (a, b), r in best.items()], left, right))
        found = matching.greedy_matching(df, "a", "b", ["a", "r"]).collect()
        one = greedy([(a, r, a, b) for (a, b), r in best.items()], dict.fromkeys(range(12), 1), dict.fromkeys(range(9), 1))
        assert sorted((r.a, r.b) for r in found) == sorted((x[0], x[1]) for x in one)
    assert matching.greedy_matching(df.limit(0), "a", "b", ["r"]).count() == 0


def test_no_slug_is_given_twice(spark):
    rows = [
        (1, "x-1", "a", "nice"), (2, "x-2", "a", "nice"), (3, "x-3", "a-nice", "turin"), (4, "held", "held", ""), (5, "x-5", "held", None), (6, "x-6", None, "nice"),
        (7, "a-2", "a", "2"), (8, None, "a-2", "aosta"), (9, "x-9", "b", ""), (10, "x-10", "b", "aosta"), (11, "x-11", "b-aosta", ""),
    ]
    df = spark.createDataFrame(rows, "id long, old string, new string, town string")
    got = {r.id: (r.slug, r.redirect, r.refused) for r in matching.renamed_once(df, "id", "old", "new", "town").collect()}
    assert got == {
        1: ("a", "x-1", None), 2: ("a-nice", "x-2", None), 3: ("a-nice-turin", "x-3", None), 4: ("held", None, None), 5: ("x-5", None, "held"), 6: ("x-6", None, None),
        7: ("a-2", None, None), 8: ("a-2-aosta", None, None), 9: ("b", "x-9", None), 10: ("b-aosta", "x-10", None), 11: ("x-11", None, "b-aosta"),
    }
    slugs = [s for s, *_ in got.values() if s]
    assert len(slugs) == len(set(slugs))


def loop(rows):
    """rows: id, on, link, words, day, block. Sisters (a, b, stage) and all that had a candidate."""
    agree = lambda x, y: x is None or y is None or x == y
    out, had, free = [], set(), set(r[:2] for r in rows)
    for stage in (1, 2):
        classes = defaultdict(list)
        for i, on, link, w, day, block in rows:
            if (i, on) in free and (link is not None if stage == 1 else len(set(w)) >= 2):
                classes[(on, link, day) if stage == 1 else (on, block, frozenset(w), day)].append(i)
        pairs, members = [], {(k[0], min(ids)): sorted(ids) for k, ids in classes.items()}
        for k, ids in classes.items():
            for m, others in classes.items():
                if k[0] or not m[0] or k[1] != m[1] or not agree(k[-1], m[-1]):
                    continue
                shared = k[2] & m[2] if stage == 2 else ()
                years = [{w for w in s if len(w) == 4 and w.isdigit()} for s in (k[2], m[2])] if stage == 2 else [(), ()]
                alike = stage == 1 or (len([w for w in shared if not (len(w) == 4 and w.isdigit())]) >= 2 and 2 * len(shared) >= min(len(k[2]), len(m[2])) and not (years[0] and years[1] and not years[0] & years[1]))
                if alike:
                    pairs.append((-len(shared), min(ids), min(others)))
                    had.update(ids)
        for a, b, _, n, x, y in greedy(pairs, {min(v): len(v) for k, v in classes.items() if not k[0]}, {min(v): len(v) for k, v in classes.items() if k[0]}):
            for u in range(n):
                out.append((members[False, a][x + u], members[True, b][y + u], stage))
        free -= {(a, False) for a, *_ in out} | {(b, True) for _, b, _ in out}
    return out, had


def test_sisters_are_those_of_a_loop_and_stand_for_one_each(spark):
    words = ["fest", "jazz", "wine", "lake", "2024", "2025", "night", "old"]
    for seed in range(2):
        rng = random.Random(seed)
        rows = [(n, rng.random() < 0.4, rng.choice([None, None, 1, 2]), [rng.choice(words[: rng.choice([3, 8])]) for _ in range(rng.randrange(6))], rng.choice([None, 5, 6]), rng.choice(["fr", "it", None])) for n in range(70)]
        df = spark.createDataFrame(rows, "id long, on boolean, link long, w array<string>, day int, block string").repartition(3)
        found = matching.reconciled(df.filter("not on"), df.filter("on"), "id", "link", F.col("w"), "day", ["block"]).collect()
        want, had = loop(rows)
        assert sorted((r.id, r.sister, r.stage) for r in found if r.verdict == "sister") == sorted(want)
        assert {r.id for r in found if r.verdict == "conflict"} == had - {a for a, *_ in want} and len(found) == sum(not r[1] for r in rows)
        sisters = [r.sister for r in found if r.sister is not None]
        assert len(sisters) == len(set(sisters))


def test_numbers_of_a_hot_key(spark):
    rows = [("hot" if n % 3 else None if n % 2 else f"k{n % 5}", n * 7 % 11 if n % 13 else None, n) for n in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    found = windows.numbered(df, ["k"], ["o", "v"], "n")
    want, seen = {}, Counter()
    for k, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        seen[k] += 1
        want[v] = seen[k]
    assert {r.v: r.n for r in found.collect()} == want and found.columns == ["k", "o", "v", "n"]
    assert windows.numbered(df.limit(0), ["k"], ["v"], "n").count() == 0


def test_no_side_of_a_matching_goes_through_the_driver(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    rows = spark.range(40).select("id", (F.col("id") % 4).alias("link"), F.split(F.concat_ws(" ", F.lit("bal jazz"), F.col("id") % 3), " ").alias("w"), (F.col("id") % 5).alias("day"), F.lit("x").alias("block"))
    got = matching.reconciled(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), "id", "link", F.col("w"), "day", ["block"])
    assert got.count() == 20
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = store.executionsList()
    plans = [ran.apply(n).physicalPlanDescription() for n in range(before, ran.size())]
    assert len(plans) > 5 and not [p for p in plans if "BroadcastExchange" in p]
