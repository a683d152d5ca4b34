"""Names in texts against a search at every word, and texts that tell of elsewhere."""

import random

from pyspark.sql import functions as F

from agendum.operators import gazetteer


def test_names_are_those_of_a_search_at_every_word(spark):
    rng = random.Random(6)
    bits = ["Saint", "Jean", "Aix", "les", "Bains", "Nice", "nicermes", "l'Isola", "Évian", "Œuf", "sur", "Mer"]
    names = ["Aix-les-Bains", "Aix", "les Bains", "Nice", "Saint-Jean", "Saint-Jean sur Mer", "Jean", "évian", "EVIAN", "oeuf", "isola", "--", None]
    texts = [" ".join(rng.choice(bits) + rng.choice(["", ",", " -", "\n"]) for _ in range(rng.randrange(40))) for _ in range(30)] + [None, "", "Nice", "niceNice", "Nice " * 30_000]
    rows = [(n, t) for n, t in enumerate(texts)] + [(3, texts[3]), (None, "Nice")]
    df, held = spark.createDataFrame(rows, "id long, text string").repartition(3), spark.createDataFrame([(n,) for n in names], "name string")
    want = []
    for k, t in rows:
        words = gazetteer.WORD.findall(t or "")
        low = [gazetteer.folded(w) for w in words]
        for n in {gazetteer.folded_name(n) for n in names} - {""}:
            parts = n.split()
            want += [(k, n, i, words[i][0].isupper()) for i in range(len(low) - len(parts) + 1) if low[i : i + len(parts)] == parts]
    got = list(map(tuple, gazetteer.names_in(df, "id", "text", held, "name").collect()))
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
    parted = map(tuple, gazetteer.names_in(df, "id", "text", held, "name", max_names=3).collect())
    assert set(parted) == set(want)
    assert gazetteer.names_in(df, "id", "text", held.limit(0), "name").count() == 0 and gazetteer.names_in(df.limit(0), "id", "text", held, "name").count() == 0


def test_only_both_signals_block(spark):
    rows = [
        (1, "Soirée à Annecy au bord de l'eau", "Fête du vin", "Chambéry", "blocked"), (2, "Fête à Annecy", "Fête du vin", "Chambéry", "elsewhere"), (3, "Une soirée douce", "Fête du vin", "Chambéry", "foreign"),
        (4, "Annecy et Chambéry en musique", "Concert", "Chambéry", "silent"), (5, "Un tour à Annecy", "Marché", "Annecy-le-Vieux", "silent"), (6, "vers annecy ce soir", "Marché", "Turin", "foreign"), (7, None, "Marché", "Turin", "silent"),
        (8, "Soirée à Annecy", "Marché", None, "foreign"), (9, "Soirée à Annecy", None, None, "silent"),
    ]
    df = spark.createDataFrame(rows, "id long, text string, title string, town string, want string")
    names = spark.createDataFrame([("Annecy",), ("Chambéry",), ("Annecy-le-Vieux",), ("Tour",)], "name string")
    got = {r.id: (r.verdict, r.elsewhere) for r in gazetteer.coherence(df, names, "id", "text", ["title", "town"], "town", "name", ["tour"]).collect()}
    assert {k: v for k, (v, _) in got.items()} == {r[0]: r[4] for r in rows}
    assert got[1][1] == got[2][1] == "annecy" and got[4][1] is None


def test_a_gazetteer_too_large_for_a_task_takes_one_pass_too(spark):
    rng = random.Random(9)
    syllables = ["mon", "ta", "gné", "Saint", "œu", "val", "ri", "Ba"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice([1, 2])))
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", "--"]
    names = [" ".join(word() for _ in range(size)) for size in (1, 2, 3, 12) for _ in range(12)] + [" ".join(texts[0].split()[:40]), None, "--"]
    rows = [(n, t) for n, t in enumerate(texts)] * 2  # repeated rows give their places each
    df, held = spark.createDataFrame(rows, "id long, text string").repartition(3), spark.createDataFrame([(n,) for n in names], "name string")
    few, many = (gazetteer.names_in(df, "id", "text", held, "name", **o) for o in ({}, {"max_names": 2}))
    want = sorted(map(tuple, few.collect()))
    assert sorted(map(tuple, many.collect())) == want and len({n.count(" ") for _, n, _, _ in want}) > 2
    assert many._jdf.queryExecution().executedPlan().toString().count("gazetteer_text") > 0 and "Union" not in many._jdf.queryExecution().optimizedPlan().toString()
    sums = {}
    for k, n, at, capital in want:
        c = sums.get((k, n), (0, 0, 0))
        sums[k, n] = (c[0] + 1, c[1] + at, c[2] + capital)
    for options in ({}, {"max_names": 2}):
        got = gazetteer.names_counted(df, "id", "text", held, "name", **options)
        assert {(r.id, r.name): (r.n, r.places, r.capitals) for r in got.collect()} == sums
    rows = df.filter("text is not null").dropDuplicates(["id"]).select("id", "text", F.lit("Bal").alias("title"), F.lit("Turin").alias("town"))
    told = [sorted(map(tuple, gazetteer.coherence(rows, held, "id", "text", ["title", "town"], "town", "name", **o).collect())) for o in ({}, {"max_names": 2})]
    assert told[0] == told[1] and any(r[1] for r in told[0])
