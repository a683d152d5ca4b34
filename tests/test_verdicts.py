"""Signs as slots of stems, and edges of words in any script."""

from pyspark.sql import functions as F

from agendum.functions import scoring, verdicts
from agendum.functions import text as tx


def said(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").orderBy("n").select(column(F.col("t"))).collect()]


def test_news_are_no_events(spark):
    news = {
        "Comment se garer près du lac": "access", "Dove parcheggiare il camper": "access", "Circulation fortement perturbée dimanche": "roads", "Strada provinciale chiusa": "roads", "Déviation rue Haute": "roads",
        "Les élus ont longuement délibéré": "decision", "Allerta gialla": "warning", "Un accident fait deux blessés": "accident", "Concertation citoyenne": "inquiry",
        "Elle gagne enfin le titre": "result", "Retour en images sur une belle soirée": "look back", "Grand bal du village. Les élus aiment le jazz. Adoptons la danse": None, "Marché aux fleurs": None, "": None,
    }
    reason = lambda t: verdicts.non_event_reason(t, F.lit(None).cast("string"))
    assert said(spark, reason, *news) == list(news.values())
    assert said(spark, reason, None) == [None]


def test_bylines(spark):
    rows = [
        ("Lina Bertholet", "Veillée animée avec soin par Lina Bertholet.", "corroborated"), ("Lina Bertholet", "Animée par le club. Lina Bertholet y dansait.", "person"), ("Ugo Marchetti", "Ne parla il presidente Ugo Marchetti", "corroborated"),
        ("Ugo Marchetti", None, "person"), ("Compagnie Zelig", "x", "body"), ("Amici della Musica", "x", "body"), ("Ufficio Stampa", "x", "account"), ("webmaster", "x", "account"), (" ", "x", "empty"), (None, None, "empty"), ("Ève 4", "x", "body"),
    ]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, name string, text string, want string").orderBy("n")
    assert [r[0] for r in df.select(verdicts.byline_verdict(F.col("name"), F.col("text"))).collect()] == [r[2] for r in rows]


def test_words_end_where_no_letter_stands(spark):
    assert said(spark, lambda t: tx.found_terms(t, ["le", "bal"]), "leé ébal", "é le-bal_2", "Le bal") == [[], ["le", "bal"], ["le", "bal"]]
    assert said(spark, lambda t: scoring.language_access(t, [("le|la", 2), ("of", 1)]), "leé ofå", "(la)", "of_the") == [0, 2, 1]


def test_a_name_that_overlaps_itself_is_found(spark):
    rows = [("Par Par", "Soirée proposée avec joie par par Par.", "corroborated"), ("Lina Bertholet", "Lina Bertholet, animée par Lina Bertholet et Lina Bertholet", "corroborated"), ("Par Par", "Par par par ici", "person")]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, name string, text string, want string").orderBy("n")
    assert [r[0] for r in df.select(verdicts.byline_verdict(F.col("name"), F.col("text"))).collect()] == [r[2] for r in rows]


def test_signs_looked_for_together_give_the_first_ones_reason(spark):
    signs = [verdicts.Sign(f"r{n}", (f"stem{n} x{n}.", f"end{n}."), 1) for n in range(7)]
    texts = [f"Stem{n}ming of end{n}, x{m} end{m}" for n in range(7) for m in range(7)] + ["stem1 end2", "x3 a b end3", "xx3 end3", None]
    want = [f"r{min(n, m)}" for n in range(7) for m in range(7)] + [None] * 4
    for together in (1, 3, 7):
        assert said(spark, lambda t: verdicts.sign_reason(t, signs, together), *texts) == want  # noqa: B023
