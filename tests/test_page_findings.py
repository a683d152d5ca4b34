"""Published pages against their rows."""

from datetime import date

from agendum.operators import audits


def test_findings_of_pages(spark):
    ld = lambda body: f'<html lang="fr"><img src="a.jpg"><script type="application/ld+json">{body}</script></html>'
    pages = [
        (1, ld('{"@graph": [{"@type": "Event", "name": "Bal d\'été", "startDate": "2026-07-14T20:00"}]}')), (2, ld('[{"@type":"Event","name":"X","startDate":"2026-01-01"},{"@type":"Festival","name":"BAL D ETE","startDate":"2026-07-14"}]')),
        (3, ld('{"@type":"Event","name":"Autre","startDate":"2026-07-15"}')), (4, ld('{"@type":"Event","name":"Bal d\'été"}')), (5, "<html lang='it'><p>rien</p></html>"), (6, ld("{no json")), (7, None), (9, "x"),
    ]
    rows = [(n, "Bal d’été", date(2026, 7, 14), "fr") for n in (1, 2, 3, 4, 5, 6, 7, 8)]
    found = audits.page_findings(spark.createDataFrame(pages, "id long, html string"), spark.createDataFrame(rows, "id long, title string, start date, language string"), "id")
    assert {r.id: (r.grave, r.doubtful) for r in found.collect()} == {
        1: ("", ""), 2: ("", ""), 3: ("start,title", ""), 4: ("", "no start"), 5: ("", "language,no event,no picture"), 6: ("", "no event"), 7: ("", "no event"), 8: ("page missing", ""),
    }


def test_descriptions_without_substance(spark):
    from pyspark.sql import functions as F

    from agendum.functions import editorial as ed

    long, blob = "Une fête au village. " * 10, "<a href='" + "x" * 300 + "'>ici</a>"
    rows = [(None, long, None, False), ("", long, None, False), ("courte", long, None, False), (blob, long, "hollow", True), (blob, "trop court", "hollow", False), (long + " HTTPS://Feed.org/rss/1", long, "feed link", False), (long + "https://feed.org/rss/1", long * 2, "feed link", True)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, old string, new string, cause string, ok boolean").orderBy("n")
    cause = ed.pollution(F.col("old"), ["feed.org/rss"])
    got = df.select(cause.alias("cause"), ed.accepted(cause, F.col("old"), F.col("new"), F.lit(False)).alias("ok")).collect()
    assert [(r.cause, r.ok) for r in got] == [r[2:] for r in rows]
    other = ed.accepted(F.lit("incoherent"), F.lit(long * 9), F.lit(long), F.col("b"))
    assert [r[0] for r in spark.createDataFrame([(True,), (False,), (None,)], "b boolean").select(other).collect()] == [False, True, True]
