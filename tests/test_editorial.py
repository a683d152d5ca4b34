"""Editorial functions and pairings on literal rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from agendum.functions import editorial as ed
from agendum.operators import pairing

AS_OF = date(2026, 8, 15)


def one(spark, column, *values):
    kinds = {date: "date", datetime: "timestamp", int: "int", str: "string", type(None): "string", float: "double"}
    schema = ", ".join(f"c{n} {kinds[type(v)]}" for n, v in enumerate(values))
    return spark.createDataFrame([tuple(values)], schema).select(column).first()[0]


@pytest.fixture(autouse=True)
def columns(spark):
    globals().update({f"C{n}": F.col(f"c{n}") for n in range(4)})


def test_cleaning(spark):
    assert one(spark, ed.without_boilerplate(C0, ["newsletter"]), "a\nSubscribe to our Newsletter now\n\n\nb") == "a\n\nb"
    assert one(spark, ed.polished(C0), "Oui  , non :  voilà ... https://x") == "Oui, non : voilà … https://x"
    assert one(spark, ed.bold_once(C0, ["lac"]), "le lac et le lac") == "le <strong>lac</strong> et le lac"
    assert one(spark, ed.bold_once(C0, ["lac"]), "le <strong>grand lac</strong>") == "le <strong>grand lac</strong>"


def test_titles(spark):
    assert one(spark, ed.looks_untranslated(C0, C1, C2), "Grande Fête", "grande fete", "fr") and not one(spark, ed.looks_untranslated(C0, C1, C2), "Big party", "Grande Fête", "en")
    assert one(spark, ed.looks_untranslated(C0, C1, C2), "the house of the sea", "x", "fr")
    assert [one(spark, ed.title_verdict(C0, C1), a, b) for a, b in (("Fête", "fete"), ("Festival de musique", "Festival di musica"), ("Marché", "Concert"))] == ["same", "kindred", "foreign"]
    assert one(spark, ed.unknown_names(C0, ["annecy"]), "Nous allons à Annecy, puis Chambéry dort.") == ["chambery"]


def test_ranges_and_lone_days(spark):
    text = "du 3 au 5 septembre 2026, puis du 28 septembre au 2 octobre 2026 et le 20 août 2026"
    assert [(r.start.isoformat(), r.end.isoformat()) for r in one(spark, ed.all_ranges(C0, C1), text, AS_OF)] == [("2026-09-03", "2026-09-05"), ("2026-09-28", "2026-10-02")]
    assert one(spark, ed.lone_days(C0, C1), text, AS_OF) == [date(2026, 8, 20)]
    v = lambda s, e, t: one(spark, ed.text_verdict(C0, C1, C2, C3), s, e, t, AS_OF)
    assert v(date(2026, 9, 3), date(2026, 9, 5), "du 3 au 5 septembre 2026") == "confirmed" and v(date(2026, 9, 3), date(2026, 9, 6), "du 3 au 5 septembre 2026") == "bound"
    assert v(date(2025, 9, 3), date(2025, 9, 5), "du 3 au 5 septembre 2026") == "year" and v(date(2026, 1, 1), date(2026, 1, 2), "le 20 août 2026") == "contradicted" and v(AS_OF, AS_OF, "rien") == "silent"
    assert [one(spark, ed.year_in(C0, C1), t, AS_OF) for t in ("Été 2026", "Été 2025", "Été 20266")] == ["named", "other", "none"]


def test_slugs_marks_and_shapes(spark):
    assert [one(spark, ed.slug_without_date(C0), s) for s in ("fete-12-juillet-2026", "fete-2026", "fete-2026-07-12", "fete-60")] == ["fete", "fete", "fete", "fete-60"]
    assert one(spark, ed.twin_slug(C0, C1), "fete-fr", "it") == "fete-it"
    marks = ed.period_marks(C0, C1, C2, C3)
    assert [one(spark, marks[k], date(2026, 8, 1), date(2026, 8, 20), date(2026, 8, 14), AS_OF) for k in ("ending", "republish", "is_new")] == [True, False, True]
    assert one(spark, ed.key_values(C0), "Ville = Annecy; url=a=b\nx\nville=Lyon") == {"url": "a=b", "ville": "Lyon"}
    assert one(spark, ed.alert_open(C0, C1, {"quota": 1}, C2), datetime(2026, 1, 1, 0), "quota", datetime(2026, 1, 1, 0, 59)) and not one(spark, ed.alert_open(C0, C1, {"quota": 1}, C2), datetime(2026, 1, 1, 0), "quota", datetime(2026, 1, 1, 1))
    assert [one(spark, ed.orientation(C0, C1), a, b) for a, b in ((200, 100), (100, 200), (100, 100), (1, 0))] == ["landscape", "portrait", "square", None]
    assert one(spark, ed.banner_shaped(C0, C1), 900, 300) and one(spark, ed.season_note(C0, C1, C2), date(2026, 8, 1), date(2026, 8, 20), AS_OF) == 2


def test_pairs(spark):
    ev = [(1, "Festival Musica Torino", "it", "2026-09-01", "https://x/a-300x200.jpg"), (2, "Musica Torino le festival", "fr", "2026-09-01", None), (3, "Autre", "fr", "2026-10-01", "https://y/A.png?x"), (4, "Musica Torino le festival", "fr", "2026-09-01", "logo")]
    df = spark.createDataFrame(ev, "id int, title string, lang string, start string, image string")
    assert {tuple(r) for r in pairing.translation_pairs(df).collect()} == {(1, 2), (1, 3), (1, 4)}
    ed_rows = [(1, "Foire aux vins 2025", date(2025, 9, 1), "Halle", True, 7), (2, "Vins: la foire 2026", date(2026, 9, 3), None, False, None), (3, "Foire aux vins", date(2026, 9, 1), "Autre", True, None), (4, "Foire aux vins", date(2027, 1, 1), "Halle", True, None)]
    e = spark.createDataFrame(ed_rows, "id int, title string, start date, venue string, online boolean, post_id int")
    pairs = pairing.next_editions(e)
    assert {tuple(r) for r in pairs.collect()} == {(1, 2)}
    assert {tuple(r) for r in pairing.next_editions(e, every_token=False).collect()} <= {(1, 2)}
    assert {r.id: r.post_id for r in pairing.adopted(e, pairs).collect()} == {1: None, 2: 7, 3: None, 4: None}
    kits = spark.createDataFrame([("k", "Grande exposition photographie", "A"), ("n", "photographie", None)], "kit string, title string, territory string")
    events = spark.createDataFrame([(1, "Exposition de photographie", "A"), (2, "Exposition photographie", "B"), (3, "exposition: photographie", "A")], "id int, title string, territory string")
    assert [tuple(r) for r in pairing.press_kits(kits, events).collect()] == [("k", 3)]


def test_group_reports(spark):
    m = spark.createDataFrame([("g", 1, None, True), ("g", 2, 1, False), ("h", 3, 0, True), ("h", 4, None, True), ("h", 5, 4, True)], "grp string, id long, translation_of long, off boolean")
    assert sorted(r.id for r in pairing.held_back_groups(m, "grp", F.col("off")).collect()) == [1, 2]
    assert {tuple(r) for r in pairing.duplicate_report(m, "grp").collect()} == {("h", 3, 2), ("(translations only)", 2, 1)}
    ev = spark.createDataFrame([(1, "Annecy", "X", "2026-01-01"), (2, "Lyon", "X", "2026-03-01"), (3, "annecy", "Y", "2026-01-02")], "id int, town string, venue string, start string")
    assert {tuple(r) for r in pairing.merge_damage(spark.createDataFrame([(2, 1), (3, 1)], "loser int, winner int"), ev).collect()} == {(2, 1, "grave"), (3, 1, "slight")}
    meta = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z"), (2, "c", "q")], "post int, name string, value string")
    assert {tuple(r) for r in pairing.pivoted(meta, "post", "name", "value", ["a", "b"]).collect()} == {(1, "x", "y"), (2, "z", None)}


def test_live_duplicates_close_chains_and_part_periods(spark):
    d = date
    rows = [(1, "Exposition grandes montagnes photographies", "A", d(2026, 9, 1), d(2026, 9, 5)), (2, "Photographies: exposition des grandes montagnes", "A", d(2026, 9, 3), None), (3, "EXPOSITION GRANDES MONTAGNES PHOTOGRAPHIES", "B", d(2026, 9, 1), None), (4, "exposition grandes montagnes photographies", "A", d(2026, 9, 15), None), (5, "Autre chose", "A", d(2026, 9, 1), None)]
    df = spark.createDataFrame(rows, "id long, title string, territory string, start date, end date")
    got = {r.id: (r.root, r.part) for r in pairing.live_duplicates(df, ["exposition"]).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 4: (1, 2)}
