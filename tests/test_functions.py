"""Text, date, page and score functions on literal rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from agendum.functions import dates, scoring, web
from agendum.functions import text as tx
from agendum.operators import entities, joins

AS_OF = date(2026, 8, 15)


def one(spark, column, *values):
    schema = ", ".join(f"c{n} {'date' if isinstance(v, date) else 'string'}" for n, v in enumerate(values))
    return spark.createDataFrame([tuple(values)], schema).select(column).first()[0]


def test_fold(spark):
    assert one(spark, tx.folded_key(F.col("c0")), "L'Été à Saint-Étienne — Œuvre Ñ!") == "l ete a saint etienne oeuvre n"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("du 3 au 5 septembre 2026", ("2026-09-03", "2026-09-05", "plage")), ("dal 3 al 5 settembre", ("2026-09-03", "2026-09-05", "plage")), ("28 décembre 2026 au 3 janvier 2027", ("2026-12-28", "2027-01-03", "plage")),
        ("du 28 décembre au 3 janvier 2027", ("2026-12-28", "2027-01-03", "plage")), ("jusqu'au 12 octobre", (None, "2026-10-12", "jusqu_au")), ("fino al 12 ottobre 2026", (None, "2026-10-12", "jusqu_au")),
        ("le 20 août", ("2026-08-20", "2026-08-20", "date")), ("1er septembre 2026", ("2026-09-01", "2026-09-01", "date")), ("31/08/2026", ("2026-08-31", "2026-08-31", "numerique")),
        ("2026-09-01 et 2026-09-10", ("2026-09-01", "2026-09-10", "iso")), ("31 février 2026, sinon 02.03.2026", ("2026-03-02", "2026-03-02", "numerique")), ("le 3 mai", (None, None, "annee_devinee_lointaine")),
        ("lundi 20 août 2026", (None, None, "jour_incoherent")), ("jeudi 20 août 2026", ("2026-08-20", "2026-08-20", "date")), ("aucune date", None), ("32 août 2026", None),
    ],
)
def test_parse_dates(spark, text, want):
    got = one(spark, dates.parse_dates(F.col("c0"), F.col("c1")), text, AS_OF)
    assert (got and (got.start and got.start.isoformat(), got.end and got.end.isoformat(), got.source)) == want


@pytest.mark.parametrize(("text", "want"), [("ore 21", "21:00"), ("alle ore 21:30", "21:30"), ("à 20h30", "20:30"), ("dès 9 h", "09:00"), ("ore 25", None), ("rien", None)])
def test_start_time(spark, text, want):
    assert one(spark, dates.start_time(F.col("c0")), text) == want


def test_bounds_verdict(spark):
    df = spark.sql("""select date'2026-09-01' s, date'2026-09-03' e, array(named_struct('start', date'2026-09-01', 'end', date'2026-09-03')) same,
        array(named_struct('start', date'2026-09-01', 'end', date'2026-09-09')) longer, array(named_struct('start', date'2026-05-01', 'end', date'2026-05-03')) other,
        cast(array() as array<struct<start: date, end: date>>) none, array(date'2026-09-01') days, cast(array() as array<date>) nodays""")
    v = dates.bounds_verdict
    got = df.select(v(F.col("s"), F.col("e"), F.col("same"), F.col("nodays")), v(F.col("s"), F.col("s"), F.col("none"), F.col("days")), v(F.col("s"), F.col("s"), F.col("longer"), F.col("nodays")), v(F.col("s"), F.col("e"), F.col("longer"), F.col("nodays")), v(F.col("s"), F.col("e"), F.col("other"), F.col("nodays")), v(F.col("s"), F.col("e"), F.col("none"), F.col("nodays"))).first()
    assert list(got) == ["confirmed", "confirmed", "collapsed", "contradicted", "ambiguous", "silent"]


def test_same_story_and_shouting(spark):
    same = lambda a, b: one(spark, tx.same_story(F.col("c0"), F.col("c1")), a, b)
    assert same("Concert de McCartney ce soir", "Soirée McCartney")
    assert not same("CONCERT DE McCARTNEY", "Soirée McCartney")
    assert same("grande exposition photographie montagne", "photographie montagne exposition") and not same("grande exposition", "petite exposition")


def test_cross_language_and_roots(spark):
    same = lambda a, b: one(spark, tx.cross_language_same(F.col("c0"), F.col("c1")), a, b)
    assert same("Festival Musica Torino", "Musica Torino festival") and not same("Festival Musica 2025 x", "Festival Musica 2026 x")
    root = lambda a, b: one(spark, tx.same_root(F.col("c0"), F.col("c1")), a, b)
    assert root("musica", "musique") and root("fête", "fete") and not root("mer", "lac")


def test_cancelled(spark):
    assert one(spark, tx.cancelled(F.col("c0")), "Concert ANNULÉ") and not one(spark, tx.cancelled(F.col("c0")), "Annuaire des concerts")


def test_json_ld_at_any_depth(spark):
    web.register_json_ld(spark)
    html = '<script type="application/ld+json">{"@graph": [{"@type": "Thing", "x": {"@type": ["MusicEvent"], "name": "A", "startDate": "2026-09-01", "location": {"name": "Hall"}}}, {"@type": "Event", "name": ["B"]}]}</script><script type="application/ld+json">{broken</script>'
    spark.createDataFrame([(html,)], "html string").select(F.explode(web.json_ld_blocks(F.col("html"))).alias("block")).createOrReplaceTempView("blocks")
    rows = spark.sql("select e.* from blocks, lateral json_ld_events(block) e").collect()
    assert {(r.name, r.start_date, r.place) for r in rows} == {("A", "2026-09-01", "Hall"), ("B", None, None)}


def test_json_helpers(spark):
    assert one(spark, web.first_json(F.col("c0")), 'said {"a": {"b": 1}} and {"c": 2}') == '{"a": {"b": 1}}'
    assert one(spark, F.to_json(web.tolerant_json(F.col("c0"))), '{"a": [1, 2,],}') == '{"a":[1,2]}'
    points = lambda s: one(spark, scoring.criteria_sum(F.try_parse_json("c0")), s)
    assert points('{"rayonnement": {"points": 2}, "specificite": 1, "lieu": 5}') == 8 and points('{"x": 1}') is None and points("broken") is None


def test_front_page_gates(spark):
    row = "select false cancelled, true enriched, true has_image, 7 render, 8 interest, date'2026-09-01' s, date'2026-09-02' e"
    build = lambda sql: spark.sql(sql).select(scoring.front_page({"cancelled": F.col("cancelled"), "enriched": F.col("enriched"), "has_image": F.col("has_image"), "render": F.col("render"), "interest": F.col("interest"), "start": F.col("s"), "end": F.col("e")}, F.lit("2026-08-25").cast("date")).alias("f")).first().f
    assert tuple(build(row)) == (11.0, "shown")
    assert build(row.replace("7 render", "5 render")).reason == "poor render" and build(row.replace("7 render", "cast(null as int) render")).reason == "not measured"
    assert build(row.replace("2026-09-02", "2026-08-01")).reason == "over" and build(row.replace("2026-09-01", "2026-12-01").replace("2026-09-02", "2026-12-02")).reason == "not now"
    assert tuple(build(row.replace("date'2026-09-01' s, date'2026-09-02'", "cast(null as date) s, cast(null as date)"))) == (8.0, "shown")


def test_urgency(spark):
    rank = lambda base, s, e: spark.sql(f"select {base} b, cast({s} as date) s, cast({e} as date) e").select(scoring.trip_urgency(F.col("b"), F.col("s"), F.col("e"), F.lit("2026-08-15").cast("date"))).first()[0]
    assert rank(9, "'2026-08-16'", "'2026-08-16'") is None and rank(10, "'2026-08-16'", "'2026-08-16'") == 14 and rank(10, "null", "null") == 10
    assert rank(10, "'2026-08-01'", "'2026-08-14'") is None and rank(12, "'2027-08-01'", "'2027-08-02'") is None and rank(12, "'2026-08-01'", "'2026-11-15'") == 13


def test_components_are_closures_and_periods_part_them(spark):
    chain = spark.createDataFrame([(n, n + 1) for n in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in entities.components(chain).collect()}
    assert got == {n: 1 for n in range(1, 41)} | {100: 100, 101: 100}
    rows = spark.createDataFrame([("g", 1, "2026-01-01", "2026-01-10"), ("g", 2, "2026-01-05", None), ("g", 3, "2026-03-01", None)], "g string, id int, s string, e string")
    assert {r.id: r.part for r in entities.period_groups(rows, "g", "id", "s", "e").collect()} == {1: 1, 2: 1, 3: 2}


def test_merge_takes_empty_fields_from_losers(spark):
    rows = spark.createDataFrame([("g", 1, 5, "", "short"), ("g", 2, 9, None, "x"), ("g", 3, 1, "Torino", "the longest text")], "g string, id int, rank int, town string, body string")
    r = entities.merge_winner(rows, "g", [F.desc("rank"), F.asc("id")], ["town"], {"body": F.length("body")}).first()
    assert (r.id, r.town, r.body, r.members) == (2, "Torino", "the longest text", 3)


def test_longest_place_in_text(spark):
    texts = spark.createDataFrame([(1, "Concert à Saint-Jean de Maurienne!"), (2, "rien")], "id int, t string")
    names = spark.createDataFrame([("Saint-Jean",), ("Saint-Jean de Maurienne",), ("Maurienne",)], "name string")
    assert [tuple(r) for r in joins.longest_name_in(texts, F.col("t"), "id", names, "name").collect()] == [(1, "Saint-Jean de Maurienne")]


def test_band_reaches_every_gap(spark):
    days = spark.createDataFrame([("k", n, date.fromordinal(730_000 + n)) for n in range(0, 1000, 7)], "k string, id int, d date")
    later = days.selectExpr("k", "id as id2", "d as d2")
    got = {(r.id, r.id2) for r in joins.band(days, later, ["k"], "d", "d2", 300, 430).collect()}
    assert got == {(a, b) for a in range(0, 1000, 7) for b in range(0, 1000, 7) if 300 <= b - a <= 430}
