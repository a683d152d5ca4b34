"""Rules on word lists, windows and places; sources and sinks; streams against their batch twins."""

import json
import zipfile
from datetime import date, datetime

from pyspark.sql import functions as F

from agendum.catalog import EVENT_SCHEMA, events_from, union_channels
from agendum.functions import catalogue as c
from agendum.operators import audits, snapshots
from agendum.sources import files
from agendum.streaming import jobs


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_exclusion_scopes(spark):
    rows = [("Vide-grenier", "x"), ("Concert", "un vide-grenier suit"), ("Loto géant", ""), ("Concert", "loto"), (None, None)]
    assert values(spark, c.excluded(F.col("t"), F.col("b"), ["vide-grenier"], ["loto"]), rows, "t string, b string") == [True, True, True, False, False]


def test_scope_reason_and_labels(spark):
    assert values(spark, c.out_of_scope(F.col("t"), ["annecy"], ["lyon"]), [("à Lyon",), ("Lyon et Annecy",), ("Lyonnais",), (None,)], "t string") == [True, False, False, False]
    assert values(spark, c.first_match(F.col("t"), [("works", "travaux"), ("vote", r"\belections?\b")]), [("Élections",), ("Travaux, élections",), ("Fête",)], "t string") == ["vote", "works", None]
    assert values(spark, c.doubt_or_absence(F.col("t"), "absent|manque", "incertain"), [("date absente ?",), ("date ?",), ("lieu incertain",), ("autre",)], "t string") == ["absence", "doubt", "doubt", "absence"]


def test_umbrella_needs_every_declared_condition(spark):
    events = spark.createDataFrame([(1, date(2026, 6, 21), "A", "s"), (2, date(2026, 6, 21), "B", "s"), (3, date(2026, 7, 1), "A", "s"), (4, None, "A", "s")], "id int, start date, territory string, source string")
    moments = spark.createDataFrame([("music", date(2026, 6, 20), date(2026, 6, 22), ["A"], []), ("all", date(2026, 6, 1), date(2026, 6, 30), [], None)], "slug string, first date, last date, territories array<string>, sources array<string>")
    assert {r.id: r.tags for r in c.umbrella_tags(events, moments, "id", "start", "territory", "source").collect()} == {1: ["all", "music"], 2: ["all"]}


def test_season_changes(spark):
    windows = [("11-15", "02-20", "high"), ("06-21", "09-20", "mid")]
    got = [(r.day.isoformat(), r.before, r.level) for r in c.next_changes(spark, windows, "low", date(2026, 1, 1)).collect()]
    assert got == [("2026-02-21", "high", "low"), ("2026-06-21", "low", "mid"), ("2026-09-21", "mid", "low"), ("2026-11-15", "low", "high")]


def test_info_and_labels(spark):
    assert values(spark, c.practical_info(F.col("t"), {"price": r"\d+ ?€", "phone": r"\b0\d(?: \d\d){4}\b"}), [("12 € au 04 50 11 22 33",), ("rien",)], "t string") == [{"price": "12 €", "phone": "04 50 11 22 33"}, {}]
    assert values(spark, c.labelled_value(F.col("t"), ["Lieu", "Dove"]), [("Bonjour\nLieu : Salle des fêtes \nx",), ("Dove: Torino",), ("x",)], "t string") == ["Salle des fêtes", "Torino", None]
    assert values(spark, c.unfolded_info(F.col("t"), ["tarif"])["ip_tarif"], [('{"tarif": ["5 €", "x"]}',), ("broken",), ('{"tarif": []}',)], "t string") == ["5 €", None, None]


def test_acronyms_once_and_tags(spark):
    known = {"MJC": "Maison des jeunes"}
    assert values(spark, c.expanded_once(F.col("t"), known), [("La MJC et la MJC",), ("MJC, Maison des Jeunes",)], "t string") == ["La MJC (Maison des jeunes) et la MJC", "MJC, Maison des Jeunes"]
    assert values(spark, c.hashtags(F.col("a"), F.col("b"), ["alpes"]), [("Aix-les-Bains", "Fête"), ("", None)], "a string, b string") == [["#aixlesbains", "#fete", "#alpes"], ["#alpes"]]


def test_schema_org_leaves_empty_out(spark):
    row = {k: F.col(k) for k in ("title", "start", "end", "place", "town", "image", "url")}
    got = values(spark, c.schema_org_event(row), [("A", date(2026, 1, 2), None, " ", "", None, "u")], "title string, start date, end date, place string, town string, image string, url string")
    assert json.loads(got[0]) == {"@context": "https://schema.org", "@type": "Event", "name": "A", "startDate": "2026-01-02", "endDate": "2026-01-02", "url": "u"}


def test_similar_titles_top(spark):
    pairs = spark.createDataFrame([(1, "Fête de la musique", 10, "fete de la MUSIQUE"), (1, "Fête de la musique", 11, "Fête de la mer"), (1, "Fête de la musique", 12, "xyz"), (2, "", 10, "a")], "id int, a string, other int, b string")
    assert [(r.id, r.other, r.rank) for r in c.best_matches(pairs, "id", "a", "b", "other").orderBy("rank").collect()] == [(1, 10, 1), (1, 11, 2)]


def test_venue_conflicts(spark):
    events = spark.createDataFrame([(1, "Théâtre Municipal", "Annecy"), (2, "theatre municipal", "Lyon"), (3, "Autre", "X"), (4, "Théâtre Municipal", None)], "id int, venue string, town string")
    registry = spark.createDataFrame([("Theatre municipal", "ANNECY")], "venue string, town string")
    assert [tuple(r) for r in c.venue_conflicts(events, registry, "id", "venue", "town").collect()] == [(2, "Lyon", "ANNECY")]


def test_registry_log_and_corrections(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# comment\nhttps://a ; Alpes ; A ; 2\nhttps://b;Alpes;B;;Salle;Annecy\n")
    rows = {r.url: r for r in files.source_registry(spark, str(tmp_path / "s.txt")).collect()}
    assert (rows["https://a"].tier, rows["https://b"].tier, rows["https://b"].town, rows["https://a"].town) == (2, 1, "Annecy", None)
    (tmp_path / "log.jsonl").write_text('{"label": "x", "cost": 1.5}\nnot json\n{"label": "", "cost": 2}\n')
    assert {(r.label, r.cost) for r in files.log_lines(spark, str(tmp_path / "log.jsonl"), "label string, cost double").collect()} == {("x", 1.5), ("(none)", 2.0)}
    (tmp_path / "c.tsv").write_text("1\t2026-01-01\n3\t2026-02-02\n")
    base = spark.createDataFrame([(1, "old", "t"), (2, "keep", "t")], "id long, day string, t string")
    assert {tuple(r) for r in files.corrected(base, files.corrections(spark, str(tmp_path / "c.tsv"), "id long, day string"), "id").collect()} == {(1, "2026-01-01", "t"), (2, "keep", "t")}


def test_feeds_and_sitemaps(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title><![CDATA[A & B]]></title><link>https://x/1?utm_source=y</link></item><item><title>again</title><link>https://x/1</link></item><item><title>no link</title></item></channel></rss>")
    assert [(r.title, r.link) for r in files.feed_entries(spark, str(tmp_path / "f.xml")).collect()] == [("A & B", "https://x/1")]
    (tmp_path / "m.xml").write_text("<urlset><url><loc> https://x/a?b=1&amp;c=2 </loc></url><url><loc>https://x/a?b=1&amp;c=2</loc></url></urlset>")
    assert [tuple(r) for r in files.sitemap_urls(spark, str(tmp_path / "m.xml")).collect()] == [("page", "https://x/a?b=1&c=2")]


def test_mails_and_archives(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: Office <news@mail.town.example>\r\nSubject: =?utf-8?q?F=C3=AAte?=\r\nMessage-ID: <1@x>\r\nDate: Fri, 04 Sep 2026 10:00:00 +0200\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>hi</p>\r\n")
    mail = files.mails(spark, str(tmp_path / "*.eml"))
    r = mail.first()
    assert (r.message_id, r.sender_host, r.subject, r.text, r.html.strip()) == ("<1@x>", "mail.town.example", "Fête", None, "<p>hi</p>")
    hosts = spark.createDataFrame([("n", "town.example", "Alpes", "on")], "name string, domain string, territory string, status string")
    assert [x.territory for x in files.from_whitelisted(mail, hosts, date(2026, 9, 6), 7).collect()] == ["Alpes"]
    assert files.from_whitelisted(mail, hosts, date(2026, 9, 30), 7).count() == 0
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/Pages.csv", "﻿page,clicks\nhttps://x,3\n")
    assert [tuple(x) for x in files.zipped_csv(spark, str(tmp_path / "z.zip"), "Pages.csv", ["page", "clicks"]).collect()] == [("https://x", "3")]


def test_schema_evolution(spark):
    old = events_from(spark.createDataFrame([("1", "A", "", "2026-01-02T03:04:05")], "id string, TITLE string, ville string, created_at string"))
    assert old.schema.names == EVENT_SCHEMA.names
    r = old.first()
    assert (r.id, r.title, r.ville, r.created_at, r.home_score) == (1, "A", None, "2026-01-02 03:04:05", None)
    assert union_channels(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")).count() == 2


def test_reachability_door_and_domains(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "a string, b string")
    roots, declared = spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("c",), ("x",)], "node string")
    assert {r.node for r in audits.reachable(edges, roots).collect()} == {"a", "b", "c"} and [r.node for r in audits.unreached(declared, edges, roots).collect()] == ["x"]
    assert values(spark, audits.registrable_domain(F.col("h")), [("a.b.example.org",), ("www.shop.co.uk",), ("localhost",)], "h string") == ["example.org", "shop.co.uk", "localhost"]
    assert values(spark, audits.looks_shouty(F.col("t")), [("GRANDE FÊTE du",), ("ABC",), ("Grande fête",)], "t string") == [True, False, False]
    assert values(spark, audits.origin_of(F.col("u")), [("translated:12:it",), ("https://x",)], "u string") == [(12, "it"), None]


def test_unmerge_restores_the_first_status(spark):
    rows = spark.createDataFrame([(1, "merged", 9), (2, "merged", 9)], "id long, status string, duplicate_of long")
    log = spark.createDataFrame([(1, 5, "evaluated"), (1, 6, "merged"), (2, 7, "pending")], "id long, merge_id long, prior_status string")
    got = snapshots.unmerge(rows, log, spark.createDataFrame([(5,), (6,)], "merge_id long"), "id").orderBy("id").collect()
    assert [(r.status, r.duplicate_of) for r in got] == [("evaluated", None), ("merged", 9)]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    kinds = ["signal", "resolve", "signal", "escalate", "other", "resolve"]
    rows = [(f"k{n % 3}", n, kinds[(n * 5) % 6], datetime(2026, 1, 1, 0, n), n % 4 != 0) for n in range(40)]
    df = spark.createDataFrame(rows, "k string, at long, kind string, ts timestamp, failed boolean")
    for part in range(4):  # four files, in order, make four batches
        df.filter(F.col("at").between(part * 10, part * 10 + 9)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = {}
    jobs.run_batches(jobs.decision_states(stream(), "k", "kind", "at"), lambda b, _: got.update({r.k: (r.status, r.seen, r.reopened) for r in b.collect()}), f"{tmp_path}/c1")
    assert got == {r.k: (r.status, r.seen, r.reopened) for r in snapshots.fold_decisions(df, "k", "kind", ["at"]).collect()}
    jobs.run_available(jobs.failure_streaks(stream(), "k", "failed", "at"), f"{tmp_path}/o2", f"{tmp_path}/c2")
    raised = spark.read.parquet(f"{tmp_path}/o2")
    assert sorted(r.k for r in raised.collect()) == sorted(r.k for r in audits.failure_islands(df, "k", "failed", ["at"]).collect())
    jobs.run_available(jobs.once_by_key(stream(), "k", "ts"), f"{tmp_path}/o3", f"{tmp_path}/c3")
    assert spark.read.parquet(f"{tmp_path}/o3").count() == 3
    assert jobs.stale(df, "k", "ts", datetime(2026, 1, 1, 1, 0), "22 minutes").count() == 1 and jobs.due(df, "ts", datetime(2026, 1, 1, 0, 5)).count() == 6
