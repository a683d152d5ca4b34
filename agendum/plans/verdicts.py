"""Queries of dates in words and of verdicts on texts: texts are made of a table's days or of phrases, and SQL says what must be read in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agendum.catalog import table
from agendum.functions import catalogue, dates, verdicts, web
from agendum.functions import editorial as ed
from agendum.functions import text as tx
from agendum.operators import pairing

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


FRENCH = list(dates.MONTHS)[:12]
ITALIAN = ["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"]


def _as_of() -> Column:
    return F.lit("1996-06-01").cast("date")


_DAYS = "SELECT o_orderkey AS id, o_custkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 20 AS INTEGER) AS e FROM orders"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", s.alias("s"), F.date_add(s, (1 + F.col("o_orderkey") % 20).cast("int")).alias("e"))


def _spoken(day: Column, italian: Column) -> Column:
    """3 juin 1997 or 3 giugno 1997."""
    name = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), F.month(day))
    return F.concat_ws(" ", F.day(day), F.when(italian, name(ITALIAN)).otherwise(name(FRENCH)), F.year(day))


@query(f"""
SELECT id, CASE id % 6 WHEN 2 THEN NULL ELSE s END AS first, CASE WHEN id % 6 IN (3, 4) THEN s ELSE e END AS last, ['iso', 'plage', 'jusqu_au', 'date', 'numerique'][id % 6 + 1] AS source FROM ({_DAYS}) WHERE id % 6 < 5
""")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days written as ISO, ranges, ends, single days and numbers in two languages, read back; texts without dates give no row."""
    italian = F.col("o_custkey") % 2 == 0
    first, last = _spoken(F.col("s"), italian), _spoken(F.col("e"), italian)
    form = F.col("id") % 6
    text = (
        F.when(form == 0, F.concat(F.lit("Del "), "e", F.lit(" e "), "s")).when(form == 1, F.when(italian, F.concat(F.lit("Festa dal "), first, F.lit(" al "), last)).otherwise(F.concat(F.lit("Fête du "), first, F.lit(" au "), last)))
        .when(form == 2, F.when(italian, F.concat(F.lit("Fino al "), last)).otherwise(F.concat(F.lit("Jusqu’au "), last))).when(form == 3, F.concat(F.lit("Ouvert le "), first, F.lit(" !")))
        .when(form == 4, F.date_format("s", "'le 'dd/MM/yyyy")).otherwise("sans date, 12 places en juin")
    )
    read = _days(spark, sf_dir).select("id", dates.parse_dates(text, _as_of()).alias("d")).filter("d is not null")
    return read.select("id", F.col("d.start").alias("first"), F.col("d.end").alias("last"), F.col("d.source").alias("source"))


@query(f"""
SELECT id, CASE WHEN isodow(s) - 1 = id % 7 THEN s END AS first, CASE WHEN isodow(s) - 1 = id % 7 THEN 'date' ELSE 'jour_incoherent' END AS source FROM ({_DAYS})
""")
def weekday_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weekday named beside a single day must be that day's."""
    named = F.element_at(F.array(*[F.lit(n) for n in list(dates.WEEKDAYS)[:7]]), (F.col("id") % 7 + 1).cast("int"))
    text = F.concat_ws(" ", F.lit("Concert le"), named, _spoken(F.col("s"), F.lit(False)))
    return _days(spark, sf_dir).select("id", dates.parse_dates(text, _as_of()).alias("d")).select("id", F.col("d.start").alias("first"), F.col("d.source").alias("source"))


@query(f"""
WITH d AS (SELECT *, id % 5 AS k, strftime(s, '%m-%d') = '02-29' OR strftime(e, '%m-%d') = '02-29' AS leap FROM ({_DAYS}))
SELECT CASE k WHEN 0 THEN 'confirmed' WHEN 1 THEN 'bound' WHEN 2 THEN CASE WHEN leap THEN 'contradicted' ELSE 'year' END WHEN 3 THEN 'contradicted' ELSE 'silent' END AS verdict, count(*) AS n FROM d GROUP BY 1
""")
def confrontation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored dates against what a text says of them."""
    kind = F.col("id") % 5
    text = F.when(kind == 4, "bientôt").otherwise(F.concat(F.lit("du "), _spoken(F.col("s"), F.lit(False)), F.lit(" au "), _spoken(F.col("e"), F.lit(False))))
    start = F.when(kind == 2, F.add_months("s", 12)).when(kind == 3, F.date_add("s", 3)).otherwise(F.col("s"))
    end = F.when(kind == 1, F.date_add("e", 1)).when(kind == 2, F.add_months("e", 12)).when(kind == 3, F.date_add("e", 5)).otherwise(F.col("e"))
    return _days(spark, sf_dir).groupBy(ed.text_verdict(start, end, text, _as_of()).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE printf('%02d:%02d', id % 24, CASE WHEN id % 4 = 2 THEN 0 ELSE id % 60 END) END AS at FROM ({_DAYS})")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour, minute = F.col("id") % 24, F.format_string("%02d", F.col("id") % 60)
    kind = F.col("id") % 4
    text = F.when(kind == 0, F.concat(F.lit("Concerto, ore "), hour, F.lit(":"), minute)).when(kind == 1, F.concat(F.lit("Bal à "), hour, F.lit("h"), minute)).when(kind == 2, F.concat(F.lit("ore "), hour, F.lit(" circa"))).otherwise("le soir")
    return _days(spark, sf_dir).select("id", dates.start_time(text).alias("at"))


@query(f"SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE s END AS day FROM ({_DAYS})")
def url_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("id") % 4
    path = F.when(kind == 0, F.date_format("s", "yyyy/MM/dd")).when(kind == 1, F.date_format("s", "yyyy-MM-dd")).when(kind == 2, F.date_format("s", "yyyyMMdd")).otherwise("agenda/12")
    return _days(spark, sf_dir).select("id", dates.url_date(F.concat(F.lit("https://x.org/"), path, F.lit("/fete"))).alias("day"))


@query(f"SELECT id, CAST(CASE WHEN make_date(1996, month(s), day(s)) < DATE '1996-06-01' - 60 THEN 1997 ELSE 1996 END AS INTEGER) AS year FROM ({_DAYS})")
def implied_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).select("id", dates.implied_year(F.month("s"), F.day("s"), _as_of()).cast("int").alias("year"))


@query(f"""
SELECT id, array_to_string(list_filter(range(year(s) - 6, year(s) + 3), lambda y: isodow(TRY_CAST(y || strftime(s, '-%m-%d') AS DATE)) - 1 = id % 7), ',') AS years FROM ({_DAYS})
""")
def possible_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = dates.possible_years(F.col("s"), F.col("id") % 7)
    return _days(spark, sf_dir).select("id", F.array_join(F.transform(years, lambda y: y.cast("string")), ",").alias("years"))


@query(f"SELECT count(*) FILTER (s + CAST(o_custkey % 150 AS INTEGER) - s > 60) AS late, count(*) AS n FROM ({_DAYS})")
def dated_before_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = dates.dated_before_found(F.col("s"), F.date_add("s", (F.col("o_custkey") % 150).cast("int")))
    return _days(spark, sf_dir).agg(F.count_if(late).alias("late"), F.count(F.lit(1)).alias("n"))


def _phrases(spark: SparkSession, sf_dir: str, phrases: list[str]) -> DataFrame:
    """Every part with one of the phrases, in turn."""
    at = (F.col("p_partkey") % len(phrases) + 1).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(p) for p in phrases]), at).alias("text"))


def _said(pairs: list[tuple[str, str | None]], name: str) -> str:
    value = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"SELECT p_partkey, [{', '.join(value(v) for _, v in pairs)}][p_partkey % {len(pairs)} + 1] AS {name} FROM part"


#: What the documents hold of news: the engine's signs, and notices, insults and function words of the corpus.
NEWS = [
    *verdicts.NON_EVENT, verdicts.Sign("notice", ("released. licensed. redistribut", "mit. apache. gnu. cc. permitted."), 2),
    verdicts.Sign("insult", ("disgusting. worthless. stupid. idiot. trash. scum.",)), verdicts.Sign("French", ("les. des.", "et. ou."), 1), verdicts.Sign("German", ("der. die. das.", "und."), 2),
]
_FOLDED = "replace(replace(replace(regexp_replace(lower(strip_accents({c})), '[\u0300-\u036f]', '', 'g'), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')"
_REASON = "CASE " + " ".join(f"WHEN regexp_matches(t, '{s.pattern()}') THEN '{s.reason}'" for s in NEWS) + " END"


@query(f"SELECT doc_id, reason FROM (SELECT doc_id, {_REASON} AS reason FROM (SELECT doc_id, {_FOLDED.format(c='text')} AS t FROM documents)) WHERE reason IS NOT NULL")
def non_event_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a sign stands, and the first one's reason."""
    found = table(spark, sf_dir, "documents").select("doc_id", verdicts.non_event_reason(F.lit(None).cast("string"), F.col("text"), NEWS).alias("reason"))
    return found.filter("reason is not null")


@query(f"""
WITH w AS (SELECT doc_id, string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents),
n AS (SELECT doc_id, list_transform(w[1:2], lambda x: upper(x[1]) || lower(x[2:])) AS n FROM w),
j AS (SELECT doc_id, n, array_to_string(n, ' ') AS name FROM n)
SELECT doc_id, CASE WHEN name = '' THEN 'empty' WHEN len(n) < 2 OR length(name) > 60 OR regexp_matches(name, '[\\p{{N}}@/|:;-]') OR len(list_filter(n, lambda x: NOT regexp_matches(x, '^\\p{{Lu}}')
    OR regexp_matches({_FOLDED.format(c='x')}, '^{verdicts._any(verdicts.BODIES)}$'))) > 0 THEN 'body' WHEN doc_id % 3 = 0 THEN 'corroborated' ELSE 'person' END AS verdict
FROM j WHERE NOT contains(name, '-')
""")
def byline_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of each document as a name; every third document says that it has organised what is told."""
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    name = F.array_join(F.transform(F.slice(words, 1, 2), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), " ")
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), "text").filter(~F.contains("name", F.lit("-")))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", F.col("text"), F.lit(". Soirée proposée avec joie par"), "name", F.lit("."))).otherwise(F.col("text"))
    return rows.select("doc_id", verdicts.byline_verdict(F.col("name"), said).alias("verdict"))


CALLED_OFF = [("Concert annulé", "yes"), ("ANNULATION du bal", "yes"), ("Sagra rinviata a maggio", "yes"), ("Fête de la musique", "no"), ("Festa annullata", "yes"), ("Annulaire et bagues", "no")]


@query(_said(CALLED_OFF, "off"))
def cancelled_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir, [t for t, _ in CALLED_OFF]).select("p_partkey", F.when(tx.cancelled(F.col("text")), "yes").otherwise("no").alias("off"))


POLISHED = [("Venez , nombreux .", "Venez, nombreux."), ("Quoi ?  Une fête !", "Quoi ? Une fête !"), ("Et puis...", "Et puis…")]


@query(_said(POLISHED, "text"))
def polished_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir, [t for t, _ in POLISHED]).select("p_partkey", ed.polished(F.col("text")).alias("text"))


LABELS = [("Lieu : Salle des fêtes\nSuite", "Salle des fêtes"), ("Dove: Torino", "Torino"), ("rien ici", None)]


@query(_said(LABELS, "place"))
def labelled_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir, [t for t, _ in LABELS]).select("p_partkey", catalogue.labelled_value(F.col("text"), ["Lieu", "Dove"]).alias("place"))


ACRONYMS = [("La MJC et la MJC", "La MJC (Maison des jeunes) et la MJC"), ("MJC, Maison des Jeunes", "MJC, Maison des Jeunes"), ("Le bal", "Le bal")]


@query(_said(ACRONYMS, "text"))
def expanded_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir, [t for t, _ in ACRONYMS]).select("p_partkey", catalogue.expanded_once(F.col("text"), {"MJC": "Maison des jeunes"}).alias("text"))


STEMS = [("fromage|fromagerie", "yes"), ("festa|fete", "no"), ("musica|musique", "yes"), ("vino|vin", "yes"), ("bal|mer", "no")]


@query(_said(STEMS, "kin"))
def kindred_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("text", r"\|")
    return _phrases(spark, sf_dir, [t for t, _ in STEMS]).select("p_partkey", F.when(tx.same_root(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))), "yes").otherwise("no").alias("kin"))


FLEETING = [("Rendez-vous demain ; demain encore, puis lundi prochain.", "demain,lundi prochain"), ("Domani e questa sera", "domani,questa sera"), ("Un marché chaque été", ""), ("AUJOURD’HUI, la foire", "aujourd")]


@query(_said(FLEETING, "signs"))
def perishable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir, [t for t, _ in FLEETING]).select("p_partkey", F.array_join(verdicts.perishable(F.col("text")), ",").alias("signs"))


@query(f"SELECT ['linked', 'missing', 'elsewhere', 'itself'][id % 4 + 1] AS verdict, count(*) AS n FROM ({_DAYS}) GROUP BY 1")
def hreflang_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages' alternates say of the links to their twins."""
    kind, page = F.col("id") % 4, lambda lang, n: F.struct(F.lit(lang).alias("lang"), F.concat(F.lit("/"), n.cast("string")).alias("href"))
    named = F.when(kind == 0, page("it", F.col("id") + 1)).when(kind == 1, page("de", F.col("id") + 1)).when(kind == 2, page("it", F.col("id") + 9)).otherwise(page("it", F.col("id")))
    verdict = web.hreflang_verdict(page("fr", F.col("id")), F.array(page("fr", F.col("id")), named), page("it", F.col("id") + 1))
    return _days(spark, sf_dir).groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
SELECT page_id, array_to_string(list_transform(string_split_regex(html, '(?i)<div\b')[2:], lambda s: len(regexp_extract_all(s, '(?i)<p\b'))), ',') AS cards FROM pages
""")
def section_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = web.section_counts(F.col("html"), "div", "p")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(counts, lambda n: n.cast("string")), ",").alias("cards"))


@query("""
WITH p AS (SELECT p_partkey AS id, p_brand, p_size > 25 AS online, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part)
SELECT r.id AS id, min(o.id) AS online_id FROM p r JOIN p o ON r.p_brand = o.p_brand AND NOT r.online AND o.online AND len(list_intersect(r.w, o.w)) >= 2 AND len(list_intersect(r.w, o.w)) * 10 >= least(len(r.w), len(o.w)) * 9 GROUP BY r.id
""")
def rejected_but_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows whose title an online row of the territory has in nine words of ten."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.col("p_brand").alias("territory"), (F.col("p_size") > 25).alias("online"))
    return pairing.reclassified(rows, 0.9)
