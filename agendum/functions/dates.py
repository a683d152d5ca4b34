"""Dates in French and Italian text, and verdicts of dates against a page, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agendum.functions.text import fold, let

#: Fixed names of months, folded; French, then Italian.
MONTHS = {
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12,
    "gennaio": 1, "febbraio": 2, "marzo": 3, "aprile": 4, "maggio": 5, "giugno": 6, "luglio": 7, "agosto": 8, "settembre": 9, "ottobre": 10, "dicembre": 12,
}
#: Fixed names of weekdays, folded, Monday first.
WEEKDAYS = {
    "lundi": 0, "mardi": 1, "mercredi": 2, "jeudi": 3, "vendredi": 4, "samedi": 5, "dimanche": 6,
    "lunedi": 0, "martedi": 1, "mercoledi": 2, "giovedi": 3, "venerdi": 4, "sabato": 5, "domenica": 6,
}
GRACE, FAR = 60, 180

_M = "(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + ")"
_D, _Y, _DAY = r"(\d{1,2})(?:er|°|º)?", r"(?:\s+((?:19|20)\d{2}))?", r"(?:[a-z]+\s+)?"
ISO = r"\b((?:19|20)\d{2}-\d{2}-\d{2})\b"
SAME_MONTH = rf"\b{_D}\s*(?:au|al|et|e|&|-)\s*{_DAY}{_D}\s+{_M}{_Y}"
TWO_MONTHS = rf"\b(?:du|dal|dall')?\s*{_DAY}{_D}\s+{_M}{_Y}\s*(?:au|al|all'|-)\s*{_DAY}{_D}\s+{_M}{_Y}"
UNTIL = rf"(?:jusqu'au|fino al|fino all')\s*{_DAY}{_D}\s+{_M}{_Y}"
SINGLE = rf"\b{_D}\s+{_M}{_Y}"
NUMERIC = r"\b(\d{1,2})[/.](\d{1,2})[/.]((?:19|20)\d{2})\b"


def month_number(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    return F.try_element_at(table, name)


def day_of(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is none: 31 February is absence."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def _int(text: Column, pattern: str, n: int) -> Column:
    return _group(text, pattern, n).cast("int")


def implied_year(month: Column, day: Column, as_of: Column) -> Column:
    """The reference year, or the next where that day is over for more than the grace."""
    past = F.datediff(as_of, day_of(F.year(as_of), month, day)) > GRACE
    return F.year(as_of) + F.when(past, 1).otherwise(0)


def named_weekdays(text: Column) -> Column:
    words = F.split(F.regexp_replace(fold(text), "[^a-z]+", " "), " ")
    table = F.create_map(*[F.lit(x) for kv in WEEKDAYS.items() for x in kv])
    return F.array_distinct(F.array_compact(F.transform(words, lambda w: F.try_element_at(table, w))))


def parse_dates(text: Column, as_of: Column) -> Column:
    """struct(start, end, source) of the first rule that gives valid dates; null if none does.

    In this order: ISO dates; days of one month; days of two months; until a day (no start); one day; numbers. A day
    without a year takes the reference year or, more than 60 days past, the next; if that lies over 180 days ahead the
    source is 'annee_devinee_lointaine' without dates. A single day that contradicts the weekday named beside it gives
    'jour_incoherent' without dates. A rule that matches an invalid date leaves it to the next.
    """
    t = F.replace(F.trim(F.regexp_replace(fold(text), "[\\s’]+", " ")), F.lit("jusqu au"), F.lit("jusqu'au"))
    found = let(t, lambda t: F.coalesce(*[rule(t, as_of) for rule in (_iso, _same_month, _two_months, _until, _single, _numeric)]))

    def checked(f: Column) -> Column:
        alone = f["start"].isNotNull() & (f["start"] == f["end"])
        contrary = let(F.when(alone, named_weekdays(text)), lambda named: (F.size(named) == 1) & ~F.array_contains(named, F.weekday(f["start"])))
        return F.when(alone & contrary, _result(None, None, "jour_incoherent")).otherwise(f)

    return let(found, checked)


def _result(start: Column | None, end: Column | None, source: str) -> Column:
    day = lambda d: F.lit(None).cast("date") if d is None else d
    return F.struct(day(start).alias("start"), day(end).alias("end"), F.lit(source).alias("source"))


def _found(start: Column | None, end: Column, guessed: Column, source: str, as_of: Column) -> Column:
    """A rule's result: null without valid days; a guessed year that lands too far ahead is a result of its own."""
    days = F.struct((F.lit(None).cast("date") if start is None else start).alias("s"), end.alias("e"), guessed.alias("g"))

    def made(d: Column) -> Column:
        first = F.coalesce(d["s"], d["e"])
        valid = d["e"].isNotNull() & (d["s"] <= d["e"] if start is not None else F.lit(True))
        far = d["g"] & (F.year(first) > F.year(as_of)) & (F.datediff(first, as_of) > FAR)
        return F.when(valid & far, _result(None, None, "annee_devinee_lointaine")).when(valid, _result(None if start is None else d["s"], d["e"], source))

    return let(days, made)


def _parts(t: Column, pattern: str, fields: list[tuple[str, int]], body) -> Column:
    """body of a struct with the pattern's groups: months by name as numbers, the rest as integers; null where it does not match."""
    read = lambda kind, n: (month_number(_group(t, pattern, n)) if kind[0] == "m" else _int(t, pattern, n)).alias(kind)
    return F.when(t.rlike(pattern), let(F.struct(*[read(k, n) for k, n in fields]), body))


def _iso(t: Column, as_of: Column) -> Column:
    days = F.filter(F.transform(F.regexp_extract_all(t, F.lit(ISO), 1), lambda x: F.try_to_date(x, "yyyy-MM-dd")), lambda d: d.isNotNull())
    return F.when(t.rlike(ISO), let(days, lambda d: F.when(F.size(d) > 0, _result(F.array_min(d), F.array_max(d), "iso"))))


def _same_month(t: Column, as_of: Column) -> Column:
    def body(p: Column) -> Column:
        year = F.coalesce(p["y"], implied_year(p["m"], p["d2"], as_of))
        return let(year, lambda y: _found(day_of(y, p["m"], p["d1"]), day_of(y, p["m"], p["d2"]), p["y"].isNull(), "plage", as_of))

    return _parts(t, SAME_MONTH, [("d1", 1), ("d2", 2), ("m", 3), ("y", 4)], body)


def _two_months(t: Column, as_of: Column) -> Column:
    def body(p: Column) -> Column:
        wraps = F.when(p["m2"] < p["m1"], 1).otherwise(0)
        last = F.coalesce(p["y2"], p["y1"] + wraps, implied_year(p["m2"], p["d2"], as_of))
        return let(last, lambda y: _found(day_of(F.coalesce(p["y1"], y - wraps), p["m1"], p["d1"]), day_of(y, p["m2"], p["d2"]), p["y1"].isNull() & p["y2"].isNull(), "plage", as_of))

    return _parts(t, TWO_MONTHS, [("d1", 1), ("m1", 2), ("y1", 3), ("d2", 4), ("m2", 5), ("y2", 6)], body)


def _one_day(pattern: str, source: str, with_start: bool):
    def rule(t: Column, as_of: Column) -> Column:
        def body(p: Column) -> Column:
            day = day_of(F.coalesce(p["y"], implied_year(p["m"], p["d"], as_of)), p["m"], p["d"])
            return let(day, lambda d: _found(d if with_start else None, d, p["y"].isNull(), source, as_of))

        return _parts(t, pattern, [("d", 1), ("m", 2), ("y", 3)], body)

    return rule


_until, _single = _one_day(UNTIL, "jusqu_au", False), _one_day(SINGLE, "date", True)


def _numeric(t: Column, as_of: Column) -> Column:
    day = day_of(_int(t, NUMERIC, 3), _int(t, NUMERIC, 2), _int(t, NUMERIC, 1))
    return F.when(t.rlike(NUMERIC), let(day, lambda d: _found(d, d, F.lit(False), "numerique", as_of)))


def start_time(text: Column) -> Column:
    """HH:MM of the first hour: Italian 'ore 21' and '21:30', and, beyond what the folded pattern of old could match, French '20h30' after à or dès."""
    t = fold(text)
    both = r"(?:\bore\s+(\d{1,2})(?:[:.](\d{2}))?|\b(?:a|des)\s+(\d{1,2})\s?h\s?(\d{2})?)"
    hour, minute = F.coalesce(_int(t, both, 1), _int(t, both, 3)), F.coalesce(_int(t, both, 2), _int(t, both, 4), F.lit(0))
    return F.when((hour < 24) & (minute < 60), F.format_string("%02d:%02d", hour, minute))


def bounds_verdict(start: Column, end: Column, ranges: Column, days: Column) -> Column:
    """Stored bounds against a page's ranges (array of start, end) and days that stand alone: the first that holds of
    confirmed, collapsed (a page range begins that one day), contradicted, ambiguous (other ranges) and silent."""
    end = F.coalesce(end, start)
    one = start == end
    same = lambda f: F.exists(ranges, f)
    return (
        F.when(same(lambda r: (r["start"] == start) & (r["end"] == end)), "confirmed").when(one & F.array_contains(days, start), "confirmed")
        .when(one & same(lambda r: r["start"] == start), "collapsed").when(same(lambda r: r["start"] == start), "contradicted")
        .when(same(lambda r: r["end"] == end), "contradicted").when(F.size(ranges) > 0, "ambiguous").otherwise("silent")
    )


def possible_years(day: Column, weekday: Column) -> Column:
    """Years around the day's in which its day and month fall on the weekday (Monday 0)."""
    years = F.sequence(F.year(day) - 6, F.year(day) + 2)
    return F.filter(years, lambda y: F.weekday(day_of(y, F.month(day), F.day(day))) == weekday)


def dated_before_found(start: Column, found: Column, grace: int = GRACE) -> Column:
    """An event that was over for longer than the grace when it was found carries a wrong year."""
    return F.datediff(found, start) > grace


def url_date(url: Column) -> Column:
    """The date that a URL's path carries: yyyy/mm/dd, yyyy-mm-dd or yyyymmdd."""
    p = r"(?<!\d)((?:19|20)\d{2})[-/]?(0[1-9]|1[0-2])[-/]?(0[1-9]|[12]\d|3[01])(?!\d)"
    return day_of(_int(url, p, 1), _int(url, p, 2), _int(url, p, 3))
