"""The catalogue's named predicates and derived ends, as Column builders. Every 'today' is a parameter."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed status values.
CLOSED, RETAINED = ("rejected", "merged"), ("evaluated", "published_cs", "published_sub")


def filled(c: Column) -> Column:
    """The value, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def as_date(c: Column) -> Column:
    """A date from yyyy-mm-dd text only; anything else, 31 February too, is absence and not an error."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def effective_end(start: Column, end: Column) -> Column:
    return F.coalesce(filled(end), filled(start))


def effective_start(start: Column, end: Column) -> Column:
    return F.coalesce(filled(start), filled(end))


def active(status: Column, duplicate_of: Column) -> Column:
    """Neither closed nor a duplicate; a null status is unknown and drops the row, as NOT IN has it."""
    return ~status.isin(*CLOSED) & duplicate_of.isNull()


def retained(status: Column, duplicate_of: Column) -> Column:
    return status.isin(*RETAINED) & duplicate_of.isNull()


def original(translation_of: Column) -> Column:
    return F.coalesce(translation_of, F.lit(0)) == 0


def online(post_id: Column) -> Column:
    return F.coalesce(post_id, F.lit(0)) > 0


def ahead(start: Column, end: Column, as_of: date, keep_undated: bool = False, recurring: Column | None = None) -> Column:
    """Not over on as_of. Undated rows drop out, or stay with keep_undated; recurring ones then stay as well."""
    last = effective_end(start, end)
    if not keep_undated:
        return last >= F.lit(as_of.isoformat())
    again = F.lit(False) if recurring is None else F.coalesce(recurring, F.lit(0)) == 1
    return again | last.isNull() | (last >= F.lit(as_of.isoformat()))


def ahead_empty_end_counts(start: Column, end: Column, as_of: date) -> Column:
    """The variant that takes an empty end as an end: such a row counts as undated and stays."""
    last = F.coalesce(end, start)
    return (F.coalesce(end, start, F.lit("")) == "") | (last >= F.lit(as_of.isoformat()))


def overlaps_strictly(start: Column, end: Column, first: str, last: str) -> Column:
    """Rows with an end only count as begun; rows with a start only do not overlap."""
    return (F.coalesce(start, F.lit("")) <= last) & (F.coalesce(end, F.lit("")) >= first)


def overlaps(start: Column, end: Column, first: str, last: str) -> Column:
    return (effective_start(start, end) <= last) & (effective_end(start, end) >= first)


def undated(start: Column, end: Column) -> Column:
    return (F.coalesce(start, F.lit("")) == "") & (F.coalesce(end, F.lit("")) == "")


def cooled_down(last_try: Column, days: int, as_of: Column) -> Column:
    return last_try.isNull() | (last_try < as_of - F.make_dt_interval(F.lit(days)))


def by_radar(source_type: Column, source_name: Column) -> Column:
    return (F.coalesce(F.lower(F.trim(source_type)), F.lit("")) == "radar") | F.coalesce(source_name, F.lit("")).ilike("%(radar)%")


def by_mail(url: Column) -> Column:
    return F.coalesce(url, F.lit("")).ilike("gmail:%")


def missing_fields(fields: dict[str, Column], exempt: dict[str, Column] | None = None) -> Column:
    """Names of empty fields, but for those whose exemption holds (recurring rows need no date, many venues no place)."""
    exempt = exempt or {}
    tests = [F.when((F.coalesce(F.trim(c.cast("string")), F.lit("")) == "") & ~F.coalesce(exempt.get(n, F.lit(False)), F.lit(False)), F.lit(n)) for n, c in fields.items()]
    return F.array_compact(F.array(*tests))
