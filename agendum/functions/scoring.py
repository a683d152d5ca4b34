"""Scores, urgency, seasons and labels of time as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agendum.functions.text import whole

#: Fixed weights, floors and windows of the trip score.
WEIGHTS, TRADITION, VENUE_CAP = {"rayonnement": 2, "specificite": 3}, "tradition", 1
FLOOR, WINDOWS, HORIZON, PUNCTUAL = 10, ((7, 3), (21, 2), (45, 1)), 183, 4
#: Fixed gates of the front page.
RENDER_FLOOR, INTEREST_FLOOR, SOON = 6, 6, 30


def iso_week(ts: Column) -> Column:
    """2027-01-01 lies in 2026-W53."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))


def points(detail: Column, name: str) -> Column:
    """The points of a criterion in a parsed detail: {"points": n} or a bare number; else null."""
    return F.coalesce(F.try_variant_get(detail, f"$.{name}.points", "bigint"), F.try_variant_get(detail, f"$.{name}", "bigint"))


def criteria_sum(detail: Column) -> Column:
    """Weighted points; a venue counts one point at most; null without any."""
    got = {n: points(detail, n) for n in (*WEIGHTS, TRADITION, "lieu")}
    any_ = F.coalesce(*got.values()).isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = zero(got[TRADITION]) + F.least(zero(got["lieu"]), F.lit(VENUE_CAP))
    for n, w in WEIGHTS.items():
        total = total + w * zero(got[n])
    return F.when(any_, total)


def window_bonus(days: Column, tail: bool) -> Column:
    """Points for an end that is near: 3 to 7 days, 2 to 21, 1 to 45, with a tail falling to 0 at the horizon."""
    out = None
    for most, bonus in WINDOWS:
        out = F.when(days <= most, F.lit(float(bonus))) if out is None else out.when(days <= most, F.lit(float(bonus)))
    last = WINDOWS[-1][0]
    if tail:
        out = out.when(days <= HORIZON, 1 - (days - last) / F.lit(float(HORIZON - last)))
    return out.otherwise(F.lit(0.0))


def trip_urgency(base: Column, start: Column, end: Column, as_of: Column, cancelled: Column | None = None) -> Column:
    """Rank of a trip on a day: null if cancelled, below the floor, over, or further ahead than the horizon; half-even.

    An undated row keeps its base. One that begins and ends within four days, or has no end, counts one more.
    """
    last, first = F.coalesce(end, start), F.coalesce(start, end)
    days_end, days_start = F.datediff(last, as_of), F.datediff(first, as_of)
    short = start.isNotNull() & (end.isNull() | (F.datediff(end, start) <= PUNCTUAL))
    rank = F.bround(base + window_bonus(days_end, True) + F.when(short, 1).otherwise(0)).cast("long")
    no = F.coalesce(cancelled, F.lit(False)) if cancelled is not None else F.lit(False)
    out = F.when(no | base.isNull() | (base < FLOOR), None).when(last.isNull(), base.cast("long"))
    return out.when((days_end < 0) | (start.isNotNull() & (days_start > HORIZON)), None).otherwise(rank)


def trip_state(base: Column, start: Column, end: Column, as_of: Column, cancelled: Column | None = None) -> Column:
    """struct(score, motif): trip_urgency with the reason why it is null; "shown" where it is not."""
    last, first = F.coalesce(end, start), F.coalesce(start, end)
    no = F.coalesce(cancelled, F.lit(False)) if cancelled is not None else F.lit(False)
    motif = F.when(no, "cancelled").when(base.isNull(), "not scored").when(base < FLOOR, "below the floor").when(last.isNull(), "shown")
    motif = motif.when(F.datediff(last, as_of) < 0, "over").when(start.isNotNull() & (F.datediff(first, as_of) > HORIZON), "too far ahead").otherwise("shown")
    return F.struct(trip_urgency(base, start, end, as_of, cancelled).alias("score"), motif.alias("motif"))


def reasons(detail: Column, least: int) -> Column:
    """"criterion: points" of a map's criteria with least points and more, by name."""
    entries = F.filter(F.array_sort(F.map_entries(detail)), lambda e: e["value"] >= least)
    return F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")))


def language_access(text: Column, signs: list[tuple[str, int]]) -> Column:
    """Points of the first sign (pattern, points) that stands in the text as whole words, case aside; 0 for none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(whole(pattern)), F.lit(points)) for pattern, points in signs], F.lit(0))


def front_page(row: dict[str, Column], as_of: Column) -> Column:
    """struct(score, reason): the first gate that fails names the reason and leaves the score null.

    row: cancelled, enriched, has_image, render, interest, start and end. An end without a start opens at once.
    """
    last = F.coalesce(row["end"], row["start"])
    opening = F.when(last.isNotNull() & row["start"].isNull(), F.lit(0)).otherwise(F.datediff(row["start"], as_of))
    closing = F.datediff(last, as_of)
    soon = F.coalesce(opening.between(0, SOON), F.lit(False)) | (closing <= SOON)
    short = row["start"].isNotNull() & (row["end"].isNull() | (F.datediff(row["end"], row["start"]) <= PUNCTUAL))
    gates = [
        ("cancelled", F.coalesce(row["cancelled"], F.lit(False))), ("not enriched", ~F.coalesce(row["enriched"], F.lit(False))), ("no image", ~F.coalesce(row["has_image"], F.lit(False))),
        ("not measured", row["render"].isNull()), ("poor render", row["render"] < RENDER_FLOOR), ("no interest", row["interest"].isNull()), ("low interest", row["interest"] < INTEREST_FLOOR),
        ("over", last.isNotNull() & (closing < 0)), ("not now", last.isNotNull() & ~soon),
    ]
    reason = F.coalesce(*[F.when(test, F.lit(name)) for name, test in gates])
    score = F.when(last.isNull(), row["interest"].cast("double")).otherwise(row["interest"] + window_bonus(closing, False) + F.when(short, 1).otherwise(0))
    return F.struct(F.when(reason.isNull(), score).alias("score"), F.coalesce(reason, F.lit("shown")).alias("reason"))


def render_score(panel: Column, official: Column, posters: Column) -> Column:
    """0 to 10 from the panel (of 5), official pages and posters: 1.5 for two, 0.75 for one; null where the panel is."""
    extra = F.when(posters >= 2, 1.5).when((posters == 1) | official, 0.75).otherwise(0.0)
    return F.bround(F.least(F.lit(10.0), panel / 5 * 6 + F.when(official, 2.5).otherwise(0.0) + extra), 1)


def richness(has_image: Column, description: Column, fields: list[Column], aggregator: Column) -> Column:
    full = [F.when(F.coalesce(F.trim(f.cast("string")), F.lit("")) != "", 5).otherwise(0) for f in fields]
    base = F.when(has_image, 25).otherwise(0) + F.floor(F.least(F.length(F.coalesce(description, F.lit(""))), F.lit(2000)) / 50) + F.when(aggregator, 0).otherwise(15)
    for f in full:
        base = base + f
    return base.cast("long")


def temporal_bucket(start: Column, end: Column, first: Column, last: Column) -> Column:
    """opens, last_chance or continues in a window of days; null for rows that begin behind it."""
    return F.when(start.between(first, last), "opens").when((start < first) & end.between(first, last), "last_chance").when(start < first, "continues")


def in_season(day: Column, first: str, last: str) -> Column:
    """Whether a day lies in a window of MM-dd, which may wrap the New Year; the year does not matter."""
    d = F.date_format(day, "MM-dd")
    return d.between(first, last) if first <= last else (d >= first) | (d <= last)


def cost(tokens_in: Column, tokens_out: Column, model: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Money for tokens at the model's price per million, to five places; null for unknown models."""
    table = F.create_map(*[x for m, (a, b) in prices.items() for x in (F.lit(m), F.struct(F.lit(a).alias("i"), F.lit(b).alias("o")))])
    price = F.try_element_at(table, model)
    return F.round((tokens_in * price["i"] + tokens_out * price["o"]) / 1e6, 5)


def season(day: Column) -> Column:
    month = F.month(day)
    return F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").otherwise("autumn")


def period_bounds(as_of, preset: str):
    """First and last day of weekend (Friday to Sunday), next (the weekend after), 7d and month, from a Python date."""
    from datetime import timedelta

    friday = as_of + timedelta(days=(4 - as_of.weekday()) % 7 if as_of.weekday() < 5 else 4 - as_of.weekday())
    if preset == "weekend":
        return friday, friday + timedelta(days=2)
    if preset == "next":
        return friday + timedelta(days=7), friday + timedelta(days=9)
    if preset == "7d":
        return as_of, as_of + timedelta(days=7)
    if preset == "month":
        nxt = as_of.replace(day=28) + timedelta(days=4)
        return as_of.replace(day=1), nxt - timedelta(days=nxt.day)
    raise ValueError(f"unknown period {preset}")
