"""Published texts, images and periods: cleaning, languages of titles, spans of dates, slugs, alerts and shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agendum.functions import dates, web
from agendum.functions import text as tx
from agendum.functions.text import whole


def without_boilerplate(text: Column, patterns: list[str]) -> Column:
    """The text without lines that match a pattern; blank runs between paragraphs made single."""
    for p in patterns:
        text = F.regexp_replace(text, rf"(?im)^.*(?:{p}).*$", "")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def polished(text: Column, french: bool = True) -> Column:
    """Single blanks, none before commas and full stops, a hard one before : ; ? ! in French, three dots as one sign."""
    t = F.regexp_replace(F.replace(text, F.lit("..."), F.lit("…")), r"[ \t]+", " ")
    t = F.regexp_replace(t, r" +([,.)\]])", "$1")
    return F.trim(F.regexp_replace(t, r"[ \x{A0}]*([:;?!])(?!//)", " $1" if french else "$1"))


def bold_once(html: Column, words: list[str]) -> Column:
    """The first bare mention of each word in <strong>, unless it has one."""
    for w in words:
        html = F.when(html.rlike(rf"(?i)<strong>[^<]*{whole(w)}"), html).otherwise(F.regexp_replace(html, rf"(?is)^(.*?)({whole(w)})", "$1<strong>$2</strong>"))
    return html


def looks_untranslated(title: Column, original: Column, lang: Column) -> Column:
    """A title that equals its original but for case and signs, or in which another language leads its own by two words."""
    scores = tx.language_scores(tx.language_hits(title))
    own = F.coalesce(*[F.when(lang == n, s) for n, s in scores.items()], F.lit(0))
    other = F.greatest(*[F.when(lang == n, 0).otherwise(s) for n, s in scores.items()])
    same = (tx.folded_key(title) == tx.folded_key(original)) & (F.size(tx.words_of(title, 4)) >= 2)
    return F.coalesce(same, F.lit(False)) | (other - own >= 2)


def title_verdict(title: Column, original: Column) -> Column:
    """How a translated title stands to its original: same, kindred (half of the shorter one's words share a root) or foreign."""
    a, b = tx.words_of(title, 4), tx.words_of(original, 4)
    kin = F.size(F.filter(a, lambda x: F.exists(b, lambda y: tx.same_root(x, y))))
    return F.when(tx.folded_key(title) == tx.folded_key(original), "same").when(kin * 2 >= F.greatest(F.lit(1), F.least(F.size(a), F.size(b))), "kindred").otherwise("foreign")


def unknown_names(text: Column, known: list[str]) -> Column:
    """Capitalised words inside sentences that are not on the list, folded."""
    names = F.regexp_extract_all(text, F.lit(r"(?<=[a-zà-ÿ,;] )(\p{Lu}[\p{L}'’-]{2,})"), 1)
    return F.array_except(F.array_distinct(F.transform(names, tx.fold)), F.array(*[F.lit(k.lower()) for k in known]).cast("array<string>"))


def note_score(note: Column, title: Column, town: Column) -> Column:
    """Points of a local note for an event: 3 for its town, 1 for each shared word of five letters and more."""
    shared = F.size(F.array_intersect(tx.words_of(note, 5), tx.words_of(title, 5)))
    return F.when(F.coalesce(F.contains(tx.folded_key(note), tx.folded_key(town)), F.lit(False)), 3).otherwise(0) + shared


def all_ranges(text: Column, as_of: Column) -> Column:
    """array of struct(start, end) of every range of days that the text names, in the order of their patterns."""
    t = tx.fold(text)
    found = F.concat(F.regexp_extract_all(t, F.lit(dates.SAME_MONTH), 0), F.regexp_extract_all(t, F.lit(dates.TWO_MONTHS), 0))
    parsed = F.filter(F.transform(found, lambda s: dates.parse_dates(s, as_of)), lambda r: (r["source"] == "plage") & r["start"].isNotNull())
    return F.array_distinct(F.transform(parsed, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))))


def lone_days(text: Column, as_of: Column) -> Column:
    """Days that the text names outside all ranges."""
    t = F.regexp_replace(F.regexp_replace(tx.fold(text), dates.SAME_MONTH, " "), dates.TWO_MONTHS, " ")
    found = F.concat(F.regexp_extract_all(t, F.lit(dates.SINGLE), 0), F.regexp_extract_all(t, F.lit(dates.NUMERIC), 0), F.regexp_extract_all(t, F.lit(dates.ISO), 0))
    parsed = F.filter(F.transform(found, lambda s: dates.parse_dates(s, as_of)), lambda r: r["start"].isNotNull())
    return F.array_distinct(F.transform(parsed, lambda r: r["start"]))


def text_verdict(start: Column, end: Column, text: Column, as_of: Column) -> Column:
    """Stored dates against those of a text: confirmed, bound (one end agrees), year (only the years differ), contradicted or silent."""
    end = F.coalesce(end, start)
    return tx.let(dates.parse_dates(text, as_of), lambda got: _against(got, start, end))


def _against(got: Column, start: Column, end: Column) -> Column:
    a, b = got["start"], got["end"]
    same_day = lambda x, y: (F.month(x) == F.month(y)) & (F.day(x) == F.day(y))
    return (
        F.when(got.isNull() | (a.isNull() & b.isNull()), "silent").when((F.coalesce(a, start) == start) & (b == end), "confirmed").when((a == start) | (b == end), "bound")
        .when(same_day(F.coalesce(a, start), start) & same_day(b, end), "year").otherwise("contradicted")
    )


def year_in(text: Column, start: Column) -> Column:
    """What a source says of the year: named, other (another year only) or none."""
    years = F.regexp_extract_all(text, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), 1)
    return F.when(F.array_contains(years, F.year(start).cast("string")), "named").when(F.size(years) > 0, "other").otherwise("none")


def slug_without_date(slug: Column) -> Column:
    """The slug without a trailing date, month with a year, or year."""
    months = "|".join(dates.MONTHS)
    return F.regexp_replace(slug, rf"-(?:\d{{1,2}}-)?(?:(?:{months})-)?(?:19|20)\d{{2}}(?:-\d{{2}}-\d{{2}})?$", "")


def twin_slug(slug: Column, lang: Column) -> Column:
    """The slug that a twin in another language may take: its own with the language behind it, once."""
    return F.concat(F.regexp_replace(slug, r"-(?:fr|it|en|de|es)$", ""), F.lit("-"), lang)


def period_marks(start: Column, end: Column, created: Column, as_of: Column, soon: int = 7, fresh: int = 7) -> dict[str, Column]:
    """ending: the last day is near; republish: begun, and on for longer than that; new: found a short while ago."""
    left = F.datediff(F.coalesce(end, start), as_of)
    no = F.lit(False)
    return {
        "ending": F.coalesce(left.between(0, soon), no), "republish": F.coalesce((start < as_of) & (left > soon), no), "is_new": F.coalesce(F.datediff(as_of, created).between(0, fresh), no),
    }


def key_values(message: Column) -> Column:
    """map of key=value lines of a message, keys folded."""
    pairs = F.filter(F.split(message, r"[\n;]"), lambda p: p.contains("="))
    entry = lambda p: F.struct(tx.fold(F.trim(F.substring_index(p, "=", 1))).alias("k"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("v"))
    last = F.transform(pairs, entry)
    keep = F.filter(last, lambda x, i: ~F.exists(F.slice(last, i + 2, F.size(last)), lambda y: y["k"] == x["k"]))  # the last of a key counts
    return F.map_from_entries(keep)


def alert_open(raised: Column, cause: Column, hours: dict[str, int], as_of: Column, default: int = 24) -> Column:
    """Whether an alert still stands: causes last so many hours."""
    ttl = F.coalesce(*[F.when(cause == c, h) for c, h in hours.items()], F.lit(default))
    return F.unix_timestamp(as_of) - F.unix_timestamp(raised) < ttl * 3600


def orientation(width: Column, height: Column) -> Column:
    """landscape, portrait or square, within a tenth; null without measures."""
    ratio = F.try_divide(width, height)
    return F.when(ratio > 1.1, "landscape").when(ratio < 1 / 1.1, "portrait").when(ratio.isNotNull(), "square")


def banner_shaped(width: Column, height: Column, most: float = 3.0) -> Column:
    return F.coalesce(F.greatest(F.try_divide(width, height), F.try_divide(height, width)) >= most, F.lit(False))


def season_note(start: Column, end: Column, as_of: Column) -> Column:
    """Points for a start or an end that is near: 2 within a week, 1 within a month, of whichever is nearer."""
    near = F.least(F.when(start >= as_of, F.datediff(start, as_of)), F.when(F.coalesce(end, start) >= as_of, F.datediff(F.coalesce(end, start), as_of)))
    return F.when(near <= 7, 2).when(near <= 31, 1).otherwise(0)


def pollution(description: Column, feeds: list[str], least: int = 120, raw: int = 200) -> Column:
    """Why a description has no substance: "feed link" (it holds an address of one of the feeds), "hollow" (raw characters and
    more of which fewer than least can be seen), or null. An empty or merely short one is neither, as nothing was written over it."""
    text = F.coalesce(description, F.lit(""))
    feed = F.lit(False)
    for f in feeds:
        feed = feed | F.contains(F.lower(text), F.lit(f.lower()))
    hollow = (F.length(text) >= raw) & (F.length(web.visible_text(text)) < least)
    return F.when(F.trim(text) == "", None).when(feed, "feed link").when(hollow, "hollow")


def accepted(cause: Column, old: Column, new: Column, new_blocked: Column, least: int = 80) -> Column:
    """Whether a description found again replaces the old one: it must show least characters, and, where the old one was polluted, more
    than that, as poor is not wrong; where the cause is "incoherent" length tells nothing, and the new one must tell of the row (new_blocked false)."""
    seen = lambda c: F.length(web.visible_text(F.coalesce(c, F.lit(""))))
    better = F.when(cause == "incoherent", ~F.coalesce(new_blocked, F.lit(False))).otherwise(seen(new) > seen(old))
    return cause.isNotNull() & (seen(new) >= least) & better
