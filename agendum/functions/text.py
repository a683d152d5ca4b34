"""Text functions of the catalogue as Column builders: folding, tokens, languages, readability, vocabulary, titles."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def whole(pattern: str) -> str:
    """The pattern where no letter, mark or digit of any script stands on either side."""
    return rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{pattern})(?![\p{{L}}\p{{M}}\p{{N}}])"


def _folding() -> tuple[str, str]:
    """Every letter of Latin-1 and the Latin extensions whose decomposition begins with an ASCII letter, and that letter."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250))]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()


def fold(c: Column) -> Column:
    """Lower case without accents, combining marks dropped; ligatures opened."""
    out = F.regexp_replace(F.lower(F.translate(c, ACCENTED, PLAIN)), "[\\u0300-\\u036f]", "")
    for a, b in (("œ", "oe"), ("æ", "ae"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def folded_key(c: Column) -> Column:
    """Folded runs of letters and digits joined by single blanks: equal for titles that differ in case, accents and signs."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def words_of(c: Column, least: int = 1) -> Column:
    return F.filter(F.split(folded_key(c), " "), lambda w: F.length(w) >= least)


#: Fixed lexicons of function words by language.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "with", "as", "at", "this", "from"],
    "de": ["der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "du", "que", "est", "pour", "qui", "dans", "sur", "par", "au"],
    "es": ["el", "la", "los", "de", "y", "que", "en", "un", "una", "por", "con", "del", "las", "para", "es", "lo", "mi"],
}


def language_hits(c: Column, lexicons: dict[str, list[str]] | None = None) -> Column:
    """A struct of each language's function words among the folded words; the text is folded once for all."""
    lexicons = lexicons or FUNCTION_WORDS
    return let(words_of(c), lambda w: F.struct(*[_hits(w, lexicon).alias(lang) for lang, lexicon in lexicons.items()]))


def language_scores(hits: Column, lexicons: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """The fields of language_hits by language."""
    return {lang: hits[lang] for lang in lexicons or FUNCTION_WORDS}


def _hits(words: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*lexicon)))


def decided_language(scores: dict[str, Column], least: int = 15, ratio: float = 2.0) -> Column:
    """The language with most hits, if there are enough and twice as many as for any other; else null."""
    best = F.greatest(*scores.values())
    total = sum(scores.values(), F.lit(0))
    names = F.array(*[F.struct(s.alias("s"), F.lit(n).alias("n")) for n, s in scores.items()])
    second = F.try_element_at(F.sort_array(names, False), F.lit(2))["s"]
    return F.when((total >= least) & (best >= second * ratio), F.element_at(F.sort_array(names, False), 1)["n"])


def language_of_event(title: dict[str, Column], description: dict[str, Column], territory_language: Column, default: str = "fr", gap: int = 2) -> Column:
    """Two languages' scores decide: the title by a gap, else three times the title plus the description, else the territory, else the larger."""
    (a, ta), (b, tb) = title.items()
    both_a, both_b = 3 * ta + description[a], 3 * tb + description[b]
    larger = F.when(both_a == both_b, default).when(both_a > both_b, a).otherwise(b)
    out = F.when(F.abs(ta - tb) >= gap, F.when(ta > tb, a).otherwise(b)).when(F.abs(both_a - both_b) >= gap, F.when(both_a > both_b, a).otherwise(b))
    return out.otherwise(F.coalesce(territory_language, larger))


def sentences(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def word_count(c: Column) -> Column:
    """Runs without white space."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+"))


def readability(c: Column, long_words: int = 20) -> dict[str, Column]:
    """Words, sentences, and sentences of more than long_words words."""
    s = sentences(c)
    return {"words": word_count(c), "sentences": F.size(s), "long_sentences": F.size(F.filter(s, lambda x: F.regexp_count(x, F.lit(r"\S+")) > long_words))}


def found_terms(c: Column, terms: list[str]) -> Column:
    """Those of the terms that stand in the text as whole words, case aside, in the order given."""
    low = F.lower(c)
    return F.array_compact(F.array(*[F.when(low.rlike(whole(t)), F.lit(t)) for t in terms]))


def excerpt(c: Column, term: str, around: int = 30) -> Column:
    """What stands around the term's first place."""
    return F.regexp_extract(c, rf"(?is).{{0,{around}}}{whole(term)}.{{0,{around}}}", 0)


def fingerprint(*columns: Column) -> Column:
    """16 hex digits that change when any of the values does."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in columns])), 1, 16)


def slug(c: Column, most: int = 80) -> Column:
    """Folded words joined by hyphens, cut at a hyphen."""
    s = F.replace(folded_key(c), F.lit(" "), F.lit("-"))
    return F.when(F.length(s) <= most, s).otherwise(F.regexp_extract(F.substring(s, 1, most + 1), r"^(.*)-", 1))


def fitted(c: Column, most: int) -> Column:
    """At most so many characters, cut at a blank."""
    t = F.trim(c)
    return F.when(F.length(t) <= most, t).otherwise(F.trim(F.regexp_extract(F.substring(t, 1, most + 1), r"(?s)^(.*)\s", 1)))


def proper_nouns(title: Column) -> Column:
    """Folded words that hold a capital behind their first letter's place or begin with one inside the title; none where most of it is capitals."""
    words = F.filter(F.regexp_extract_all(title, F.lit("([A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'’-]+)"), 1), lambda w: F.length(w) >= 2)
    loud = F.size(F.filter(words, lambda w: w == F.upper(w)))
    shouting = (F.size(words) >= 3) & (loud * 10 >= F.size(words) * 6)
    inner = F.filter(words, lambda w: w.rlike(".[A-ZÀ-ÖØ-Þ]"))
    return F.when(shouting, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(inner, fold)))


def significant(title: Column, stop: list[str], least: int = 4) -> Column:
    return F.array_distinct(F.filter(words_of(title, least), lambda w: ~w.isin(*stop))) if stop else F.array_distinct(words_of(title, least))


def same_story(a: Column, b: Column, stop: list[str] = (), places: list[str] = ()) -> Column:
    """A shared proper noun, or three shared significant words; places count for neither."""
    out = F.array(*[F.lit(p) for p in (*places, *stop)]).cast("array<string>")
    named = F.array_except(F.array_intersect(proper_nouns(a), proper_nouns(b)), out)
    shared = F.array_except(F.array_intersect(significant(a, list(stop)), significant(b, list(stop))), out)
    return (F.size(named) > 0) | (F.size(shared) >= 3)


def years_of(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(title, F.lit(whole(r"(?:19|20)\d{2}")), 0))


def years_incompatible(a: Column, b: Column) -> Column:
    return (F.size(years_of(a)) > 0) & (F.size(years_of(b)) > 0) & ~F.arrays_overlap(years_of(a), years_of(b))


def title_words(c: Column, stop: list[str] = ()) -> Column:
    """Distinct folded words of three letters and more that are no stop words."""
    words = words_of(c, 3)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*stop)) if stop else words)


def not_years(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.rlike(r"^\d{4}$"))


def same_words(x: Column, y: Column) -> Column:
    """The test of cross_language_same on the titles' words."""
    numbers = lambda t: F.filter(t, lambda w: w.rlike(r"^\d{4}$"))
    both = F.array_intersect(x, y)
    apart = (F.size(numbers(x)) > 0) & (F.size(numbers(y)) > 0) & ~F.arrays_overlap(numbers(x), numbers(y))
    return (F.size(x) >= 2) & (F.size(y) >= 2) & ~apart & (F.size(not_years(both)) >= 2) & (F.size(both) * 2 >= F.least(F.size(x), F.size(y)))


def cross_language_same(a: Column, b: Column, stop: list[str] = ()) -> Column:
    """Titles in two languages for one event: two shared words that are no years, half of the shorter title's, and no contrary years."""
    return let(F.struct(title_words(a, stop).alias("x"), title_words(b, stop).alias("y")), lambda t: same_words(t["x"], t["y"]))


def dates_incompatible(s1: Column, e1: Column, s2: Column, e2: Column, days: int = 14) -> Column:
    """Both begin on known days, the intervals do not meet, and more than so many days lie between."""
    e1, e2 = F.coalesce(e1, s1), F.coalesce(e2, s2)
    gap = F.greatest(F.datediff(s2, e1), F.datediff(s1, e2))
    return s1.isNotNull() & s2.isNotNull() & (gap > days)


def consonants(c: Column) -> Column:
    """The consonants of the folded word, c, k and q alike, repeats made single: near spellings in two languages share them."""
    return F.regexp_replace(F.regexp_replace(F.translate(fold(c), "qk", "cc"), "[^b-df-hj-np-tv-xz]", ""), r"(.)\1+", "$1")


def same_root(a: Column, b: Column) -> Column:
    """Five equal first letters, one edit apart, or the same consonants (three at least)."""
    x, y = fold(a), fold(b)
    return ((F.length(x) >= 5) & (F.substring(x, 1, 5) == F.substring(y, 1, 5))) | (F.levenshtein(x, y) <= 1) | ((F.length(consonants(a)) >= 3) & (consonants(a) == consonants(b)))


#: Fixed signs of a cancelled event, in French and Italian.
CANCELLED = r"annule(?:e|es|s)?|annulation|reporte(?:e|es|s)?|annullat[oaie]|rinviat[oaie]"


def cancelled(title: Column) -> Column:
    return fold(title).rlike(whole(CANCELLED))


def wrong_language_paragraphs(c: Column, lang: Column, margin: int = 3) -> Column:
    """Places and texts of paragraphs in which another language leads the row's own by margin hits."""
    parts = F.filter(F.transform(F.split(c, r"\n+"), lambda p, i: F.struct(i.alias("pos"), p.alias("paragraph"))), lambda x: F.trim(x["paragraph"]) != "")

    def led(x):
        scores = {n: _hits(words_of(x["paragraph"]), lex) for n, lex in FUNCTION_WORDS.items()}
        own = F.coalesce(*[F.when(lang == n, s) for n, s in scores.items()], F.lit(0))
        other = F.greatest(*[F.when(lang == n, F.lit(0)).otherwise(s) for n, s in scores.items()])
        return other - own >= margin

    return F.filter(parts, led)
