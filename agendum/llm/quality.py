"""Quality rules: text statistics in SQL functions, and a decision list learned from labelled ones.

Statistics, counts for learning and the learned list are DataFrame expressions; no Python runs on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agendum.llm import common

BLANKS = " \t\n\x0b\f\r"
#: Fixed sets of the base rules.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 8, 20, 30


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _sorted_repeats(windows: Column) -> Column:
    """Places of the array's values that stand in it twice or more, in order."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s: lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
    return let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, same(s)), lambda x: x["i"])))


def _repeated_words(words: Column, n: Column) -> Column:
    """Words in windows found twice or more. Window hashes are of 64 bits; only texts that hold equal ones sort them."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
    step = lambda a, x: F.struct(x.alias("last"), (a["total"] + F.least(F.lit(WINDOW), x - a["last"])).alias("total"))
    covered = lambda w: F.aggregate(_sorted_repeats(w), start, step, lambda a: a["total"])
    found = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long")))
    return F.when(n > WINDOW, found).otherwise(F.lit(0).cast("long"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines")


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds COUNTS (long) to each row: words (runs without ASCII white space), their code points, the text's SYMBOLS,
    lines with a word equal to an earlier one, words in repeated windows, distinct words, and lines with a word.

    A null text has none of all; equal rows get equal counts; columns of these names are replaced.
    """
    kept = common.without(docs, COUNTS)
    t, w = common.fresh(docs, "text_value"), common.fresh(docs, "word_list")
    lines = common.fresh(docs, "line_list")
    df = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(t))
    trimmed = F.btrim(t, F.lit(BLANKS))
    df = df.withColumns({
        w: F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")),
        lines: F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
    })
    df = df.withColumns({
        "n_words": F.size(w), "n_distinct": F.size(F.array_distinct(w)), "n_lines": F.size(lines), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "word_chars": F.length(F.translate(F.col(t), BLANKS, "")), "n_symbols": F.length(t) - F.length(F.translate(F.col(t), SYMBOLS, "")),
    })
    df = df.withColumn("n_repeat_words", _repeated_words(F.col(w), F.col("n_words")))
    # A generated row: filters on counts stay behind it, else Spark would work the counts out again in a filter on the texts.
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(F.array(F.struct(*[F.col(c).cast("long").alias(c) for c in COUNTS]))))


#: What rules look at, as expressions over COUNTS; among equal tests the earlier counts, so that mere length comes last.
FEATURES = {
    "symbols_per_word": "coalesce(try_divide(n_symbols, n_words), cast(n_symbols as double))",
    "repeated_share": "coalesce(try_divide(n_repeat_words, n_words), 0D)",
    "duplicate_line_share": "coalesce(try_divide(n_dup_lines, n_lines), 0D)",
    "distinct_share": "coalesce(try_divide(n_distinct, n_words), 1D)",
    "chars_per_word": "coalesce(try_divide(word_chars, n_words), 0D)",
    "n_words": "cast(n_words as double)",
}
BASE_FAILED = f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests (feature, at_least, threshold) and its counts of bad and good rows that no earlier rule took."""

    tests: tuple[tuple[str, bool, float], ...]
    bad: int
    good: int

    def sql(self) -> str:
        return " and ".join(f"({FEATURES[f]}) {'>=' if up else '<'} {t!r}D" for f, up, t in self.tests)


def labelled_cells(docs: DataFrame, labels: DataFrame, key: str, label: str, text: str, max_labelled: int, cuts: int):
    """The labelled rows' counts by bin of every feature, fold and label, and the cut points; a bounded sample of rows.

    The sample is the max_labelled keys of labels with a 0 or 1 that hash lowest, so it is broadcast safely; where a key
    has several texts, the one with the least features stands for it, so no key outweighs others.
    """
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("label_key")).agg(F.min(label).cast("int").alias("good"))
    chosen = chosen.orderBy(F.xxhash64("label_key"), "label_key").limit(max_labelled)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("label_key"), F.col(f"`{text}`").alias("label_text")).join(F.broadcast(chosen), "label_key")
    stats = text_counts(rows, "label_text").filter(f"not ({BASE_FAILED})").select("label_key", "good", *[F.expr(e).alias(f) for f, e in FEATURES.items()])
    stats = stats.groupBy("label_key", "good").agg(F.min(F.struct(*FEATURES)).alias("least")).select("label_key", "good", "least.*")  # one row a key
    stats = common.stored(stats, "labelled")
    shares = [i / cuts for i in range(1, cuts)]
    found = stats.groupBy("good").agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES]).collect()
    points = {f: sorted({float(x) for r in found for x in r[f] or ()}) for f in FEATURES}
    between = {f: sorted({(a + b) / 2 for a, b in zip(p, p[1:])} | set(p)) for f, p in points.items()}
    bins = [sum((F.when(F.col(f) >= x, 1).otherwise(0) for x in p), F.lit(0)).alias(f) for f, p in between.items()]
    fold = (F.pmod(F.xxhash64(F.col("label_key"), F.lit(7)), F.lit(3)) == 0).alias("prune")
    cells = stats.select("good", fold, *bins).groupBy("good", "prune", *FEATURES).count().collect()  # max_labelled rows at most
    return cells, between


def learn_rules(cells, points: dict[str, list[float]], least_precision: float = 0.97, least_bad: int = 10, max_rules: int = 12, max_tests: int = 3) -> list[Rule]:
    """Sequential covering: each rule grows test by test on two thirds of the rows, is pruned on the other third, and takes its rows away.

    A test is added for its FOIL gain; the last tests go while that does not lower the precision on the other third. A
    rule counts if it takes least_bad bad rows and reaches least_precision on both parts together; else the list ends.
    """
    from math import log2

    names, rules = list(FEATURES), []
    left = [(c["prune"], c["good"], tuple(c[f] for f in names), c["count"]) for c in cells]
    holds = lambda bins, tests: all((bins[f] >= b) == up for f, up, b in tests)

    def counts(rows, tests):
        bad = good = 0
        for _, y, bins, n in rows:
            if holds(bins, tests):
                bad, good = bad + n * (1 - y), good + n * y
        return bad, good

    while len(rules) < max_rules:
        grow, prune = [r for r in left if not r[0]], [r for r in left if r[0]]
        tests: list[tuple[int, bool, int]] = []
        covered = grow
        while len(tests) < max_tests:
            p0, n0 = counts(covered, [])
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f, name in enumerate(names):
                bad, good = [0] * (len(points[name]) + 2), [0] * (len(points[name]) + 2)
                for _, y, bins, n in covered:
                    (good if y else bad)[bins[f]] += n
                p = n_ = 0
                for b in range(len(points[name]), 0, -1):  # bins from b up
                    p, n_ = p + bad[b], n_ + good[b]
                    for up, x, y in ((True, p, n_), (False, p0 - p, n0 - n_)):
                        gain = x * (log2(x / (x + y)) - log2(p0 / (p0 + n0))) if x else 0.0
                        same = best[1] is not None and best[1][:2] == (f, up)
                        if gain > best[0] + (-1e-9 if same else 1e-9):  # of equal cuts the lowest: the middle of a gap
                            best = gain, (f, up, b)
            if best[1] is None:
                break
            tests.append(best[1])
            covered = [r for r in covered if holds(r[2], [best[1]])]
        precision = lambda ts: (lambda p, n: (p + 1) / (p + n + 2))(*counts(prune, ts))
        while len(tests) > 1 and precision(tests[:-1]) >= precision(tests):
            tests.pop()
        bad, good = counts(left, tests)
        if not tests or bad < least_bad or bad < least_precision * (bad + good):
            break
        rules.append(Rule(tuple((names[f], up, points[names[f]][b - 1]) for f, up, b in tests), bad, good))
        left = [r for r in left if not holds(r[2], tests)]
    return rules


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that holds (from 1), or 0, as an ordered conditional expression over COUNTS."""
    out = None
    for n, rule in enumerate(rules, 1):
        test = F.expr(rule.sql())
        out = F.when(test, n) if out is None else out.when(test, n)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    max_labelled: int = 20_000, cuts: int = 24, **options,
) -> DataFrame:
    """Adds COUNTS, base_failed, rule (number of the learned rule that took the row, 0: none) and kept to each row.

    Rows that the base rules fail are not kept, nor those that a rule of the decision list takes; the list is learned
    from max_labelled labelled rows at most (label 1: good, 0: bad; nulls and other values take no part; the lower
    label counts where a key has two). Null and empty texts fail; without labels the list is empty. Repeated rows are
    judged alike; columns of the added names are replaced.
    """
    rules = learn_rules(*labelled_cells(docs, labels, key, label, text, max_labelled, cuts), **options)
    kept = common.without(docs, [*COUNTS, "base_failed", "rule", "kept"])
    out = text_counts(docs.select(*[F.col(f"`{c}`") for c in kept]), text)
    out = out.withColumns({"base_failed": F.expr(BASE_FAILED), "rule": decision(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
