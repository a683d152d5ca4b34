"""Audit of how filters interact, from one pass of signed parity sums.

Each document fails a set of filters: a cell. For every set S of filters, a part and a label add up +1 or -1 for each
document, by the parity of the filters of S that it fails; these 2**k sums are the Walsh-Hadamard transform of the cells'
counts, they add up in each task, and inverting them is exact. From the cells every order of the filters is worked
out without looking at a document again, and a filter's Shapley value in closed form: a document that fails f filters is
removed by each of them in k! / f of the k! orders.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agendum.llm import common
from agendum.llm.quality import BLANKS

#: Filters at most: k! orders and 2**k sums are made for each part.
MOST_FILTERS = 6
#: The groups of documents that are counted: all, those labelled good, those labelled toxic.
GROUPS = ("all", "good", "toxic")


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def text_failures(text: Column) -> dict[str, Column]:
    """Filters on one text, null counting as empty, as conditions under which it fails: A: under 100 words (runs without ASCII
    white space); B: 100 * distinct words < 80 * words; C: 100 * A-Z > 10 * code points; D: any of #$%&*|."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d")))[0]
    few = lambda c: F.struct((c["n"] < 100).alias("A"), (100 * c["d"] < 80 * c["n"]).alias("B"))
    both = F.transform(F.array(counts), few)[0]
    return {"A": both["A"], "B": both["B"], "C": 100 * capitals.cast("long") > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def failing_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Rows part (null: empty), good, toxic, the filters A to E and n: how many documents are alike in all these and their id.

    E fails documents whose text is identical (by sha256) to that of any smaller id, whatever happens to that one; rows that
    share the smallest id of a text pass it, rows without an id pass it and make no other fail. A document is good if any of its
    labels has quality 1, and toxic if any has toxic 1; it is neither without a label or an id. Texts are read once and not
    shuffled: their digests and ids are, merged in each task, and meet under (digest, id), so copies of one text never meet in
    a task. Repeated rows count one by one.
    """
    failures = text_failures(F.col(f"`{text}`"))
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256)).alias("digest"),
        F.inline(F.array(F.struct(*[c.alias(f) for f, c in failures.items()]))),
    )
    cells = common.stored(rows.groupBy("digest", "id", "part", *failures).agg(F.count(F.lit(1)).alias("n")), "failures")
    first = cells.groupBy("digest").agg(F.min("id").alias("id")).filter("id is not null").withColumn("first", F.lit(True))
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    cells = cells.join(first, ["digest", "id"], "left").join(marks, "id", "left")
    return cells.select("part", *failures, (F.col("id").isNotNull() & F.col("first").isNull()).alias("E"), *[(F.coalesce(c, F.lit(0)) == 1).alias(c) for c in ("good", "toxic")], "n")


def parity_sums(rows: DataFrame, filters: list[str]) -> DataFrame:
    """For each part, good and toxic the array w of 2**k signed sums: w[S] adds n for rows that fail an even number of
    the filters in S (bit i: filters[i]) and takes n away for the others. One row for each task and group is shuffled."""
    mask = _sum(F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters))
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(s)) % 2)
    sums = [F.sum(F.col("n") * sign(s)).alias(f"w{s}") for s in range(1 << len(filters))]
    summed = rows.select("part", "good", "toxic", "n", mask.alias("mask")).groupBy("part", "good", "toxic").agg(*sums)
    return summed.select("part", "good", "toxic", F.array(*[f"w{s}" for s in range(1 << len(filters))]).alias("w"))


def mask_cells(sums: DataFrame, filters: list[str]) -> DataFrame:
    """The inverse: for each part an array for each of GROUPS, whose element m is the number of documents that fail just
    the filters of m. The transform is its own inverse but for the factor 2**k, so whole numbers come out exactly."""
    size = 1 << len(filters)
    at = F.sequence(F.lit(0), F.lit(size - 1))
    chosen = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    cell = lambda w: F.transform(at, lambda m: (F.aggregate(
        F.transform(w, lambda x, s: x * (1 - 2 * (F.bit_count(s.bitwiseAND(m)) % 2))), F.lit(0).cast("long"), lambda a, x: a + x) / size).cast("long"))
    added = [F.array(*[F.sum(F.when(c, F.col("w")[s]).otherwise(0)) for s in range(size)]).alias(g) for g, c in chosen.items()]
    return sums.groupBy("part").agg(*added).select("part", *[cell(F.col(g)).alias(g) for g in GROUPS])


def order_effects(cells: DataFrame, filters: list[str]) -> DataFrame:
    """For each part every order of the filters (their names joined) and step, with counts of documents: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, and shapley, the filter's removals added up over all orders."""
    k = len(filters)
    orders = F.array(*[F.lit(",".join(o)) for o in permutations(filters)])
    rows = cells.select("part", *GROUPS, F.explode(orders).alias("names")).withColumn("names", F.split("names", ","))
    rows = rows.select("part", *GROUPS, F.array_join("names", "").alias("filter_order"), F.col("names"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bits = lambda names: _sum(F.when(F.array_contains(names, f), 1 << i).otherwise(0) for i, f in enumerate(filters))
    rows = rows.withColumns({"before": bits(F.slice("names", F.lit(1), F.col("step") - 1)), "own": bits(F.slice("names", F.col("step"), F.lit(1)))})

    def over(group, holds, times=lambda m: 1):
        """The sum over masks for which holds(mask, before, own)."""
        m, total = F.sequence(F.lit(0), F.lit((1 << k) - 1)), F.lit(0).cast("long")
        term = lambda x: F.when(holds(x, F.col("before"), F.col("own")), F.get(F.col(group), x) * times(x)).otherwise(0)
        return F.aggregate(m, total, lambda a, x: a + term(x))

    none = lambda a, b: a.bitwiseAND(b) == 0
    gone = lambda m, before, own: none(m, before) & ~none(m, own)
    share = lambda m: (F.lit(factorial(k)) / F.greatest(F.bit_count(m), F.lit(1))).cast("long")
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        over("all", lambda m, before, own: none(m, before.bitwiseOR(own))).alias("kept"),
        over("all", gone).alias("removed"),
        over("all", lambda m, before, own: ~none(m, before) & ~none(m, own)).alias("redundant"),
        F.get(F.col("all"), F.col("own")).alias("unique_fails"),
        over("good", gone).alias("good_lost"), over("toxic", gone).alias("toxic_lost"),
        over("all", lambda m, _, own: ~none(m, own), share).alias("shapley"),
    )


def audit(rows: DataFrame, filters: list[str]) -> DataFrame:
    """All orders of the filters for each part; rows: part, good, toxic, n, and for each filter a boolean that is true where
    it fails (null: passes). Empty tables give no rows; ValueError beyond MOST_FILTERS filters."""
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters can be audited, not {len(filters)}")
    return order_effects(mask_cells(parity_sums(rows, filters), filters), filters)
