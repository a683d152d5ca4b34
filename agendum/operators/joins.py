"""Joins of the catalogue: bands, windows of time, reconciliation, inheritance and fuzzy titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agendum.functions.text import let

#: Rows of a side that may be sent to every task.
SMALL = 10_000


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """df marked for broadcast if it has at most limit rows; else Spark chooses."""
    return F.broadcast(df) if len(df.limit(limit + 1).take(limit + 1)) <= limit else df


def overlap_windows(df: DataFrame, start: str, end: str, windows: DataFrame) -> DataFrame:
    """Rows with each window (window, first, last) that their closed interval meets; windows are few."""
    w = small(windows)
    return df.join(w, (F.col(start) <= F.col("last")) & (F.col(end) >= F.col("first")))


def band(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, low: int, high: int) -> DataFrame:
    """Pairs of equal keys whose days differ by low to high: right_day is cut into bands of high days and each left row
    asks for the two or three it can reach, so that a key with many rows is spread over its bands."""
    width = max(1, high - low + 1)
    slot = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / width)
    a = left.withColumn("band_slot", F.explode(F.sequence(slot(F.date_add(F.col(left_day).cast("date"), low)), slot(F.date_add(F.col(left_day).cast("date"), high)))))
    b = right.withColumn("band_slot", slot(F.col(right_day).cast("date")))
    gap = F.datediff(F.col(right_day), F.col(left_day))
    return a.join(b, [*keys, "band_slot"]).filter(gap.between(low, high)).drop("band_slot")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key of either side once, with where it stands: both, left_only or right_only."""
    a = left.select(key).distinct().withColumn("in_left", F.lit(True))
    b = right.select(key).distinct().withColumn("in_right", F.lit(True))
    side = F.when(F.col("in_left") & F.col("in_right"), "both").when(F.col("in_left"), "left_only").otherwise("right_only")
    return a.join(b, key, "full").select(key, side.alias("side"))


def inherit(df: DataFrame, key: str, parent: str, columns: list[str]) -> DataFrame:
    """Empty columns of a row take its parent's value."""
    up = df.select(F.col(key).alias("parent_key"), *[F.col(c).alias(f"parent_{c}") for c in columns])
    out = df.join(up, F.col(parent) == F.col("parent_key"), "left")
    value = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"parent_{c}"))
    return out.withColumns({c: value(c) for c in columns}).select(*df.columns)


def reverse_pairs(df: DataFrame, source: str, target: str) -> DataFrame:
    """Pairs that point at each other, the smaller first."""
    a, b = df.select(F.col(source).alias("a"), F.col(target).alias("b")), df.select(F.col(source).alias("b"), F.col(target).alias("a"))
    return a.join(b, ["a", "b"], "left_semi").filter("a < b").distinct()


def with_relatives(df: DataFrame, ids: DataFrame, key: str, parent: str) -> DataFrame:
    """The ids, their children, their parents and their siblings."""
    family = df.select(F.col(key).alias("id"), F.coalesce(F.nullif(F.col(parent), F.lit(0)), F.col(key)).alias("family"))
    wanted = family.join(ids.select(F.col(key).alias("id")), "id", "left_semi").select("family").distinct()
    return family.join(wanted, "family", "left_semi").select(F.col("id").alias(key))


def longest_name_in(df: DataFrame, text: Column, key: str, names: DataFrame, name: str) -> DataFrame:
    """For each key the longest of the names that stand in its text as whole words.

    Texts become runs of as many words as some name has and join by equality, so no text meets every name.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    gaz = names.select(F.col(name).alias("found_name"), plain(F.col(name)).alias("run")).filter("run <> ''").distinct()
    sizes = [r[0] for r in gaz.select(F.size(F.split("run", " "))).distinct().collect()]  # a few numbers
    heads = [r[0] for r in gaz.select(F.substring_index("run", " ", 1)).distinct().limit(1001).collect()]
    runs_at = lambda w, i: F.array(*[F.when(i + n <= F.size(w), F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])) for n in sizes])

    def runs(w: Column) -> Column:
        """The runs from every word on; where names begin with a thousand words at most, from these words on only."""
        places = F.transform(w, lambda x, i: F.when(x.isin(*heads), i) if len(heads) <= 1000 else i)
        return F.array_distinct(F.flatten(F.transform(F.filter(places, lambda i: i.isNotNull()), lambda i: runs_at(w, i))))

    found = df.select(F.col(key), F.explode(let(F.split(plain(text), " "), runs)).alias("run")).filter("run is not null")
    return found.join(small(gaz), "run").groupBy(key).agg(F.max_by("found_name", F.struct(F.length("found_name"), "found_name")).alias("found_name"))


def containing(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item: str, run: int = 8, block: int = 1000) -> DataFrame:
    """Rows key, item_key of each text that holds an item's whole text, blanks and all; empty and null items hold nowhere.

    An item's inner words stand whole in any text that holds it, so texts and items meet by hashes of up to run of them,
    and only ids travel; the text is looked at where they meet. Items without an inner word, a stated set of very short
    ones, are looked for in every text, block by block.
    """
    words = lambda c: F.split(c, r"\s+")
    asked = items.filter(F.col(item) != "").select(F.col(item_key).alias("item_key"), F.col(item).alias("item"), words(F.col(item)).alias("w"))
    asked = asked.withColumn("n", F.least(F.lit(run), F.size("w") - 2)).withColumn("w", F.transform("w", lambda x: F.xxhash64(x)))
    sizes = sorted(r[0] for r in asked.select("n").distinct().collect())  # run numbers at most
    pick = lambda w, i, n: F.xxhash64(F.lit(n), *[F.get(w, i + k) for k in range(n)])
    long = None
    for n in [n for n in sizes if n > 0]:
        part = asked.filter(F.col("n") == n).select("item_key", pick(F.col("w"), F.lit(1), n).alias("h"))
        long = part if long is None else long.unionByName(part)
    texts = df.select(F.col(key).alias("text_key"), F.col(text).alias("text"))
    found = None
    if long is not None:
        runs = lambda w, n: F.transform(F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - (n - 1))), lambda _, i: pick(w, i, n))
        every = let(F.transform(words(F.col("text")), lambda x: F.xxhash64(x)), lambda w: F.array_distinct(F.concat(*[runs(w, n) for n in sizes if n > 0])))
        met = texts.select("text_key", F.explode(every).alias("h")).join(small(long, 100_000), "h").select("text_key", "item_key").distinct()
        both = met.join(asked.select("item_key", "item"), "item_key")
        found = texts.join(both, "text_key").filter(F.contains("text", "item")).select("text_key", "item_key")
    if sizes and sizes[0] <= 0:
        short = asked.filter("n <= 0").select("item_key", "item")
        blocks = -(-short.count() // block)
        for b in range(blocks):
            some = F.broadcast(short.filter(F.pmod(F.xxhash64("item_key"), F.lit(blocks)) == b))
            part = texts.join(some, F.contains("text", "item")).select("text_key", "item_key")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = texts.join(asked.select("item_key"), F.lit(False))
    return found.distinct().select(F.col("text_key").alias(key), F.col("item_key").alias(item_key))
