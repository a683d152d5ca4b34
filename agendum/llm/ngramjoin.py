"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of word shingles; texts with equal sets form a class and are compared once. Classes that agree
in a band of MinHash values share a bucket and are candidates. Every class has a home, the smallest class within two
steps from bucket to bucket. Candidates of one home are compared together; those of different homes in the first
bucket that they share. Pairs are compared value by value: after each round the posterior probability (uniform prior)
that the pair reaches the threshold, given its agreements so far, decides whether it goes on. What is left is verified
on the whole sets. Large groups are dealt out in blocks and send back one row for each class with its number of links,
so no pairs are shuffled or returned, and long chains of candidates cost no more than their buckets.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agendum.llm import common
from agendum.llm.components import components
from agendum.llm.wordhash import TERMS, Words

ROUND = 16


def least_agreements(values: int, threshold: float, tolerance: float) -> list[int]:
    """For each number n of values compared: the fewest agreements with which a pair goes on.

    With m of n agreements and a uniform prior the similarity is Beta(m + 1, n - m + 1), so it reaches the threshold
    t with the probability that a Binomial(n + 1, t) variable is at most m.
    """
    out = []
    for n in range(values + 1):
        total, m = 0.0, -1
        while total < tolerance and m < n:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


class Sketcher:
    """Shingle sets and MinHash values of texts."""

    def __init__(self, width: int, values: int):
        rng = np.random.default_rng(20_240_229)
        self.width = width
        self.a = rng.integers(1 << 63, size=values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(1 << 63, size=values, dtype=np.uint64)

    def shingles(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct hashes of width terms each; of all terms in a text of fewer; none without terms."""
        out = []
        for a, b in common.slices(texts):
            words = Words(texts[a:b], TERMS, lower=True)
            n = words.counts()
            of, pos = words.positions()
            at = np.flatnonzero((pos + self.width <= n[of]))
            runs, ends = words.runs(at, self.width), np.searchsorted(at, words.first)
            for i in range(b - a):
                if 0 < n[i] < self.width:
                    out.append(words.runs(words.first[i : i + 1], int(n[i])))
                else:
                    out.append(np.unique(runs[ends[i] : ends[i + 1]]))
        return out

    def values(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max)
        for i in range(0, len(shingles), 2048):
            part = shingles[i : i + 2048]
            for j in range(0, len(self.a), 32):
                hashed = np.multiply.outer(self.a[j : j + 32], part)
                hashed += self.b[j : j + 32, None]
                np.minimum(least[j : j + 32], hashed.min(1), out=least[j : j + 32])
        return (least >> np.uint64(40)).astype("<u2")  # 16 bits of each value


def similar_pairs(sets: list[np.ndarray], values: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, least: list[int], wanted=None):
    """Index pairs (i of left, j of right, i < j in number if both are in left) with Jaccard similarity of threshold at least, in parts; wanted tells which of them count."""
    sizes = np.array([len(s) for s in sets])
    same = left is right
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    has = np.zeros(int(ids.max()) + 1, bool)
    step = max(1, 2_000_000 // max(1, len(right)) // ROUND)
    for k in range(0, len(left), step):
        rows = left[k : k + step]
        agree = (values[rows][:, None, :ROUND] == values[right][None, :, :ROUND]).sum(2)
        keep = agree >= least[ROUND]
        if same:
            keep &= right[None, :] > rows[:, None]
        i, j = np.nonzero(keep)
        m = agree[i, j]
        i, j = rows[i], right[j]
        for n in range(ROUND, values.shape[1], ROUND):
            m = m + (values[i, n : n + ROUND] == values[j, n : n + ROUND]).sum(1)
            ok = m >= least[n + ROUND]
            i, j, m = i[ok], j[ok], m[ok]
        if wanted is not None:
            ok = wanted(i, j)
            i, j = i[ok], j[ok]
        # What is left of each row is verified on whole sets.
        for row in np.unique(i):
            others = j[i == row]
            mine = ids[bounds[row] : bounds[row + 1]]
            has[mine] = True
            flat = np.concatenate([has[ids[bounds[o] : bounds[o + 1]]] for o in others])
            common_ = np.add.reduceat(flat.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[others])[:-1]]))
            has[mine] = False
            hit = common_ >= threshold * (sizes[row] + sizes[others] - common_) - 1e-9
            if hit.any():
                yield int(row), others[hit]


def link_counts(group: pd.DataFrame, sketch: Sketcher, threshold: float, least: list[int], rows_: int) -> pd.DataFrame:
    """For each class of some groups of classes its links (copies counted) to the classes it meets there, and the smallest class it hangs on.

    A group with a band of -1 is a home; others are buckets of a band of rows_ values, where pairs count if their homes
    differ and no earlier band brings them together.
    """
    out = []
    for (band, _), rows in group.groupby(["band", "grp"], sort=False):
        rows = rows.sort_values("class")
        rows = rows.reset_index(drop=True)
        sets = sketch.shingles(rows["text"].tolist())
        values = np.frombuffer(b"".join(rows["values"]), "<u2").reshape(len(rows), -1)
        block, low, high, home = rows["block"].to_numpy(), rows["low"].iloc[0], rows["high"].iloc[0], rows["home"].to_numpy()
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        copies, links, root = rows["copies"].to_numpy(), np.zeros(len(rows), np.int64), np.arange(len(rows))

        def first_here(i, j, values=values, band=band, home=home):
            cut = values[:, : (band + 1) * rows_]
            bands = (cut[i] == cut[j]).reshape(len(i), band + 1, rows_).all(2)
            return (home[i] != home[j]) & bands[:, band] & ~bands[:, :band].any(1)

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        if len(left) and len(right):
            for i, others in similar_pairs(sets, values, left, right, threshold, least, first_here if band >= 0 else None):
                links[i] += copies[others].sum()
                np.add.at(links, others, copies[i])
                for o in others.tolist():
                    a, b = sorted((find(i), find(o)))
                    root[b] = a
        names = rows["class"]
        hit = links > 0
        out.append(pd.DataFrame({"class": names[hit], "links": links[hit], "other": names.iloc[[find(i) for i in np.flatnonzero(hit)]].to_numpy()}))
    return pd.concat(out)


def has_terms(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")


def meetings(classes: DataFrame, count: int, bands: int, rows: int, block: int, block_chars: int) -> DataFrame:
    """Where each class is compared: rows class, home, band, grp, block, low, high, whole, weight; classes: no, values, chars.

    A group is a home (band -1), or a bucket with classes of several homes. It is cut into blocks by rows and characters,
    and a row asks for each pair of blocks (low, high) that its own block takes part in; whole groups have one block. In a
    bucket the commonest home's classes have blocks of their own, behind the others', and do not meet one another.
    """
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substr("values", i * (2 * rows) + 1, F.lit(2 * rows)))))
    buckets = classes.select(F.col("no").alias("class"), "chars", band.alias("band", "grp"))
    firsts = common.stored(buckets.groupBy("grp").agg(F.min("class").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    met = common.stored(common.join_hot(buckets, firsts, "grp", bands * count), "met")
    n_met = met.count()
    near = met.groupBy("class").agg(F.min("first").alias("near"))  # a class has as many rows as bands
    reach = met.join(near, "class").groupBy("grp").agg(F.min("near").alias("far"), F.count(F.lit(1)).alias("n"))
    homes = common.join_hot(met.select("class", "grp"), reach, "grp", n_met).groupBy("class").agg(F.min("far").alias("home"))
    met = common.stored(met.drop("first").join(homes, "class"), "met")
    parts = met.groupBy("grp", "home").agg(F.count(F.lit(1)).alias("m"), F.sum("chars").alias("chars"))
    mixed = parts.groupBy("grp").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("homes"), F.max(F.struct("m", "home", "chars")).alias("top"), F.sum("chars").alias("chars"))
    mixed = mixed.filter("homes > 1").select("grp", "n", F.col("top.home").alias("common"), (F.col("n") - F.col("top.m")).alias("few"), (F.col("chars") - F.col("top.chars")).alias("few_chars"), F.col("top.m").alias("many"), F.col("top.chars").alias("many_chars"))
    apart = common.join_hot(met, mixed, "grp", n_met).withColumn("behind", F.col("home") == F.col("common")).drop("common")
    own = met.select("class", "chars", "home").distinct()
    sizes = own.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("few_chars")).filter("n > 1").withColumns({"few": F.col("n"), "many": F.lit(0).cast("long"), "many_chars": F.lit(0).cast("long")})
    together = common.join_hot(own, sizes, "home", n_met).withColumns({"behind": F.lit(False), "band": F.lit(-1), "grp": F.col("home")})
    everyone = together.unionByName(apart)
    blocks = lambda n, chars: F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(chars) / block_chars)).cast("int")
    everyone = everyone.withColumns({"front": blocks("few", "few_chars"), "back": F.when(F.col("many") > 0, blocks("many", "many_chars")).otherwise(0)})
    place = F.pmod(F.xxhash64("class"), F.when(F.col("behind"), F.col("back")).otherwise(F.col("front"))).cast("int")
    everyone = everyone.withColumn("block", F.when(F.col("behind"), F.col("front") + place).otherwise(place))
    last = F.when(F.col("behind"), F.col("front")).otherwise(F.col("front") + F.col("back")) - 1
    everyone = everyone.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    return everyone.select(
        "class", "home", "band", "grp", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"),
        ((F.col("front") == 1) & (F.col("back") == 0)).alias("whole"), F.col("chars").alias("weight"),
    )


def similar_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 5,
    bands: int = 32, rows: int = 6, tolerance: float = 1e-6, block: int = 1024, block_chars: int = 8_000_000,
) -> DataFrame:
    """Each row's key (integers; others fail), text_key, class_id, n_links, first (whether it stands for its group) and has_terms.

    Two rows are linked if the Jaccard similarity of their sets of width-term shingles (terms: runs of a-z, 0-9 and
    characters beyond ASCII, A-Z lower-cased; shingles stand as 64-bit hashes) is threshold at least; a text of fewer
    terms has one shingle of them all. n_links counts the linked other rows, copies included; class_id is the smallest
    key of the rows connected by links, null if all are null. Rows without terms (null and empty texts too) have no links
    and their own key as class_id. Repeated rows are copies of one another. Extra columns take no part; an empty table
    gives an empty result. A text is worked on whole, in about 40 times its bytes of memory.

    A pair at similarity s becomes a candidate with probability 1 - (1 - s**rows)**bands (0.99994 at 0.8, 1 - 4e-9
    at 0.9) at least; pruning loses at most about tolerance a round.
    """
    spark = docs.sparkSession
    common.ship(spark)
    n_values = -(-bands * rows // ROUND) * ROUND
    sketch, least = Sketcher(width, n_values), least_agreements(n_values, threshold, tolerance)
    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    source = source.select("id", F.md5("text").alias("text_key"), "text")

    def sketches(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            names, values = [], []
            for s in sketch.shingles(texts):
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                values.append(sketch.values(s).tobytes() if len(s) else None)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(values, pa.binary()), sizes], names=["id", "text_key", "class", "values", "chars"])

    slim = common.stored(source.mapInArrow(sketches, "id long, text_key string, class binary, values binary, chars long"), "sketches")
    with common.scope():
        row = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("row")
        classes = slim.filter("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id"), row, F.first("values").alias("values"), F.max("chars").alias("chars"))
        classes = common.stored(classes.withColumn("no", F.monotonically_increasing_id()), "classes")  # numbers stay as they are once written
        count = classes.count()
        asked = common.stored(meetings(classes.select("no", "values", "chars"), count, bands, rows, block, block_chars), "meetings")
        size = asked.agg(F.count(F.lit(1)), F.sum("weight")).first()
        bundles = max(1, size[0] // 500, (size[1] or 0) // block_chars)  # whole groups are dealt out many together
        bundle = F.when(F.col("whole"), F.pmod(F.xxhash64("band", "grp"), F.lit(bundles))).otherwise(F.xxhash64("band", "grp"))
        deal = F.struct("home", "band", "grp", "block", "low", "high", "whole", bundle.alias("bundle"))
        deals = asked.groupBy(F.col("class").alias("no")).agg(F.collect_list(deal).alias("deals"))
        members = classes.select("no", "copies", "row", "values").join(deals, "no")
        # One row's text for each class, asked for by key and text: copies are dealt out by their keys.
        same = (F.col("text_key") == F.col("row.text_key")) & F.col("id").eqNullSafe(F.col("row.id"))
        texts = source.join(members.hint("merge"), same).dropDuplicates(["no"])
        dealt = texts.select(F.col("no").alias("class"), "copies", "values", "text", F.inline("deals"))
        counted = dealt.groupBy("whole", "bundle", "low", "high").applyInPandas(lambda g: link_counts(g, sketch, threshold, least, rows), "class long, links long, other long")
        found = common.stored(counted, "links")
        groups = components(found.select(F.col("class").alias("a"), F.col("other").alias("b")), "groups")
        linked = classes.select("class", "no", "copies", "least_id", "row")
        linked = linked.join(found.groupBy(F.col("class").alias("no")).agg(F.sum("links").alias("links")), "no", "left").join(groups.withColumnRenamed("node", "no"), "no", "left")
        linked = linked.withColumn("root", F.coalesce("root", "no"))
        # One row stands for a group: the one with the smallest key, then the smallest text key.
        roots = linked.groupBy("root").agg(F.min("least_id").alias("class_id"), F.min("row").alias("best"), F.count(F.lit(1)).alias("n"))
        linked = common.join_hot(linked, roots, "root", count)
        linked = linked.select("class", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("best.id").alias("best_id"), F.col("best.text_key").alias("best_key"), F.col("copies").alias("n"))
        linked = common.keep(common.stored(linked, "classes"))

    worded = slim.filter("class is not null").select("id", "text_key", "class")
    placed = common.join_hot(worded, linked, "class", slim.count())
    first = F.col("id").eqNullSafe(F.col("best_id")) & (F.col("text_key") == F.col("best_key"))
    placed = placed.select(F.col("id").alias(key), "text_key", "class_id", F.col("n_links").cast("long"), first.alias("first"), F.lit(True).alias("has_terms"))
    none = slim.filter("class is null").select(F.col("id").alias(key), "text_key", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"), F.lit(False).alias("has_terms"))
    return placed.unionByName(none)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each group of similar_documents; rows without terms all stay; the columns are those of docs.

    The row with the smallest key stays, null keys last, then the one with the smallest MD5 of its text; of rows equal in
    both, the one whose columns come first when written as JSON. Null and empty texts, repeated rows and empty tables are
    as there.
    """
    with common.scope():
        found = similar_documents(docs, key, text, **options)
        mark, name, rows = (common.fresh(docs, c) for c in ("text_key", "group_key", "group_rows"))
        value = F.col(f"`{text}`").cast("string")
        best = found.filter(F.col("first") & F.col("has_terms")).groupBy(F.col("text_key").alias(mark), F.col(key).alias(name)).agg(F.count(F.lit(1)).alias(rows))
        chosen = common.keep(common.stored(best, "chosen"))
    worded = docs.filter(has_terms(value)).withColumn(mark, F.md5(F.coalesce(value, F.lit(""))))
    same = (worded[mark] == chosen[mark]) & worded[key].cast("long").eqNullSafe(chosen[name])
    kept = worded.join(chosen.hint("merge"), same).drop(chosen[mark])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = kept.filter(F.col(rows) > 1).groupBy(mark, name).agg(F.min_by(whole, F.to_json(whole)).alias(rows)).select(f"`{rows}`.*")
    return kept.filter(F.col(rows) == 1).select(docs.columns).unionByName(repeated).unionByName(docs.filter(~has_terms(value)))
