"""Near duplicates by SimHash: fingerprints within a few bits of each other, found with vantage-point trees.

A vantage point splits fingerprints by their Hamming distance from it: inside a radius, or beyond. By the triangle inequality
a fingerprint within t of another on the far side lies within t of the border, so only those are sent across.
Distances on all 64 bits of unlike texts crowd around 32, where a border of 3 to either side holds over half of all. So
there is a tree for each half of the bits: two fingerprints within 3 differ in at most 1 bit of one half, and distances on
that half cross with a border of 1. Within a tree, where a half tells nothing more (copies that share it), nodes
go over to all bits and the whole distance. Every pair is verified on all bits.

The top of each tree is fitted on a bounded sample and sent to all tasks; its leaves are shards. Each fingerprint is at
home in one shard of each tree and visits the shards behind the borders that it is near to. A shard sends back a spanning forest
of the links found there, at most one row for each of its fingerprints, and no pairs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agendum.llm import common
from agendum.llm.components import components

U = np.uint64
ALL = U(0xFFFFFFFFFFFFFFFF)
#: Bytes of text whose shingles are hashed at once.
PART_BYTES = 1 << 20
SEED = 42
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of the XXH64 hashes of all shingles of width words (runs without ASCII white space, A-Z lower-cased),
    repeats included; of a shorter text's words as one shingle; 0 without words. Memory: a few times the text's bytes."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower changes A-Z only
    ones, n, held, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(data):
        blank = BLANK.search(data, at + PART_BYTES)  # a part ends at white space, so that no word is cut
        end = blank.start() if blank else len(data)
        words = held + data[at:end].split()
        at = end
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)]
        held = words[-(width - 1) :] if width > 1 else []
        if hashes:
            ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)
    if not n and held:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Rows id, fp (the fingerprint's 64 bits as a long), one for each row of docs. Texts are read and not shuffled."""
    common.ship(docs.sparkSession)

    def each(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(each, "id long, fp long")


def distance(points: np.ndarray, to, mask=ALL) -> np.ndarray:
    return np.bitwise_count((points ^ to) & mask).astype(np.int16)


@dataclass(frozen=True)
class Split:
    """A node: those within radius of point on the bits of mask are inside; t: how far linked ones lie apart there at most."""

    point: int
    mask: int
    t: int
    radius: int

    def sides(self, homes: np.ndarray, visitors: np.ndarray):
        """For inside and outside, which of the homes and which of the visitors belong there, and for outside which homes of
        the inside visit it. Homes beyond need not visit the inside: every pair is found from one end."""
        h, v = distance(homes, U(self.point), U(self.mask)), distance(visitors, U(self.point), U(self.mask))
        return (h <= self.radius, v <= self.radius + self.t), (h > self.radius, v > self.radius - self.t, (h <= self.radius) & (h > self.radius - self.t))


def find_split(points: np.ndarray, metrics: list[tuple[int, int]]) -> Split | None:
    """A split with a sixteenth of the points on either side at least, by the first of the metrics (mask, t) that makes one.
    Of five vantage points the one whose distances spread most is taken."""
    for mask, t in metrics:
        tried = []
        for v in points[np.linspace(0, len(points) - 1, 5).astype(int)]:
            d = distance(points, v, U(mask))
            values, n = np.unique(d, return_counts=True)
            below = np.cumsum(n)[:-1]  # of homes inside, for each radius but the last
            if len(below):
                i = int(np.argmin(np.abs(below - len(points) / 2)))
                if min(below[i], len(points) - below[i]) * 16 >= len(points):
                    tried.append((float(d.std()), Split(int(v), mask, t, int(values[i]))))
        if tried:
            return max(tried, key=lambda x: x[0])[1]
    return None


def fit_tree(sample: np.ndarray, shards: int, metrics: list[tuple[int, int]]) -> list:
    """A tree as a list of (Split, inside, outside) by node, or a shard's number for a leaf; node 0 is the root. The sample's
    largest leaves are split until there are so many shards or nothing can be split."""
    tree, open_, done = [None], [(len(sample), 0, sample)], []
    while open_ and len(open_) + len(done) < shards:
        open_.sort(key=lambda x: x[0])
        _, at, points = open_.pop()
        split = find_split(points, metrics) if len(points) > 1 else None
        if split is None:
            done.append(at)
            continue
        inside = distance(points, U(split.point), U(split.mask)) <= split.radius
        tree[at] = (split, len(tree), len(tree) + 1)
        open_ += [(int(inside.sum()), len(tree), points[inside]), (int((~inside).sum()), len(tree) + 1, points[~inside])]
        tree += [None, None]
    for shard, at in enumerate(sorted(done + [x[1] for x in open_])):
        tree[at] = shard
    return tree


def route(tree: list, points: np.ndarray):
    """(shard, points at home there, points that visit it), for the shards that have any."""
    todo = [(0, points, points[:0])]
    while todo:
        at, homes, visitors = todo.pop()
        if not len(homes) and not len(visitors):
            continue
        if isinstance(tree[at], int):
            yield tree[at], homes, visitors
            continue
        split, a, b = tree[at]
        (h, v), (far, w, cross) = split.sides(homes, visitors)
        todo += [(a, homes[h], visitors[v]), (b, homes[far], np.concatenate([visitors[w], homes[cross]]))]


class Forest:
    """Union of numbers 0 to n - 1 by many links at once; a root is the smallest number of its set."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, a: np.ndarray) -> np.ndarray:
        x = self.root[a]
        while ((y := self.root[x]) != x).any():
            x = y
        self.root[a] = x
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.find(a), self.find(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))


def shard_links(points: np.ndarray, own: np.ndarray, metrics: list[tuple[int, int]], most: int, leaf: int = 256) -> np.ndarray:
    """The root's number for each of the distinct points, by links within most bits between homes (own) or a home and a visitor.

    The shard's own tree is grown and walked at once, all homes and visitors of a node together. Homes within most
    of a vantage point are linked to it there; where all are, no pairs of homes are left to look at.
    """
    found = Forest(len(points))
    todo = [(np.flatnonzero(own), np.flatnonzero(~own), True)]
    while todo:
        homes, visitors, among = todo.pop()  # among: homes may be linked to homes too
        if not len(homes) or not (among or len(visitors)):
            continue
        split = find_split(points[homes], metrics) if len(homes) > leaf else None
        if split is None:
            _compare(found, points, homes, visitors, among, most)
            continue
        if among:
            near = homes[distance(points[homes], U(split.point)) <= most]
            found.link(near, np.full(len(near), near[0]))
            among = len(near) < len(homes)
        (h, v), (far, w, cross) = split.sides(points[homes], points[visitors])
        todo.append((homes[h], visitors[v], among))
        todo.append((homes[far], np.concatenate([visitors[w], homes[cross]]) if among else visitors[w], among))
    return found.find(np.arange(len(points)))


def _compare(found: Forest, points: np.ndarray, homes: np.ndarray, visitors: np.ndarray, among: bool, most: int, rows: int = 1024, columns: int = 4096) -> None:
    """Links all within most, in blocks."""
    others = np.concatenate([homes, visitors]) if among else visitors
    for i in range(0, len(homes), rows):
        a = homes[i : i + rows]
        for j in range(i if among else 0, len(others), columns):
            b = others[j : j + columns]
            x, y = np.nonzero(np.bitwise_count(points[a][:, None] ^ points[b][None, :]) <= most)
            found.link(a[x], b[y])


def links(fps: DataFrame, most: int = 3, shard_rows: int = 20_000, max_sample: int = 200_000) -> DataFrame:
    """Edges (a, b) of distinct fingerprints fp whose components are those of all pairs within most bits.

    shard_rows: fingerprints at home in a shard, about. The trees are fitted on about max_sample fingerprints, chosen by their
    hashes, or on all where there are fewer, which fixes borders and no result; as many shards are made as a sixteenth of the sample allows.
    """
    spark = fps.sparkSession
    common.ship(spark)
    n = fps.count()
    chosen = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(min(1.0, max_sample / max(1, n)) * (1 << 30))  # each task sends its share
    sample = np.array([r[0] for r in fps.filter(chosen).select("fp").collect()], np.int64).view(U)
    shards = max(1, min(max(common.parallelism(spark), -(-n // shard_rows)), len(sample) // 16))
    half = most // 2  # two halves: one of them differs in so many bits at most
    metrics = [[(mask, half), (int(ALL), most)] for mask in (0xFFFFFFFF, 0xFFFFFFFF00000000)]
    trees = spark.sparkContext.broadcast([fit_tree(np.sort(sample), shards, m) for m in metrics])

    def dealt(batches):
        def flush(held):
            points = np.concatenate(held).view(U)
            for k, tree in enumerate(trees.value):
                for shard, homes, visitors in route(tree, points):
                    both = np.concatenate([homes, visitors])
                    own = np.arange(len(both)) < len(homes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), k, np.int32)), pa.array(np.full(len(both), shard, np.int32)), pa.array(both.view(np.int64)), pa.array(own)], names=["tree", "shard", "fp", "own"])

        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            size += len(held[-1])
            if size >= 100_000:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    def joined(table: pa.Table) -> pa.Table:
        points, own = table["fp"].to_numpy(), table["own"].to_numpy()
        order = np.argsort(points)
        points, own = points[order], own[order]
        root = shard_links(points.view(U), own, metrics[table["tree"][0].as_py()], most)
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": points[at], "b": points[root[at]]})

    rows = fps.select("fp").mapInArrow(dealt, "tree int, shard int, fp long, own boolean")
    return rows.groupBy("tree", "shard").applyInArrow(joined, "a long, b long")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, most: int = 3, **options) -> DataFrame:
    """For each row of docs its id under the key's name, fingerprint (16 hex digits) and component_id: the smallest id of the
    rows that are reached by steps of at most `most` bits, itself included.

    Rows of equal fingerprints are one from the start, so copies cost nothing in the trees. Null and empty texts and those of
    white space have fingerprint zero and are linked like any other. Rows without an id take part, and have no component_id
    if no row of theirs has one; repeated rows stay rows. Empty tables give empty results.
    """
    with common.scope():
        prints = common.stored(fingerprints(docs, key, text, width), "fingerprints")
        own = common.stored(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
        roots = components(common.stored(links(own, most, **options), "links"), "simhash").withColumnRenamed("node", "fp")
        roots = common.stored(own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
        count, rows = roots.count(), prints.count()
        least = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
        linked = common.join_hot(roots.select("fp", "root", F.col("n").alias("docs")), least, "root", count)
        named = linked.select("fp", "component_id", F.col("docs").alias("n"))
        out = common.join_hot(prints, named, "fp", rows)
        out = out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
        return common.keep(common.stored(out, "components"))
