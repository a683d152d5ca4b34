"""Substring dedup with difference-cover anchors.

A window of L words that stands in two places shares an anchor: of the positions modulo the period v, the cover
D holds a pair for every difference, so within the first v words of both copies there is an offset that falls on
a cover position in both. Anchors are the hashes of L - v + 1 words at cover positions only. A match extends an
anchor: wherever one stands in two places, the windows that it may belong to are hashed whole and counted, which
tells how far the match reaches on either side. No pairs are made, so a passage in very many documents costs its
length in each.

Hashes are counted with partial sums in each task, and places are joined with those that stand twice. Before the join a
task merges the equal hashes of half a million places into one row, so the commonest passage of a corpus sends one row
for each half million words of it, and the join's sort-merge plan lets AQE split what is left of a hot hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agendum.llm import common
from agendum.llm.wordhash import Words, mix

#: Perfect difference sets: every difference modulo the period comes from one pair.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}


def text_key(text: Column) -> list[Column]:
    """96 bits that stand for a text; equal texts have equal answers, so they share a key."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


def _rows(hashes: list[np.ndarray], k1: np.ndarray, k2: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Places with their hashes, the first of each hash with n, how often it stands here. Its further places are known to
    be shared: they go in one row for each text, with n = 0, in more, under a hash of the text's key."""
    order = np.lexsort(hashes[::-1])
    hashes, k1, k2, pos = [h[order] for h in hashes], k1[order], k2[order], pos[order]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([h[1:] != h[:-1] for h in hashes], axis=0)
    first, rest = np.flatnonzero(new), np.flatnonzero(~new)
    n = np.diff(np.append(first, len(order))).astype(np.int32)
    rest = rest[np.lexsort((pos[rest], k2[rest], k1[rest]))]
    text = np.ones(len(rest), bool)  # whether a text begins there, and whether a place does
    text[1:] = (k1[rest][1:] != k1[rest][:-1]) | (k2[rest][1:] != k2[rest][:-1])
    place = text.copy()
    place[1:] |= pos[rest][1:] != pos[rest][:-1]
    rest, text = rest[place], text[place]
    heads = rest[text]
    lists = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(text), len(rest)).astype(np.int32)), pa.array(pos[rest]))
    more = pa.concat_arrays([pa.nulls(len(first), lists.type), lists])
    both = np.concatenate([first, heads])
    own = [mix(k1[heads].view(np.uint64))] + [np.zeros(len(heads), np.uint64)] * (len(hashes) - 1)
    columns = [pa.array(np.concatenate([h[first], o]).view(np.int64)) for h, o in zip(hashes, own, strict=True)]
    columns += [pa.array(np.concatenate([n, np.zeros(len(heads), np.int32)])), pa.array(k1[both]), pa.array(k2[both]), pa.array(pos[both]), more]
    return pa.RecordBatch.from_arrays(columns, names=[*(f"h{i}" for i in range(len(hashes))), "n", "k1", "k2", "pos", "more"])


def _combined(found, rows: int = 500_000):
    """Rows of about so many places at a time; found: tuples of hashes, k1, k2 and places."""
    held, size = [], 0
    for part in found:
        held.append(part)
        size += len(part[0])
        if size >= rows:
            *hashes, k1, k2, pos = map(np.concatenate, zip(*held, strict=True))
            yield _rows(hashes, k1, k2, pos)
            held, size = [], 0
    if held:
        *hashes, k1, k2, pos = map(np.concatenate, zip(*held, strict=True))
        yield _rows(hashes, k1, k2, pos)


def _shared(places: DataFrame, name: str) -> DataFrame:
    """For each text key the sorted places whose hash stands in another place too."""
    hashes = [c for c in places.columns if c[0] == "h"]
    with common.scope():
        often = places.filter("n > 0").groupBy(*hashes).agg(F.sum("n").alias("often")).filter("often > 1")
        often = common.stored(often.select(*hashes, F.lit(True).alias("twice")), "often")
        found = places.join(often.hint("merge"), hashes, "left").filter("n = 0 or twice")
        found = found.select("k1", "k2", F.explode(F.coalesce("more", F.array("pos"))).alias("pos"))
        return common.keep(common.stored(found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("places")), name))


def _flat(words: Words, places: list, before: int, after: int, last: np.ndarray) -> np.ndarray:
    """A mark on each word from before words ahead of a place to after words behind it, within the text and up to its last."""
    change = np.zeros(len(words.hash) + 1, np.int64)
    sizes = [0 if p is None else len(p) for p in places]
    if sum(sizes):
        text = np.repeat(np.arange(len(sizes)), sizes)
        at = np.concatenate([np.asarray(p, np.int64) for p, n in zip(places, sizes, strict=True) if n])
        a, b = np.maximum(at - before, 0), np.minimum(at + after, last[text]) + 1
        ok = a < b
        np.add.at(change, (words.first[text] + a)[ok], 1)
        np.add.at(change, (words.first[text] + b)[ok], -1)
    return np.cumsum(change[:-1]) > 0


def shared_windows(docs: DataFrame, text: str, width: int, period: int) -> tuple[DataFrame, DataFrame]:
    """The rows with keys k1, k2 and anchor places (null: none), and the starts of the shared windows of each text key."""
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True
    short = width - period + 1

    def anchors(batches):
        def found():
            for batch in batches:
                k1, k2, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
                for a, b in common.slices(texts):
                    words = Words(texts[a:b])
                    of, pos = words.positions()
                    at = np.flatnonzero(cover[pos % period] & (pos + short <= words.counts()[of]) & (words.counts()[of] >= width))
                    yield words.runs(at, short), k1[of[at] + a], k2[of[at] + a], pos[at].astype(np.int32)

        yield from _combined(found())

    def windows(batches):
        def found():
            for batch in batches:
                k1, k2, texts, places = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
                for a, b in common.slices(texts):
                    words = Words(texts[a:b])
                    at = np.flatnonzero(_flat(words, places[a:b], period - 1, 0, words.counts() - width))
                    of, pos = words.positions()
                    yield words.runs(at, width), words.runs(at, width, 1), k1[of[at] + a], k2[of[at] + a], pos[at].astype(np.int32)

        yield from _combined(found())

    rest = "n int, k1 long, k2 int, pos int, more array<int>"
    keyed = docs.select("k1", "k2", F.col(f"`{text}`").alias("t"))
    with common.scope():
        hits = _shared(keyed.mapInArrow(anchors, f"h0 long, {rest}"), "anchors")
        marked = common.keep(common.stored(docs.join(hits.hint("merge"), ["k1", "k2"], "left"), "marked"))
    near = marked.filter("places is not null").select("k1", "k2", F.col(f"`{text}`").alias("t"), "places")
    return marked, _shared(near.mapInArrow(windows, f"h0 long, h1 long, {rest}"), "windows")


def remove_repeats(docs: DataFrame, text: str = "text", width: int = 35, period: int = 21) -> DataFrame:
    """Replaces text by the words that no shared window covers, joined by one blank; adds n_words and n_removed.

    Words are runs without ASCII white space, taken unchanged. A window is width consecutive words of one row; it
    is shared if its word sequence starts at any other place of any row, the same row included. Windows are judged
    on the input. A null text has no words and becomes the empty text; texts shorter than a window keep all words;
    repeated rows share all their windows; columns named n_words and n_removed are replaced; an empty table stays
    empty. Row order is not kept. A window stands as 128 bits (two independent hashes), a text as 96. A text is worked
    on whole, in about 30 times its bytes of memory.
    """
    spark = docs.sparkSession
    common.ship(spark)
    kept = [c for c in common.without(docs, ["n_words", "n_removed"])]
    own = [f"c{i}" for i in range(len(kept))]  # no name can clash with the keys
    keys = text_key(F.col(f"`{text}`").cast("string"))
    keyed = docs.select(*keys, *[(F.col(f"`{c}`").cast("string") if c == text else F.col(f"`{c}`")).alias(o) for c, o in zip(kept, own, strict=True)])
    at = own[kept.index(text)]
    marked, starts = shared_windows(keyed, at, width, period)
    starts = starts.select("k1", "k2", F.col("places").alias("starts"))
    touched = marked.filter("places is not null").drop("places").join(starts.hint("merge"), ["k1", "k2"], "left")
    rest = marked.filter("places is null").drop("places").withColumn("starts", F.lit(None).cast("array<int>"))
    rows = touched.unionByName(rest).select(*own, "starts")
    schema = rows.drop("starts").withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    column = own.index(at)

    def cut(batches):
        for batch in batches:
            texts, places = batch.column(column).to_pylist(), batch.column(len(own)).to_pylist()
            out, n_words, n_removed = [], [], []
            for a, b in common.slices(texts):
                words = Words(texts[a:b])
                gone = _flat(words, places[a:b], 0, width - 1, words.counts() - 1)
                n_words.append(words.counts())
                n_removed.append(np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first]))
                out += [words.text(i, ~gone[words.first[i] : words.first[i + 1]]) for i in range(b - a)]
            columns = [pa.array(out, pa.string()) if i == column else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([np.zeros(0, np.int64), *n_words])), pa.array(np.concatenate([np.zeros(0, np.int64), *n_removed]))], names=[*own, "n_words", "n_removed"])

    out = rows.mapInArrow(cut, schema)
    return out.select(*[F.col(o).alias(c) for c, o in zip(kept, own, strict=True)], "n_words", "n_removed")
