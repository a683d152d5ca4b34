"""Names of a gazetteer in texts, by one pass over each text, and texts that tell of somewhere else."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agendum.functions.text import fold, folded_key, words_of
from agendum.storage import stored

#: A run of letters and digits of any script.
WORD = re.compile(r"[^\W_]+")
#: Bits of a filter that are made in one group, characters of texts that are worked on at once, and words that a task remembers.
REGION, SLICE, VOCABULARY = 1 << 20, 500_000, 1_000_000


def folded(word: str) -> str:
    """Lower case without accents; ligatures opened."""
    if word.isascii():
        return word.lower()
    plain = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
    return plain.replace("œ", "oe").replace("æ", "ae").replace("ß", "ss")


def folded_name(name: str | None) -> str:
    return " ".join(folded(w) for w in WORD.findall(name or ""))


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class _Vocabulary(dict):
    """Numbers of words, with what they fold to, whether they begin with a capital, and their hashes, made when a word is first met."""

    def __init__(self):
        self.low, self.capital, self.hashed = [], [], array("Q")

    def __missing__(self, word: str) -> int:
        low = folded(word)
        self.low.append(low)
        self.capital.append(word[:1].isupper())
        self.hashed.append(_hash(low))
        self[word] = n = len(self)
        return n


_ODD, _WRAP = 0x9E3779B97F4A7C15, 1 << 64


def _windows(hashes: np.ndarray, lengths: list[int]):
    """For each length the hashes of all runs of so many words, by their first word."""
    n = len(hashes)
    power = lambda base: np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), base, np.uint64))]).astype(np.uint64)
    sums, back = np.concatenate([[np.uint64(0)], np.cumsum(hashes * power(_ODD)[:n], dtype=np.uint64)]).astype(np.uint64), power(pow(_ODD, -1, _WRAP))
    for size in lengths:
        if size <= n:
            yield size, (sums[size:] - sums[:-size]) * back[: n - size + 1] + np.uint64(size)


def _bits_of(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """The places of hashes in a filter of 2 ** width bits: three for each."""
    out = []
    for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93):
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(odd)
        out.append((hashes >> np.uint64(64 - width)).astype(np.int64))
    return out


def _filter(held: DataFrame, names: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of the names (folded), with 16 bits and more for each, and its width. It has 64 MB at most: of more names
    than that is made for it lets more through, and finds are held against the names anyway. It is made in regions, in tasks."""
    width = max(16, min(29, (16 * names - 1).bit_length()))

    def places(batches):
        for batch in batches:
            made = [np.empty(0, np.int64)]
            for n in batch.column(0).to_pylist():
                run = np.array([_hash(w) for w in n.split(" ")], np.uint64)
                for _, h in _windows(run, [len(run)]):
                    made += _bits_of(h, width)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made))], names=["at"])

    def region(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(REGION, np.uint8)
        bits[rows["at"].to_numpy() % REGION] = 1
        return pd.DataFrame({"region": [int(rows["at"].iloc[0]) // REGION], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    at = held.mapInArrow(places, "at long").distinct()
    out = np.zeros(max(REGION, 1 << width) // 8, np.uint8)
    for r in at.groupBy(F.expr(f"at div {REGION}")).applyInPandas(region, "region long, bits binary").toLocalIterator():
        out[r.region * REGION // 8 : (r.region + 1) * REGION // 8] = np.frombuffer(r.bits, np.uint8)
    return out, width


def _by_automaton(df: DataFrame, key: str, schema: str, held: list[str]) -> DataFrame:
    """The places of so many names as a task can hold."""
    import ahocorasick

    shared = df.sparkSession.sparkContext.broadcast(held)

    def find(batches):
        machine, words = ahocorasick.Automaton(), _Vocabulary()
        for n in shared.value:
            machine.add_word(f" {n} ", n)
        machine.make_automaton()
        for batch in batches:
            keys, found = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = [words[w] for w in WORD.findall(t or "")]
                low = [words.low[i] for i in ids]
                starts = list(accumulate((len(w) + 1 for w in low), initial=0))
                for end, n in machine.iter(" " + " ".join(low) + " "):
                    first = bisect_left(starts, end - len(n) - 1)
                    keys.append(k)
                    found.append((n, first, words.capital[ids[first]]))
                if len(words) > VOCABULARY:
                    words = _Vocabulary()
            yield _found(batch, key, keys, found)

    return df.mapInArrow(find, schema)


def _by_filter(df: DataFrame, key: str, schema: str, lengths: list[int], bits: np.ndarray, width: int) -> DataFrame:
    """The places of all runs of words that a filter lets through: those of all names, and a few more."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def find(batches):
        held, words = shared.value, _Vocabulary()
        for batch in batches:
            row, texts = 0, [t or "" for t in batch.column(1).to_pylist()]
            while row < len(texts):
                first, chars, said, starts = row, 0, [], [0]
                while row < len(texts) and (row == first or chars + len(texts[row]) <= SLICE):
                    said += WORD.findall(texts[row])
                    starts.append(len(said))
                    chars, row = chars + len(texts[row]), row + 1
                ids = np.fromiter(map(words.__getitem__, said), np.int64, len(said))
                text = np.repeat(np.arange(first, row), np.diff(starts))
                hashes = np.frombuffer(words.hashed, np.uint64)[ids] if said else np.empty(0, np.uint64)
                keys, found, number = [], [], ids.tolist()
                for size, run in _windows(hashes, lengths):
                    at = np.flatnonzero(text[: len(run)] == text[size - 1 :])
                    for b in _bits_of(run, width):
                        b = b[at]
                        at = at[(held[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1]
                    keys.append(text[at])
                    place = at - np.asarray(starts)[text[at] - first]
                    found += [(" ".join([words.low[i] for i in number[a : a + size]]), p, words.capital[number[a]]) for a, p in zip(at.tolist(), place.tolist(), strict=True)]
                if len(words) > VOCABULARY:
                    words = _Vocabulary()
                yield _found(batch, key, batch.column(0).take(pa.array(np.concatenate(keys) if keys else [], pa.int64())), found)

    return df.mapInArrow(find, schema)


def _found(batch: pa.RecordBatch, key: str, keys, found: list[tuple]) -> pa.RecordBatch:
    names, firsts, capitals = zip(*found, strict=True) if found else ((), (), ())
    keys = keys if isinstance(keys, pa.Array) else pa.array(keys, batch.schema.field(0).type)
    return pa.RecordBatch.from_arrays([keys, pa.array(names, pa.string()), pa.array(firsts, pa.int64()), pa.array(capitals, pa.bool_())], names=[key, "name", "at", "capital"])


def _searched(df: DataFrame, key: str, text: str, names: DataFrame, name: str, max_names: int = 200_000) -> tuple[DataFrame, DataFrame | None]:
    """The places of names_in(), and the names that what they call a name must be one of, unless all are."""
    spark = df.sparkSession

    def plain(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([folded_name(n) for n in batch.column(0).to_pylist()], pa.string())], names=["name"])

    held = names.select(F.col(name).cast("string").alias("name")).filter("name is not null").distinct().mapInArrow(plain, "name string")
    held = stored(held.filter("name <> ''").distinct(), "names")
    schema, n = f"{key} {df.schema[key].dataType.simpleString()}, name string, at long, capital boolean", held.count()
    texts = df.select(key, F.col(text).cast("string").alias("gazetteer_text"))
    if not n:
        return spark.createDataFrame([], schema), None
    if n <= max_names:
        return _by_automaton(texts, key, schema, sorted(r[0] for r in held.collect())), None
    lengths = sorted(r[0] for r in held.select(F.size(F.split("name", " "))).distinct().collect())
    return _by_filter(texts, key, schema, lengths, *_filter(held, n)), held


def names_in(df: DataFrame, key: str, text: str, names: DataFrame, name: str, max_names: int = 200_000) -> DataFrame:
    """Each place where a name's words stand one after another in a text: key, name (folded), at (its first word, from 0) and capital
    (whether that word begins with one there).

    Names and texts are compared as folded words (runs of letters and digits), so hyphens, accents and case do not part them; names may
    overlap, and all are found. A text is read once, whatever the number of names: up to max_names by an Aho-Corasick automaton,
    in time of its length and its finds; more are too many for a task, so runs of words as long as names are looked up in a
    filter of bounded size, and those that it lets through are joined with the names. Null texts and names without a word give
    nothing; repeated rows give their places each; names that fold alike are one.
    """
    places, held = _searched(df, key, text, names, name, max_names)
    return places if held is None else places.join(held.hint("merge"), "name", "left_semi").select(*places.columns)


def names_counted(df: DataFrame, key: str, text: str, names: DataFrame, name: str, max_names: int = 200_000) -> DataFrame:
    """The places of names_in() added up by key and name: n, places (the sum of at) and capitals. They are added up before they meet the names."""
    places, held = _searched(df, key, text, names, name, max_names)
    out = places.groupBy(key, "name").agg(F.count(F.lit(1)).alias("n"), F.sum("at").alias("places"), F.count_if("capital").alias("capitals"))
    return out if held is None else out.join(held.hint("merge"), "name", "left_semi").select(*out.columns)


def _words(c: Column) -> Column:
    """Distinct folded words of four letters and more."""
    return F.array_distinct(words_of(c, 4))


def coherence(rows: DataFrame, names: DataFrame, key: str, text: str, identity: list[str], town: str, name: str, common: list[str] = (), **options) -> DataFrame:
    """Whether a row's text tells of the row: key, elsewhere (the first three other places it names, sorted) and verdict.

    Signal 1 (foreign): the text shares no word of four letters with the identity (title, venue, town). Signal 2 (elsewhere): it
    names places of the gazetteer, as names with a capital, and not its own town; places that hold the town's name or are held in
    it are its own, and names that are everyday words (common) count for nothing. Either alone is often wrong, as texts are written in two
    languages and tell of neighbouring towns, so only both block: verdict blocked, elsewhere, foreign, or silent. A row without a
    town has no signal 2, one without identity words no signal 1, and a row without text is silent. Rows must have different keys.
    """
    own = F.trim(F.regexp_replace(fold(F.col(town)), "[^a-z0-9]+", " "))
    line = F.concat(F.lit(" "), folded_key(F.coalesce(F.col(text), F.lit(""))), F.lit(" ")).alias("line")  # folded once for all signs
    told = (F.trim(F.coalesce(F.col(text), F.lit(""))) != "").alias("told")
    held = rows.select(key, F.coalesce(own, F.lit("")).alias("own"), _words(F.concat_ws(" ", *identity)).alias("is"), told, line)
    holds = lambda w: F.contains("line", F.concat(F.lit(" "), w, F.lit(" ")))
    held = held.select(key, "own", (F.col("told") & (F.size("is") > 0) & ~F.exists("is", holds)).alias("foreign"), holds(F.col("own")).alias("named"))
    places, true = _searched(rows, key, text, names, name, **options)
    found = places.filter("capital").select(key, "name").distinct()
    met = found.join(held.select(key, "own").filter("own <> ''").hint("merge"), key)
    other = met.filter(~F.contains("own", "name") & ~F.contains("name", "own"))
    other = other if true is None else other.join(true.hint("merge"), "name", "left_semi")
    other = (other.filter(~F.col("name").isin(*common)) if common else other).groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("others"))
    out = held.join(other.hint("merge"), key, "left")
    away, foreign = F.col("others").isNotNull() & ~F.col("named"), F.col("foreign")
    verdict = F.when(away & foreign, "blocked").when(away, "elsewhere").when(foreign, "foreign").otherwise("silent")
    return out.select(key, F.when(away, F.array_join(F.slice("others", 1, 3), ", ")).alias("elsewhere"), verdict.alias("verdict"))

