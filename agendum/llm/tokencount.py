"""Token counts by finite-state transducers compiled from a BPE vocabulary.

Two deterministic transducers count the tokens of a text without making them:

* the splitter reads character classes and marks where the tokenizer's pattern starts a word. It has seven
  states, so a chunk of any text is a map from seven states to seven; the maps of all chunks of a batch are made
  side by side and composed by a parallel prefix scan, which gives every chunk its first state;
* the word transducer reads the bytes of a word. Each transition carries the change in the number of tokens, so
  a word's count is the sum along its path. States are made when first met: BPE's last token at a position
  depends only on the last tokens before it and on the bytes since the longest suffix that begins a token, which
  are finitely many.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agendum.llm import common

# Character classes. Letters that may end a contraction have classes of their own.
BLANK, OTHER, LETTER, NUMBER, QUOTE, STMD, R, V, L, E = range(10)
LETTERS = (LETTER, STMD, R, V, L, E)
# States of the splitter: no open word, in letters, in symbols, after a word-opening quote, and after 'r 'v 'l.
FRESH, WORD, SYMBOLS, QUOTED, SEEN_R, SEEN_V, SEEN_L = range(7)
STATES, CLASSES = 7, 10
#: Outputs: a word starts here; a word started one character earlier.
HERE, EARLIER = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output for each state and class, of the pattern
    's|'t|'re|'ve|'m|'ll|'d|letters|one number|symbols, white space dropped."""
    to, out = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    for state in range(STATES):
        late = EARLIER if state in (SEEN_R, SEEN_V, SEEN_L) else 0  # the quote stood alone after all
        for c in range(CLASSES):
            if c == BLANK:
                step = FRESH, late
            elif c == NUMBER:
                step = FRESH, HERE | late
            elif c in LETTERS:
                step = WORD, late or (0 if state == WORD else HERE)
            elif state in (SYMBOLS, QUOTED):
                step = SYMBOLS, 0
            else:
                step = (QUOTED if c == QUOTE else SYMBOLS), HERE | late
            to[state, c], out[state, c] = step
    to[QUOTED, STMD], out[QUOTED, STMD] = FRESH, 0
    for c, state, end in ((R, SEEN_R, E), (V, SEEN_V, E), (L, SEEN_L, L)):
        to[QUOTED, c], out[QUOTED, c] = state, 0
        to[state, end], out[state, end] = FRESH, 0
    return to.ravel(), out.ravel()


def every_character() -> str:
    """All code points that a text can hold, in order, without the surrogates."""
    return "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))


def classes() -> np.ndarray:
    """The class of every code point, as the tokenizers library's own expressions see it: its Unicode tables may be newer than Python's."""
    from tokenizers import Regex, pre_tokenizers

    table, every = np.full(sys.maxunicode + 1, OTHER, np.uint8), every_character()
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        found = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every)
        table[[ord(c) for c, _ in found]] = kind
    for chars, kind in (("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(c) for c in chars]] = kind
    return table


def python_normal(text: str) -> str:
    """Normal form C, then lower case letter by letter (no rule for the sigma at a word's end), by Python's tables."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def library_normal():
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str


def unlike() -> np.ndarray:
    """For each code point whether Python does not know it or makes another of it than the library does; texts with one go to the library."""
    every, table = every_character(), np.zeros(sys.maxunicode + 1, bool)
    made = library_normal()("\n".join(every)).split("\n")
    made[every.index("\n")] = "\n"
    made = made[: every.index("\n") + 1] + made[every.index("\n") + 2 :]  # the line end itself made one line more
    table[[ord(c) for c, m in zip(every, made, strict=True) if m != python_normal(c) or unicodedata.category(c) == "Cn"]] = True
    return table


@cache
def character_tables() -> tuple[bytes, bytes]:
    """classes() and unlike(), compressed: made once on the driver, a few kilobytes that travel with the tasks."""
    return zlib.compress(classes().tobytes()), zlib.compress(unlike().tobytes())


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """The composition of maps[0] to maps[i] for each i, in about log2(n) parallel steps."""
    step = 1
    while step < len(maps):
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step], 1)])
        step *= 2
    return maps


def starts_of_words(kinds: np.ndarray, to: np.ndarray, out: np.ndarray, chunk: int = 128) -> np.ndarray:
    """Where words start in an array of classes."""
    n = -(-(len(kinds) + 1) // chunk)
    grid = np.zeros(n * chunk, np.uint8)  # BLANK behind the end closes what is open
    grid[: len(kinds)] = kinds
    steps = np.ascontiguousarray(grid.reshape(n, chunk).T)
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (n, STATES))
    for column in steps:
        maps = to[maps * np.uint8(CLASSES) + column[:, None]]
    state = np.concatenate([[np.uint8(FRESH)], compose_scan(maps)[:-1, FRESH]]).astype(np.uint8)
    marks = np.empty_like(steps)
    for column, mark in zip(steps, marks, strict=True):
        at = state * np.uint8(CLASSES) + column
        mark[:] = out[at]
        state = to[at]
    marks = marks.T.ravel()
    marks[:-1] |= (marks[1:] & EARLIER) >> 1
    return np.flatnonzero(marks[: len(kinds)] & HERE)


class WordTransducer:
    """Counts BPE tokens of a word: states are numbered as they are met, transitions carry changes of the count.

    Symbols are bytes, and bytes + 256 where the word ends. symbol: the vocabulary's character for each byte.
    """

    def __init__(self, merges: list[tuple[str, str]], suffix: str, symbol: dict[str, int]):
        def plain(token: str) -> str:
            end = token.endswith(suffix) if suffix else False
            chars = [symbol[c] for c in (token[: -len(suffix)] if end else token)]
            return "".join(map(chr, [*chars[:-1], chars[-1] + 256 * end]))

        self.rank = {}
        for n, (a, b) in enumerate(merges):
            self.rank.setdefault((plain(a), plain(b)), n)
        self.tokens = {a + b for a, b in self.rank} | {chr(b) for b in range(512)}
        self.beginnings = {t[:n] for t in self.tokens for n in range(1, len(t))} | {""}
        self.fits: dict[tuple[str | None, str], bool] = {}
        first = ("", (None,), (0,))
        self.number, self.states, self.next = {first: 0}, [first], {}

    def merged(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fit(self, last: str | None, token: str) -> bool:
        """Whether BPE keeps the two apart as they are: the test for standing side by side anywhere."""
        known = self.fits.get((last, token))
        if known is None:
            pair = [token] if last is None else [last, token]
            known = self.fits[last, token] = self.merged(list("".join(pair))) == pair
        return known

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """A new transition: the next state and the change in tokens."""
        text, last, count = self.states[state]
        text += chr(symbol)
        for k in range(len(text)):
            if (token := text[k:]) in self.tokens and self.fit(last[k], token):
                break
        else:
            raise ValueError(f"no token ends after {text!r}")
        change = count[k] + 1
        if symbol >= 256:
            to = -1  # the word is over
        else:
            cut = next(i for i in range(len(text) + 1) if text[i:] in self.beginnings)
            made = (text[cut:], (*last, token)[cut:], tuple(c - change for c in (*count, change))[cut:])
            to = self.number.get(made, -1)
            if to < 0:
                to = self.number[made] = len(self.states)
                self.states.append(made)
        self.next[state << 9 | symbol] = to, change
        return to, change

    def count(self, word: bytes) -> int:
        state = total = 0
        for symbol in [*word[:-1], word[-1] + 256]:
            state, change = self.next.get(state << 9 | symbol) or self.step(state, symbol)
            total += change
        return total


class Counter(dict):
    """Token counts of texts for one vocabulary file; counts of at most max_words words and max_states states are kept."""

    def __init__(self, path: str, tables: tuple[bytes, bytes] | None = None, max_words: int = 300_000, max_states: int = 300_000):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, pattern = made["model"], json.dumps(made["pre_tokenizer"])
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or "'re|'ve|'m|'ll|'d|[" not in pattern or [n["type"] for n in made["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("transducers are made for lower-casing byte-level BPE with a word-end suffix")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level vocabularies show these bytes as themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        symbol = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.make = lambda: WordTransducer(merges, model["end_of_word_suffix"], symbol)
        self.words, self.max_words, self.max_states = self.make(), max_words, max_states
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in made["added_tokens"]) + ")")
        kinds, odd = tables or character_tables()
        self.kind, (self.to, self.out) = np.frombuffer(zlib.decompress(kinds), np.uint8), splitter()
        self.unlike, self.library = np.frombuffer(zlib.decompress(odd), bool), library_normal()

    def __missing__(self, word: str) -> int:
        n = self.words.count(word.encode())
        if len(word) <= 64:
            self[word] = n
        return n

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return self.library(text) if self.unlike[codes].any() else python_normal(text)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        whole, owner, total = [], [], np.zeros(len(texts), np.int64)
        for n, text in enumerate(texts):
            for k, part in enumerate(self.special.split(text) if text and "<" in text else [text or ""]):
                if k % 2:
                    total[n] += 1  # a special string is one token
                else:
                    whole.append(self.normal(part))
                    owner.append(n)
        joined = "\n".join(whole)
        kinds = self.kind[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
        starts = starts_of_words(kinds, self.to, self.out)
        if len(starts):
            edge = kinds == BLANK
            edge[starts] = True
            edges = np.append(np.flatnonzero(edge), len(kinds))
            ends = edges[np.searchsorted(edges, starts, "right")]
            of_word = np.fromiter([self[joined[a:b]] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64, len(starts))
            ends_of_parts = np.cumsum([len(w) + 1 for w in whole])
            part = np.searchsorted(ends_of_parts, starts, "right")
            total += np.bincount(np.asarray(owner)[part], of_word, len(texts)).astype(np.int64)
        if len(self) > self.max_words:
            self.clear()
        if len(self.words.states) > self.max_states:
            self.words = self.make()
        return total


_open: dict[str, Counter] = {}


def counter(path: str, tables: tuple[bytes, bytes] | None = None) -> Counter:
    if path not in _open:
        _open[path] = Counter(path, tables)
    return _open[path]


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) to each row; no shuffle, other columns stay.

    Null and empty texts have 0 bytes and tokens; repeated rows stay repeated; columns of these three names are
    replaced; an empty table stays empty. Special strings inside a text count as one token, as the library has it.
    """
    common.ship(docs.sparkSession)
    kept = [c for c in common.without(docs, ["n_bytes", "n_tokens", "over_limit"])]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("n_tokens", F.lit(0).cast("long")).schema

    tables = character_tables()

    def count(batches):
        for batch in batches:
            texts = batch.column(kept.index(text)).to_pylist()
            total = np.concatenate([np.zeros(0, np.int64), *(counter(tokenizer, tables).counts(texts[a:b]) for a, b in common.slices(texts, 1_000_000))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], names=[*batch.schema.names, "n_tokens"])

    out = docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(count, schema)
    return out.withColumns({"n_bytes": F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long"), "over_limit": F.col("n_tokens") > limit})
