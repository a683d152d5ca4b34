"""Token ids by the tokenizers library, asked once for each new piece of text.

Both vocabularies split a text at white space, and between letters, digits and symbols, before they merge bytes, so
the ids of a text are those of its pieces one after another. Pieces are found and looked up by hashes in numpy, for
many texts at once, and their bytes are compared with those kept; the library encodes pieces that are new, and the
ids of the ones met lately are kept.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd

from agendum.llm.wordhash import LOW, eights, word_hashes

#: White space as the tokenizers' own patterns take it (the Unicode property White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
FAR_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Kinds of bytes. BREAK stands between texts; bytes beyond ASCII count as letters.
BLANK, LETTER, DIGIT, SYMBOL, BREAK = range(5)
KIND = np.full(256, SYMBOL, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xFF)]] = LETTER
KIND[0x30:0x3A] = DIGIT
KIND[0xFF] = BREAK


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split(data: np.ndarray, keep_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of texts joined by 0xFF.

    A piece is a run of letters, digits or symbols; a word with an apostrophe or with characters other than the
    letters of Latin-1 stays whole, as rules of the tokenizers may join what differs in kind there. With keep_space
    a run takes the blank before it, and what is left of white space makes pieces as the byte-level pattern has it:
    a run up to its last character where a word follows, the last character unless the word takes it, else all.
    """
    kind = KIND[data]
    apart = np.ones(len(data) + 1, bool)
    apart[1:-1] = kind[1:] != kind[:-1]
    inside = (kind != BLANK) & (kind != BREAK)
    previous = np.concatenate([[0], data[:-1]])
    odd = (data == 0x27) | (data >= 0x80) & (data != 0xC3) & ((previous != 0xC3) | (data == 0x97) | (data == 0xB7)) & (data != 0xFF)
    if odd.any():
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        total = np.concatenate([[0], np.cumsum(odd)])
        for a, b in zip(*(x[total[ends] > total[starts]].tolist() for x in (starts, ends)), strict=True):
            apart[a + 1 : b] = False
    at = np.flatnonzero(apart)
    starts, ends = at[:-1], at[1:]
    first = kind[starts] if len(starts) else np.zeros(0, np.uint8)
    if not keep_space:
        word = inside[starts]
        return starts[word], ends[word]
    blank = first == BLANK
    followed = np.zeros(len(starts), bool)
    followed[:-1] = blank[:-1] & (first[1:] != BREAK)
    taken = followed & (data[ends - 1] == 0x20)  # by the word behind
    left = np.flatnonzero(followed & (ends - starts > 1))  # what stands before the last character
    words, last = np.flatnonzero(~blank & (first != BREAK)), np.flatnonzero(followed & ~taken)
    whole = np.flatnonzero(blank & ~followed)
    after = np.zeros(len(starts), bool)
    after[1:] = taken[:-1]
    a = np.concatenate([starts[words] - after[words], starts[left], ends[last] - 1, starts[whole]])
    b = np.concatenate([ends[words], ends[left] - 1, ends[last], ends[whole]])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


#: Bytes of a piece that is looked up; texts with longer ones go to the library.
LONGEST = 1024
#: A blank between two ASCII letters: both vocabularies part texts there whatever stands around.
SEAM = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def parts(text: str, chars: int = 4_000_000):
    """The text in parts of about so many characters whose ids, one after another, are the text's."""
    a = 0
    while len(text) - a > chars and (seam := SEAM.search(text, a + chars)):
        yield text[a : seam.start()]
        a = seam.start()
    yield text[a:] if a else text


def spread(starts: np.ndarray, counts: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """starts[i], starts[i] + step, ... (counts[i] of them) for each i, and the number of each among those of its i."""
    before = np.cumsum(counts) - counts
    within = np.arange(int(counts.sum())) - np.repeat(before, counts)
    return np.repeat(starts, counts) + step * within, within


def contents(at: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of pieces, eight in a number, one piece after another."""
    counts = (sizes + 7) // 8
    places, within = spread(starts, counts, 8)
    return at[places] & LOW[np.minimum(np.repeat(sizes, counts) - 8 * within, 8)]


class Pieces:
    """Token ids of texts, as the library gives them for each whole text; ids of at most max_pieces pieces are kept.

    Pieces are looked up by 64-bit hashes and count as met only if their bytes are equal. A text that holds one of the
    tokenizer's special strings, white space beyond ASCII, a piece of more than LONGEST bytes, or two pieces of one hash
    goes to the library whole.
    """

    def __init__(self, path: str, max_pieces: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        same = lambda a, b: self.library([a]) == self.library([b])
        self.keep_space, self.lower = not same("a a", "a  a"), same("a", "A")
        self.max_pieces, self.turn = max_pieces, 0
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash; those of the last batches are in recent
        self.recent: dict[int, int] = {}
        self.used = np.zeros(0, np.int64)
        self.start, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)  # ids of each piece
        self.byte_start, self.bytes, self.byte_pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)  # its bytes, eight in a number

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def settle(self) -> None:
        """Moves recent pieces to the sorted arrays and, if there are too many, keeps the half that was used last."""
        hashes = np.concatenate([self.hashes, np.fromiter(self.recent, np.uint64, len(self.recent))])
        numbers = np.concatenate([self.numbers, np.fromiter(self.recent.values(), np.int64, len(self.recent))])
        self.recent = {}
        if len(numbers) > self.max_pieces:
            late = np.argsort(self.used[numbers], kind="stable")[len(numbers) // 2 :]
            hashes, numbers = hashes[late], numbers[late]
            sizes, eighths = self.size[numbers], (self.bytes[numbers] + 7) // 8
            self.pool, self.byte_pool = self.gather(numbers), self.byte_pool[spread(self.byte_start[numbers], eighths)[0]]
            self.used, self.bytes = self.used[numbers], self.bytes[numbers]
            self.start, self.size, self.byte_start = np.cumsum(sizes) - sizes, sizes, np.cumsum(eighths) - eighths
            numbers = np.arange(len(numbers))
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], numbers[order]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of pieces, -1 for new ones."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == hashes, self.numbers[at], -1)
        rest = np.flatnonzero(out < 0)
        out[rest] = [self.recent.get(h, -1) for h in hashes[rest].tolist()]
        return out

    def gather(self, pieces: np.ndarray) -> np.ndarray:
        return self.pool[spread(self.start[pieces], self.size[pieces])[0]]

    def differ(self, sizes: np.ndarray, others: np.ndarray, values, of_others) -> np.ndarray:
        """Which of some pieces are not, byte for byte, the others they are paired with; values and of_others give contents."""
        out = sizes != others
        same = np.flatnonzero(~out & (sizes > 7))  # up to seven bytes, equal hashes are equal words
        if len(same):
            eighths = (sizes[same] + 7) // 8
            out[same] = np.add.reduceat(values(same) != of_others(same), np.cumsum(eighths) - eighths, dtype=np.int64) > 0
        return out

    def add(self, data: bytes, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The numbers of new pieces, encoded by the library."""
        made = self.library([data[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        numbers = len(self.size) + np.arange(len(starts))
        self.recent.update(zip(hashes.tolist(), numbers.tolist(), strict=True))
        sizes, eighths = np.array([len(m) for m in made], np.int64), (ends - starts + 7) // 8
        self.start = np.append(self.start, len(self.pool) + np.cumsum(sizes) - sizes)
        self.byte_start = np.append(self.byte_start, len(self.byte_pool) + np.cumsum(eighths) - eighths)
        self.size, self.bytes = np.append(self.size, sizes), np.append(self.bytes, ends - starts)
        self.used = np.append(self.used, np.zeros(len(starts), np.int64))
        self.pool = np.append(self.pool, np.array([i for m in made for i in m], np.uint32))
        self.byte_pool = np.append(self.byte_pool, contents(at, starts, ends - starts))
        return numbers

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit unsigned integers; none for null and empty texts. Very long texts are
        worked on in parts, so memory is bounded but for the text and its ids."""
        cut = [list(parts(t or "")) for t in texts]
        flat = self._ids([p for ps in cut for p in ps])
        if len(flat) == len(texts):
            return flat
        ends = np.cumsum([len(ps) for ps in cut]).tolist()
        return [b"".join(flat[b - len(ps) : b]) for ps, b in zip(cut, ends, strict=True)]

    def _ids(self, texts: list[str]) -> list[bytes]:
        whole = np.array([any(s in t for s in self.special) or not t.isascii() and FAR_SPACE.search(t) is not None for t in texts], bool)
        while True:
            raw = [b"" if w else t.encode("utf-8") for t, w in zip(texts, whole.tolist(), strict=True)]
            joined = b"\xff".join(raw)
            joined = joined.lower() if self.lower else joined
            starts, ends = split(np.frombuffer(joined, np.uint8), self.keep_space)
            begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
            long = np.flatnonzero(ends - starts > LONGEST)
            if not len(long):
                break
            whole[np.searchsorted(begin, starts[long], "right") - 1] = True
        hashes, at, sizes = word_hashes(joined, starts, ends), eights(joined), ends - starts
        codes, hashes = pd.factorize(hashes)
        self.turn += 1
        first = np.empty(len(hashes), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]  # where each piece stands first
        numbers = self.known(hashes)
        met = np.flatnonzero(numbers >= 0)
        clash = np.zeros(len(hashes), bool)
        kept, mine = numbers[met], first[met]
        of_kept = lambda i: self.byte_pool[spread(self.byte_start[kept[i]], (self.bytes[kept[i]] + 7) // 8)[0]]
        clash[met] = self.differ(sizes[mine], self.bytes[kept], lambda i: contents(at, starts[mine[i]], sizes[mine[i]]), of_kept)
        model = first[codes]
        here = lambda n: lambda i: contents(at, starts[n[i]], sizes[n[i]])
        odd = clash[codes] | self.differ(sizes, sizes[model], here(np.arange(len(codes))), here(model))
        if odd.any():
            whole[np.searchsorted(begin, starts[odd], "right") - 1] = True
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = self.add(joined, at, starts[first[new]], ends[first[new]], hashes[new])
        self.used[numbers] = self.turn
        pieces = numbers[codes]
        flat = self.gather(pieces).astype("<u4").tobytes()
        tokens = np.concatenate([[0], np.cumsum(self.size[pieces])])[np.searchsorted(starts, begin)]
        tokens = (4 * tokens).tolist()
        if len(self.recent) > 50_000 or len(self.size) > self.max_pieces:
            self.settle()
        return [np.array(self.library([t])[0], "<u4").tobytes() if w else flat[tokens[n] : tokens[n + 1]] for n, (t, w) in enumerate(zip(texts, whole.tolist(), strict=True))]


_open: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One per worker process and vocabulary."""
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]
