"""Hashes of words and of runs of words, for many texts at once in numpy.

A word's hash reads eight bytes at a time and mixes after each; a run's hash pairs the hashes of its halves, mixing at
each level. Neither is linear, so no pattern of letters or words makes two values equal but by chance (1 in 2**64 for
a pair). The second family of hashes is independent of the first, so both together make 128 bits.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U = np.uint64
#: What is added to and multiplied with values, for each of the two families of hashes.
FAMILIES = ((U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)), (U(0x8CB92BA72F3D8DD7), U(0xDB4F0B9175AE2165)))
#: Bytes of a word that are read eight at a time; longer words go to blake2b.
LONG = 64

#: Bytes that words are made of: anything but ASCII white space, and lower-cased letters, digits and what is beyond ASCII.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
TERMS = np.zeros(256, bool)
TERMS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: The lowest n bytes of a number.
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of each number over all, one to one (the finalizer of splitmix64, a public generator)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    return np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A hash of data[start:end] for each pair; words of up to seven bytes never share one among themselves."""
    add, times = FAMILIES[family]
    size, at = ends - starts, eights(data)
    out = at[starts] & LOW[np.minimum(size, 8)]
    short = size < 8
    out[short] |= size[short].astype(U) << U(56)
    out = mix(out + add)
    rest = np.flatnonzero(~short)
    out[rest] = mix(out[rest] * times + size[rest].astype(U))
    for done in range(8, LONG, 8):
        rest = rest[size[rest] > done]
        if not len(rest):
            break
        out[rest] = mix(out[rest] * times + (at[starts[rest] + done] & LOW[np.minimum(size[rest] - done, 8)]))
    for i in rest[size[rest] > LONG].tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8, person=bytes([family])).digest(), "little")
    return out


def run_hashes(hashes: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """A hash of hashes[i : i + width] for each i up to the last whole run."""
    _, times = FAMILIES[family]
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, part, span = None, 0, hashes, 1  # part holds the hashes of all runs of span
    while done < width:
        if width & span:
            piece = part[done : done + n]
            out, done = (piece if out is None else mix(out * times + piece)), done + span
        if done < width:
            part = mix(part[:-span] * times + part[span:])
            span *= 2
    return out


class Words:
    """The words of some texts: hash, byte range in data, and the number of the first word of each text (and of the end).

    Takes about 20 bytes of memory for each byte of text while it is made, and 24 for each word afterwards.
    """

    def __init__(self, texts: list[str | None], kind: np.ndarray = PLAIN, lower: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n".join(raw)
        self.data = joined.lower() if lower else joined  # bytes.lower changes A-Z only
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = kind[np.frombuffer(self.data, np.uint8)]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        at = np.cumsum([0, *(len(r) + 1 for r in raw)])[: len(raw)]
        self.first = np.append(np.searchsorted(self.starts, at), len(self.starts)).astype(np.int64)
        self.hash = word_hashes(self.data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def positions(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word its text and its place there."""
        text = np.repeat(np.arange(len(self)), self.counts())
        return text, np.arange(len(self.hash)) - self.first[text]

    def runs(self, at: np.ndarray, width: int, family: int = 0) -> np.ndarray:
        """Hashes of the width words from each of the given words on; they must not pass the last."""
        if not len(at):
            return np.zeros(0, U)
        words = self.hash if family == 0 else word_hashes(self.data, self.starts, self.ends, family)
        return run_hashes(words, width, family)[at]

    def text(self, i: int, kept: np.ndarray) -> str:
        """The words of text i where kept is true, joined by one blank."""
        a, b = self.first[i], self.first[i + 1]
        return b" ".join([self.data[s:e] for s, e, k in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), kept.tolist(), strict=True) if k]).decode("utf-8", "surrogatepass")
