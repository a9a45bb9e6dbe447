"""Vectorised hashing of the words of many texts at once, for use inside Arrow tasks.

Texts are joined into one byte buffer; words become rows of numpy arrays, so that no Python object is made per word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes, about, that one block of texts holds; a longer text is a block of its own.
BLOCK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits (the finisher of splitmix64)."""
    x = np.asarray(x, U).copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def series(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values; the first ones don't depend on n."""
    return mixed((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15))


@functools.cache
def _places(n: int) -> np.ndarray:
    return series(n, 2) | U(1)


@functools.cache
def _letters(fold: bool) -> np.ndarray:
    table = series(256, 1)
    if fold:
        table[65:91] = table[97:123]
    return table


@functools.cache
def _space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


@functools.cache
def _no_letter() -> np.ndarray:
    """ASCII but for letters; the bytes of other characters count as letters."""
    table = np.zeros(256, bool)
    table[:128] = True
    table[65:91] = table[97:123] = False
    return table


class Words:
    """Words of a block of texts: byte start and length, hash, and the number of words of each text."""

    def __init__(self, texts: list[bytes], fold: bool = True, letters: bool = False, prefix: int = 0):
        """fold: A-Z (with ``letters``, also the accented capitals of Latin-1) as lower case. letters: runs of letters, else runs of non-spaces. prefix: also hash the first so many bytes."""
        self.offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if letters:
            lead = np.zeros(len(data), bool)
            lead[1:] = data[:-1] == 0xC3
            data = np.where(lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), data + 0x20, data).astype(np.uint8)
        inside = ~(_no_letter() if letters else _space())[data]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        self.start, end = edge[0::2], edge[1::2]
        self.length = end - self.start
        self.of = np.searchsorted(self.offsets, self.start, "right") - 1
        self.count = np.bincount(self.of, minlength=len(texts))
        self.hash = np.zeros(len(self.start), U)
        self.prefix = self.hash
        if len(self.start):
            at = np.flatnonzero(inside)
            first = np.cumsum(self.length) - self.length
            place = np.arange(len(at)) - np.repeat(first, self.length)
            longest = int(self.length.max())
            term = _letters(fold)[data[at]] * _places(max(64, 1 << (longest - 1).bit_length()))[place]
            self.hash = mixed(np.add.reduceat(term, first) + self.length.astype(U))
            if prefix:
                term[place >= prefix] = 0
                self.prefix = mixed(np.add.reduceat(term, first) + U(1 << 40))


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as UTF-8 in blocks of about BLOCK bytes, each with the place of its first one. Null is empty."""
    begin, own, size = 0, [], 0
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if own and size + len(raw) > BLOCK:
            yield begin, own
            begin, own, size = k, [], 0
        own.append(raw)
        size += len(raw)
    if own:
        yield begin, own


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of ``width`` words in one text; of all words where a text has fewer."""
    n, count = len(words.hash), words.count
    hashes, of = np.empty(0, U), np.empty(0, np.int64)
    if not n:
        return hashes, of
    factors = series(width, 3) | U(1)
    if n >= width:
        total = np.zeros(n - width + 1, U)
        for k in range(width):
            total += words.hash[k : n - width + 1 + k] * factors[k]
        whole = words.of[: n - width + 1] == words.of[width - 1 :]
        hashes, of = mixed(total[whole]), words.of[: n - width + 1][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.cumsum(count) - count
        rest = np.array([np.bitwise_xor.reduce(mixed(words.hash[begin[t] : begin[t] + count[t]] + factors[: count[t]])) for t in short], U)
        hashes, of = np.concatenate([hashes, mixed(rest + U(7))]), np.concatenate([of, short])
    return hashes, of


def distinct(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) rows in that order."""
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    keep = np.ones(len(of), bool)
    keep[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[keep], of[keep]
