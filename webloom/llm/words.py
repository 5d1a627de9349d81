"""Words of many texts at once, as arrays: every word has a 64-bit hash, a place and a row."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import scan

MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(MULT), -1, 1 << 64))


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a letter or digit, is it a letter, and its lower case where that is one code point."""
    alnum, alpha, lower = np.zeros(0x110000, bool), np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            alnum[i], alpha[i] = True, c.isalpha()
            if len(d := c.lower()) == 1:
                lower[i] = ord(d)
    # combining marks belong to the word that they stand in
    for a, b in ((0x300, 0x370), (0x483, 0x488), (0x591, 0x5C8), (0x610, 0x61B), (0x64B, 0x660), (0x900, 0x904), (0x93A, 0x950), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100), (0xFE20, 0xFE30)):
        alnum[a:b] = alpha[a:b] = True
    return alnum, alpha, lower


_powers: list[np.ndarray] = []


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT ** i and its inverse modulo 2 ** 64, for i below size. Of all sizes the largest is kept, up to a million (16 MB)."""
    if not _powers or len(_powers[0]) < size:
        up, down = np.full(size, MULT, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        if size > 1 << 20:
            return up, down
        _powers[:] = [up, down]
    return _powers[0][:size], _powers[1][:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    codes: np.ndarray  # lower-cased code points of all rows
    row_at: np.ndarray  # offsets of the rows in codes
    start: np.ndarray  # of each word in codes
    end: np.ndarray
    row: np.ndarray  # of each word
    hash: np.ndarray  # of each word's code points

    def text(self, i: int) -> str:
        return self.codes[self.start[i] : self.end[i]].astype("<u4").tobytes().decode("utf-32-le", "replace")


def code_points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


def words(column: pa.Array, letters_only: bool = False) -> Words:
    """Maximal runs of letters and digits (or of letters) of each row, lower-cased. Nulls and empty texts have none."""
    alnum, alpha, lower = tables()
    raw, at = scan(column)
    codes = code_points(raw)
    if len(codes) != len(raw):  # byte offsets to code point offsets
        firsts = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        at = np.concatenate([[0], firsts])[at]
    codes = lower[codes]
    inside = (alpha if letters_only else alnum)[codes]
    # a word also ends where its row ends
    padded = np.zeros(len(codes) + 1, np.int8)
    padded[:-1] = inside
    step = np.diff(padded, prepend=np.int8(0))
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(codes))]
    cut = cut[inside[cut - 1] & inside[cut]] if len(cut) else cut
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(cut):
        cut = np.unique(cut)
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    up, down = powers(1 << max(16, int(len(codes)).bit_length()))
    run = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=run[1:])
    hashed = mix((run[end] - run[start]) * down[start])
    row = np.searchsorted(at, start, side="right") - 1
    return Words(codes, at, start, end, row, hashed)


def text_hash(word: str) -> int:
    """The hash that words() gives to this word."""
    total = 0
    for i, c in enumerate(word):
        total += (ord(c) + 1) * pow(int(MULT), i, 1 << 64)
    return int(mix(np.array([total % (1 << 64)], np.uint64))[0])


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words within a row, and the index of the first word of each."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w.hash[:n].copy()
    for i in range(1, k):
        h = h * MULT + w.hash[i : n + i]
    first = np.flatnonzero(w.row[:n] == w.row[k - 1 :])
    return mix(h[first]), first
