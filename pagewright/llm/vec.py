"""Vectorised text kernels: a batch of texts is one array of code points, so that hashing n-grams costs a few numpy
operations a character and no Python loop over words. All hashes are functions of the text alone: equal on every machine."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    """For every code point: is it a letter or a digit (Unicode L* or N*)?"""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(out, out=out)
        _POWERS[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, one 0 after each; start and end of each text."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    flat = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(lens + 1) - 1
    return flat, ends - lens, ends


class Words:
    """Words (longest runs of letters and digits) of lower-cased texts: `hash` of each word, `row` it belongs to, and
    `first`: each row's first word, with one entry more at the end."""

    def __init__(self, texts: list[str | None], also: str = "", map_codes=None):
        texts = [(t or "").lower() for t in texts]
        flat, _, ends = codes(texts)
        inside = alnum_table()[flat]
        for c in also:  # further characters that may stand in a word
            inside |= flat == ord(c)
        if map_codes is not None:  # may replace characters of words and drop some, never a whole word
            flat, keep = map_codes(flat, inside)
            flat, inside = flat[keep], inside[keep]
            ends = np.flatnonzero(flat == 0)
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)  # the last code is a 0, so every word ends
        with np.errstate(over="ignore"):
            total = np.zeros(len(flat) + 1, dtype=np.uint64)
            np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(flat)), out=total[1:])
            raw = (total[self.end] - total[self.start]) * _powers(_BASE_INV, len(flat))[self.start]
        self.hash = mix(raw + (self.end - self.start).astype(np.uint64))
        self.row = np.searchsorted(ends, self.start)
        self.first = np.searchsorted(self.row, np.arange(len(texts) + 1))
        self.flat, self.texts = flat, texts

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of `k` words inside a row, and the index of its first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            g = np.zeros(n, dtype=np.uint64)
            for j in range(k):
                g = g * np.uint64(_BASE) + self.hash[j : j + n]
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 : k - 1 + n])
        return mix(g[at]), at


def char_grams(flat: np.ndarray, n: int) -> np.ndarray:
    """Hash of the `n` code points that end at each position (positions before n-1 hold a shorter run's hash)."""
    with np.errstate(over="ignore"):
        g = np.zeros(len(flat), dtype=np.uint64)
        for j in range(n):
            shifted = flat if j == 0 else np.concatenate([np.zeros(j, flat.dtype), flat[:-j]])[: len(flat)]
            g = g * np.uint64(_BASE) + shifted.astype(np.uint64)
    return mix(g + np.uint64(n))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's BIGINT."""
    return x.view(np.int64)
