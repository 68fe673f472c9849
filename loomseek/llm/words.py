"""Words and n-gram hashes of whole batches of texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from itertools import chain

import numpy as np
import xxhash

#: Maximal runs of letters or digits; maximal runs of letters.
ALNUM = re.compile(r"[^\W_]+")
ALPHA = re.compile(r"[^\W\d_]+")

_MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ** 3) % 2**64 | 1 for k in range(64)], dtype=np.uint64)


def fold(text: str) -> str:
    """Lower case without diacritics."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


class Memo(dict):
    """A dictionary that computes a missing value once and forgets all when it grows past its limit."""

    def __init__(self, compute, limit: int = 1_000_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def word_hashes() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def flat(lists: Iterable[list], dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values one after another, and the length of each list."""
    lists = list(lists)
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    values = np.fromiter(chain.from_iterable(lists), dtype=dtype, count=int(lengths.sum()))
    return values, lengths


def ngrams(values: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every n consecutive values inside one text.

    Returns the hashes, the text of each and the place of each in ``values``.
    """
    owner = np.repeat(np.arange(len(lengths)), lengths)
    total = len(values) - n + 1
    if total <= 0:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none
    inside = np.flatnonzero(owner[:total] == owner[n - 1 :])
    acc = np.zeros(len(inside), np.uint64)
    for k in range(n):
        acc += values[inside + k] * _MULTIPLIERS[k]
    return mix(acc), owner[inside], inside
