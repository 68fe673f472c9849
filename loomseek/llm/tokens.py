"""Token ids of a public byte-level BPE vocabulary (problem 8).

The text is cut by the vocabulary's split pattern; each piece is merged by
rank. A segment tree over the piece's byte positions stores the leftmost
minimum rank of the neighbouring pairs, so each merge costs a few logarithmic
point updates on the live neighbours and a piece of n bytes n log n steps.
Pieces that were met before come from a memo in the worker.

Null and empty texts give an empty list; no special token is ever produced,
so the string of one in a text is ordinary text. Repeated rows give repeated
results; a text may be of any length.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from loomseek.llm.words import Memo

#: The split pattern of the vocabulary, as its files state it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same split in the faster standard module. The two differ only in texts
#: that hold a numeral other than a decimal digit, or a separator of U+001C-1F.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ODD = regex.compile(r"[\p{Nl}\p{No}\x1c-\x1f]")
_FULL = regex.compile(PATTERN)

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_NONE = 1 << 60


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Rank of each token's bytes, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class PairTree:
    """Leftmost minimum over positions, with point updates."""

    def __init__(self, values: list[int]):
        self.size = 1 << max(0, (len(values) - 1).bit_length())
        self.low = [_NONE] * self.size + values + [_NONE] * (self.size - len(values))
        for i in range(self.size - 1, 0, -1):
            self.low[i] = min(self.low[2 * i], self.low[2 * i + 1])

    def set(self, at: int, value: int) -> None:
        low = self.low
        i = at + self.size
        low[i] = value
        while i > 1:
            i >>= 1
            best = min(low[2 * i], low[2 * i + 1])
            if low[i] == best:
                break
            low[i] = best

    def first(self) -> tuple[int, int]:
        """Position and value of the leftmost minimum."""
        low, i = self.low, 1
        value = low[1]
        while i < self.size:
            i *= 2
            if low[i] != value:
                i += 1
        return i - self.size, value


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # where the token that starts here ends
    before = list(range(-1, n - 1))  # where the token before this one starts
    rank = lambda a, c: ranks.get(piece[a:c], _NONE)
    tree = PairTree([rank(i, i + 2) for i in range(n - 1)] or [_NONE])
    while True:
        at, value = tree.first()
        if value == _NONE:
            break
        middle = end[at]
        end[at] = stop = end[middle]
        if middle < n - 1:
            tree.set(middle, _NONE)
        if stop < n:
            before[stop] = at
            tree.set(at, rank(at, end[stop]))
        else:
            tree.set(at, _NONE)
        if at:
            tree.set(before[at], rank(before[at], stop))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class Encoder:
    """Encodes texts; built once in a worker."""

    def __init__(self, path: str = VOCABULARY):
        self.ranks = load_ranks(path)
        self.memo = Memo(lambda piece: merge(piece.encode("utf-8", "replace"), self.ranks), 400_000)

    def pieces(self, text: str) -> list[str]:
        if text.isascii() and not _CONTROL.search(text):
            return _FAST.findall(text)
        return (_FULL if _ODD.search(text) else _FAST).findall(text)

    def extend(self, out: array, text: str) -> int:
        """Append the text's ids to out; gives their number."""
        at = len(out)
        for ids in map(self.memo.__getitem__, self.pieces(text)):
            out.extend(ids)
        return len(out) - at

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.extend(out, text)
        return out.tolist()


_CONTROL = re.compile("[\x1c-\x1f]")


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row of df; other columns are dropped.

    ``vocabulary`` is a rank file on the driver, which sends it to the workers.
    """
    path = os.fspath(vocabulary)
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(SparkFiles.get(name))
        for batch in batches:
            out, offsets = array("i"), np.zeros(batch.num_rows + 1, np.int32)
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    encoder.extend(out, t)
                offsets[i + 1] = len(out)
            values = pa.array(np.frombuffer(out, dtype=np.int32) if len(out) else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[key, ids])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, {ids} array<int>")
