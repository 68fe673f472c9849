"""Cutting oversized texts at natural boundaries (problem 7).

A text is a tree: sections under headings (of Org, Markdown, wiki, HTML and
LaTeX), blocks between blank lines (fenced code, begin/end blocks, LaTeX
environments and preformatted text stay whole), list items under items by
their indents, lines, sentences, words, characters. Sibling subtrees are
merged from the bottom up while they fit; only a node that does not fit is
descended into. Every piece but the first begins with up to ``overlap``
characters of the end of the piece before, from a boundary on. The work grows
in proportion to the text, times the depth of its headings and items.

The pieces without their overlaps, one after another, are the trimmed text.
A null text gives no piece, an empty or blank one none either, and a text of
at most ``limit`` characters one. Repeated rows give their pieces once per row
in ``split`` and once in all in ``oversized``. Characters are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 300

_HEADING = re.compile(
    r"^(?:(?P<stars>\*+)[ ]+\S|(?P<hashes>#{1,6})[ ]+\S|(?P<equals>={2,6})(?!=)[^\n]*[^\n=](?P=equals)[ \t]*$|<h(?P<h>[1-6])\b|\\(?P<latex>part|chapter|section|subsection|subsubsection|paragraph)\b)",
    re.M | re.I,
)
#: Depths of LaTeX headings.
_DEPTHS = {"part": 1, "chapter": 2, "section": 3, "subsection": 4, "subsubsection": 5, "paragraph": 6}
_ITEM = re.compile(r"^(?P<indent>[ \t]*)(?:[-+•]|\d+[.)]|(?<=[ \t])\*|\\item\b|<li\b)(?=[ \t>\[])", re.M | re.I)
#: What opens a block that stays whole, and what closes it.
_OPEN = re.compile(r"^(?:(?P<fence>```|~~~)|#\+begin_(?P<block>\w+)|[ \t]*\\begin\{(?P<env>[^{}\n]+)\}|[ \t]*<(?P<pre>pre)\b)[^\n]*$", re.M | re.I)
_CLOSE = re.compile(r"^(?:(?P<fence>```|~~~)[ \t]*$|#\+end_(?P<block>\w+)[ \t]*$|[^\n]*\\end\{(?P<env>[^{}\n]+)\}[^\n]*$|[^\n]*</(?P<pre>pre)>[^\n]*$)", re.M | re.I)
#: Environments that only hold lists or sections, and deeper levels than this one count as this one.
_LOOSE, _DEEPEST = {"itemize", "enumerate", "description", "document", "abstract", "center", "quote"}, 40
_BLANK = re.compile(r"\n[ \t]*\n\s*")
_LINE = re.compile(r"\n+")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'»”)\]]*\s+")
_WORD = re.compile(r"\s+")

Span = tuple[int, int]


def _cut(span: Span, places: list[int]) -> list[Span]:
    marks = [span[0], *(p for p in places if span[0] < p < span[1]), span[1]]
    return list(zip(marks[:-1], marks[1:]))


def _kind(m: re.Match) -> str:
    return next(f"{k}:{v.lower()}" for k, v in m.groupdict().items() if v)


def whole_blocks(text: str) -> list[Span]:
    """Blocks that stay whole, in order; one that isn't closed is none."""
    ends: dict[str, list[Span]] = {}
    for m in _CLOSE.finditer(text):
        ends.setdefault(_kind(m), []).append(m.span())
    out: list[Span] = []
    at = 0
    for m in _OPEN.finditer(text):
        if m.start() < at or (m.group("env") or "").lower() in _LOOSE:
            continue
        mine = ends.get(_kind(m), [])
        # a fence closes on a later line, the others perhaps on the same
        k = bisect_left(mine, (m.end() if m.group("fence") else m.start(), 0))
        if k < len(mine):
            at = mine[k][1]
            out.append((m.start(), at))
    return out


class _Marks:
    """Places with depths, outside the blocks that stay whole."""

    def __init__(self, found: list[Span], blocks: list[Span]):
        starts = [a for a, _ in blocks]
        inside = lambda p: (k := bisect_right(starts, p)) and p < blocks[k - 1][1]
        kept = [(p, min(d, _DEEPEST)) for p, d in found if not inside(p)]
        self.places, self.depths = [p for p, _ in kept], [d for _, d in kept]

    def shallowest(self, s: Span) -> list[int]:
        """Of the places inside a span, but for its start, those of the least depth."""
        a, b = bisect_right(self.places, s[0]), bisect_left(self.places, s[1])
        least = min(self.depths[a:b], default=0)
        return [p for p, d in zip(self.places[a:b], self.depths[a:b]) if d == least]


class _Tree:
    """Children of a span of the text at each level of the tree."""

    def __init__(self, text: str):
        self.text = text
        self.blocks = whole_blocks(text)
        self.starts = [a for a, _ in self.blocks]
        headings = [(m.start(), self._depth(m)) for m in _HEADING.finditer(text)]
        items = [(m.start(), len(m.group("indent").expandtabs())) for m in _ITEM.finditer(text)]
        again = [_Marks(headings, self.blocks).shallowest, _Marks(items, self.blocks).shallowest]
        by = [lambda s, r=r: [m.end() for m in r.finditer(text, *s)] for r in (_LINE, _SENTENCE, _WORD)]
        #: (children, whether a child may have further children of the level)
        self.levels: list[tuple[Callable[[Span], list[int]], bool]] = [(again[0], True), (self._split, False), (again[1], True), *((f, False) for f in by)]

    @staticmethod
    def _depth(m: re.Match) -> int:
        g = m.groupdict()
        return len(g["stars"] or g["hashes"] or "") or len(g["equals"] or " ") - 1 or int(g["h"] or 0) or _DEPTHS[g["latex"].lower()]

    def _split(self, s: Span) -> list[int]:
        """Blank lines outside whole blocks, and the ends of those."""
        inside = self.blocks[bisect_left(self.starts, s[0]) : bisect_left(self.starts, s[1])]
        inside = [f for f in inside if f[1] <= s[1]]
        starts = [a for a, _ in inside]
        free = [p for p in (m.end() for m in _BLANK.finditer(self.text, *s)) if not ((k := bisect_left(starts, p)) and p < inside[k - 1][1])]
        return sorted({*free, *(p for f in inside for p in f)})

    def pack(self, span: Span, room: int, level: int = 0) -> list[Span]:
        """Consecutive spans of at most ``room`` characters."""
        if span[1] - span[0] <= room:
            return [span]
        if level == len(self.levels):
            return _cut(span, list(range(span[0] + room, span[1], room)))
        children, again = self.levels[level]
        places = [p for p in children(span) if span[0] < p < span[1]]
        if not places:
            return self.pack(span, room, level + 1)
        out: list[Span] = []
        for child in _cut(span, places):
            for part in self.pack(child, room, level if again else level + 1):
                if out and part[1] - out[-1][0] <= room:
                    out[-1] = (out[-1][0], part[1])
                else:
                    out.append(part)
        return out


def _back(text: str, start: int, low: int) -> int:
    """Where the repeated end begins: the first line, sentence or word boundary from low on."""
    for rule in (_LINE, _SENTENCE, _WORD):
        for m in rule.finditer(text, low, start):
            if m.end() < start:
                return m.end()
    return low


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(characters repeated from the piece before, piece) in order."""
    text = (text or "").strip()
    if len(text) <= limit:
        return [(0, text)] if text else []
    out = []
    for start, end in _Tree(text).pack((0, len(text)), limit - overlap):
        begin = _back(text, start, max(0, start - overlap)) if start and overlap else start
        out.append((start - begin, text[begin:end]))
    return out


def split(df: DataFrame, text: str, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(keys..., ord, repeated, piece), ord from 0."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ords, repeated, out = [], [], [], []
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                for k, (again, piece) in enumerate(pieces(t, limit, overlap)):
                    rows.append(i)
                    ords.append(k)
                    repeated.append(again)
                    out.append(piece)
            take = pa.array(rows, pa.int64())
            cols = [batch.column(k).take(take) for k in range(len(keys))]
            cols += [pa.array(ords, pa.int32()), pa.array(repeated, pa.int32()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "ord", "repeated", "piece"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text).mapInArrow(run, f"{kinds}, ord int, repeated int, piece string")


def oversized(df: DataFrame, text: str, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Keys of the records that had to be cut. Records short enough before trimming are left out in the scan."""
    cut = split(df.filter(F.length(text) > limit), text, keys, limit, overlap)
    return cut.filter("ord > 0").select(*keys).distinct()
