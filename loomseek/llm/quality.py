"""Text quality per document from labelled lines (problem 4).

Every line (a long one sentence by sentence) is described by a few counted
statistics and labelled prose, list, table or junk by a hidden Markov model;
the labels' shares of the characters describe the document. The model is
trained here, on a bounded sample of texts (SAMPLE rows) whose clear lines are
labelled by plain rules; it then labels the unclear ones by their statistics
and their neighbours. Tags and commands of markup don't count as text.

Null and empty texts have zero lines and shares of 0; they are in no case of
``not_prose``, like all texts of fewer than LEAST characters. Lines of any
length are read whole. Repeated rows give repeated statistics.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseek.llm.words import ALPHA, Memo, fold

PROSE, LIST, TABLE, JUNK = range(4)
LABELS = ("prose", "list", "table", "junk")
LEAST = 40
SAMPLE = 2000
#: More common words than this are refused, for they are sent to every worker.
MAX_COMMON = 100_000

_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_ENTITY = re.compile(r"&(?:#\w+|[a-zA-Z]\w*);")
_COMMAND = re.compile(r"\\[a-zA-Z]+\*?|[{}]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_BULLET = re.compile(r"\s*(?:[-+*•]\s|\[[ xX-]\]\s)")
_NUMBER = re.compile(r"\s*\(?\d{1,4}[.)]\s")
#: What divides the fields of a row, beside a comma without a space.
_DELIMITERS = ("|", ";", "\t", "....", "::", "=>", "--")
_COMMA = re.compile(r",(?=\S)")
_BLANK = re.compile(r"\n[ \t]*\n")
_DIGITS = re.compile(r"\d+")
_MARK = re.compile(r"\s*(?:[-+*•]|\(?\w{1,4}[.)])")


def plain(text: str) -> str:
    """The text without tags, entities and commands."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    if "\\" in text:
        text = _COMMAND.sub(" ", text)
    return text


def _even(line: str) -> bool:
    """A line of plain words, as in a paragraph broken over lines."""
    s = line.strip()
    spaces = s.count(" ")
    if spaces < 4 or _BULLET.match(line) or _NUMBER.match(line) or _delimiters(s):
        return False
    return len(s) - spaces - sum(map(len, ALPHA.findall(s))) <= 0.08 * len(s)


def _delimiters(s: str) -> int:
    n = sum(map(s.count, _DELIMITERS))
    return n + len(_COMMA.findall(s)) if "," in s else n


def units(text: str) -> list[str]:
    """The sentences of the lines that are not blank; broken lines of plain words are joined. A list's mark stays with its item."""
    out, held = [], ""
    lines = text.split("\n")
    even = [_even(x) for x in lines] if len(lines) > 1 else [False]
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        if even[i] and i + 1 < len(lines) and even[i + 1] and line.rstrip()[-1] not in ".!?…:;":
            held += line.strip() + " "
            continue
        line, held = held + line, ""
        parts = [s for s in _SENTENCE.split(line) if s.strip()]
        if len(parts) > 1 and _MARK.fullmatch(parts[0]):
            parts[:2] = [f"{parts[0]} {parts[1]}"]
        out += parts
    return out


def split_lines(text: str) -> tuple[int, int]:
    """Lines that are not blank, and those that end like a sentence."""
    ends = [x.rstrip()[-1] in ".!?…»\"”" for x in text.split("\n") if x.strip()]
    return len(ends), sum(ends)


class Common:
    """Common words of each language, without diacritics."""

    def __init__(self, rows: list[tuple[str, str]]):
        if len(rows) > MAX_COMMON:
            raise ValueError(f"more than {MAX_COMMON} common words")
        self.langs = sorted({lang for lang, _ in rows})
        self.masks: dict[str, int] = {}
        for lang, word in rows:
            w = fold(word)
            self.masks[w] = self.masks.get(w, 0) | 1 << self.langs.index(lang)

    def packed(self) -> Memo:
        """Word -> its languages as counters of 32 bits, so that sums count each language."""
        bits = {m: sum(1 << 32 * i for i in range(len(self.langs)) if m >> i & 1) for m in set(self.masks.values()) | {0}}
        return Memo(lambda w: bits[self.masks.get(fold(w), 0)], 300_000)


def read_common(df: DataFrame) -> Common:
    """From a table of lang and word, whose size is checked."""
    rows = df.select("lang", "word").filter("lang is not null and word is not null").distinct().limit(MAX_COMMON + 1).collect()
    return Common(sorted((r["lang"], r["word"]) for r in rows))


#: Sizes of the features of ``describe``; the first joins the bins of common share (6) and words (4), as a share says more of more words.
SIZES = (24, 3, 4, 3, 3, 3, 3)


def describe(unit: str, packed: Memo, words: list[str] | None = None) -> tuple[tuple[int, ...], int, int, int, int]:
    """Binned statistics of a line; its words, letters, digits and common words. ``words`` are its words, if they are known."""
    if words is None:
        words = ALPHA.findall(unit)
    n = len(words)
    letters = sum(map(len, words))
    digits = sum(map(len, _DIGITS.findall(unit)))
    counts = sum(map(packed.__getitem__, words))
    common = 0
    while counts:
        if (c := counts & 0xFFFFFFFF) > common:
            common = c
        counts >>= 32
    s = unit.strip()
    size = len(s) - s.count(" ") or 1
    symbols = max(0, size - letters - digits)
    marker = 1 if _BULLET.match(unit) else 2 if _NUMBER.match(unit) else 0
    end = 1 if s[-1:] in ".!?…»\"”" else 2 if s[-1:] in ",;:" else 0
    delimiters = _delimiters(s)
    code = (
        4 * bisect((0.06, 0.15, 0.24, 0.34, 0.45), common / n if n else 0.0) + bisect((2, 5, 9), n),
        marker,
        bisect((0.07, 0.15, 0.35), symbols / size),
        bisect((0.05, 0.25), digits / size),
        end,
        bisect((1, 3), delimiters),
        bisect((2.5, 8.5), letters / n if n else 0.0),
    )
    return code, n, letters, digits, common


def clear_label(code: tuple[int, ...]) -> int | None:
    """Label of a line whose kind is plain from its statistics."""
    (common, words), (marker, symbols, digits, _, delimiters, length) = divmod(code[0], 4), code[1:]
    if marker and symbols < 3 and digits < 2:
        return LIST
    if delimiters == 2 or digits == 2:
        return TABLE
    if common >= 4 and words >= 2 and symbols < 2 and digits < 2:
        return PROSE
    if common == 0 or length == 2 or symbols == 3 or (common == 1 and words == 3):
        return JUNK
    return None


class LineModel:
    """Hidden Markov model over the lines of a text."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        self.start, self.step = start.tolist(), step.tolist()
        self.emit = Memo(lambda code: [float(sum(e[k, c] for e, c in zip(emit, code))) for k in range(4)], 100_000)
        self.parts = start, step, emit

    def __reduce__(self):
        return LineModel, self.parts

    @classmethod
    def fit(cls, texts: list[list[tuple[int, ...]]], rounds: int = 2) -> LineModel:
        """From the lines' codes of each text: first the clear lines, then as labelled with them."""
        labelled = [(codes, [clear_label(c) for c in codes]) for codes in texts]
        model = None
        for _ in range(rounds + 1):
            start, step = np.ones(4), np.ones((4, 4)) + 4 * np.eye(4)
            emit = [np.ones((4, n)) for n in SIZES]
            for codes, labels in labelled:
                for i, (code, label) in enumerate(zip(codes, labels)):
                    if label is None:
                        continue
                    for e, c in zip(emit, code):
                        e[label, c] += 1
                    if not i:
                        start[label] += 1
                    elif labels[i - 1] is not None:
                        step[labels[i - 1], label] += 1
            log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
            model = cls(log(start), log(step), [log(e) for e in emit])
            # clear lines keep their labels, the others get the model's
            labelled = [(codes, [clear_label(c) if clear_label(c) is not None else m for c, m in zip(codes, model.label(codes))]) for codes in texts]
        return model

    def label(self, codes: list[tuple[int, ...]]) -> list[int]:
        """The most likely labels."""
        if not codes:
            return []
        emit, step = self.emit, self.step
        score = [a + b for a, b in zip(self.start, emit[codes[0]])]
        back = []
        for code in codes[1:]:
            e, now, came = emit[code], [], []
            a, b, c, d = score
            for k in range(4):
                top, best = a + step[0][k], 0
                if (x := b + step[1][k]) > top:
                    top, best = x, 1
                if (x := c + step[2][k]) > top:
                    top, best = x, 2
                if (x := d + step[3][k]) > top:
                    top, best = x, 3
                came.append(best)
                now.append(top + e[k])
            back.append(came)
            score = now
        at = max(range(4), key=score.__getitem__)
        out = [at]
        for came in reversed(back):
            out.append(at := came[at])
        return out[::-1]


def draw(df: DataFrame, key: str, sample: int) -> list:
    """The rows with the smallest hashes, about ``sample`` of them and at most twice as many; repeated rows once.

    The draw depends on the rows alone, not on their partitions.
    """
    span = 1 << 30
    share = min(1.0, sample / max(1, df.count()))
    first, rest = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(span)), F.xxhash64(*[F.col(c) for c in df.columns])
    drawn = df.filter(first < int(share * span)).distinct().orderBy(first, rest).limit(2 * sample).collect()
    return sorted(drawn, key=lambda r: tuple(str(v) for v in r))


def train(df: DataFrame, text: str, key: str, common: Common, sample: int = SAMPLE) -> LineModel:
    """A model from about ``sample`` texts, drawn by the hash of their keys."""
    rows = draw(df.filter(F.col(text).isNotNull()).select(key, text), key, sample)
    packed = common.packed()
    return LineModel.fit([[describe(u, packed)[0] for u in units(plain(r[text]))] for r in rows])


STATS = (
    "characters int, lines int, words int, mean_word_length double, symbol_ratio double, punctuated_lines double, "
    "common_share double, prose_share double, list_share double, table_share double, junk_share double"
)


def measure(df: DataFrame, keys: list[str], text: str, model: LineModel, common: Common) -> DataFrame:
    """Statistics of each text and the shares of its characters by label."""
    shared = df.sparkSession.sparkContext.broadcast((model, common))

    def row(t: str, model: LineModel, packed: Memo) -> tuple:
        clean = plain(t)
        lines = units(clean)
        n_lines, n_ends = split_lines(clean)
        got = [describe(u, packed) for u in lines]
        size = [len(u.strip()) for u in lines]
        total = sum(size)
        shares = [0, 0, 0, 0]
        for label, n in zip(model.label([g[0] for g in got]), size):
            shares[label] += n
        words = sum(g[1] for g in got)
        letters, digits = sum(g[2] for g in got), sum(g[3] for g in got)
        solid = sum(len(u) - u.count(" ") for u in lines) or 1
        return (
            len(t), n_lines, words, letters / words if words else 0.0, max(0.0, (solid - letters - digits) / solid) if lines else 0.0,
            n_ends / n_lines if n_lines else 0.0, sum(g[4] for g in got) / words if words else 0.0,
            *(s / total if total else 0.0 for s in shares),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, common = shared.value
        packed = common.packed()
        for batch in batches:
            rows = [row(t or "", model, packed) for t in batch.column(len(keys)).to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * 11
            kinds = [pa.int32()] * 3 + [pa.float64()] * 8
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*keys, *(x.split()[0] for x in STATS.split(", "))])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text).mapInArrow(run, f"{kinds}, {STATS}")


def not_prose(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the texts of which fewer than half of the characters are prose."""
    return stats.filter((F.col("characters") >= LEAST) & (F.col("prose_share") < 0.5)).select(*keys).distinct()
