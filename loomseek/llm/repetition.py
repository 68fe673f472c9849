"""Repeated content inside one document (problem 10).

Line-first cleaning. Every line is judged by four rules, none of which knows a
language:

punctuation
    the line stands in a run of at least RUN lines that are short and open,
    that is, end like no sentence, and are no headings, list items or rows;
navigation
    an open line that is cut into short parts by bars, arrows or dots;
boilerplate
    a line with a mark of rights, one of addresses only, or one that comes
    at least RUN times, digits aside;
repetition
    at least ``line_share`` of the sequences that end in it were said before.

Failing lines are removed. What a line loses to repetition is counted in
sequences of ``n`` consecutive words, each charged to the line in which it
ends, whether the line is removed or not; the other rules lose characters. A
document is rejected if it loses too much: ``reject_from`` of its sequences, or
``lost_from`` of its characters in removed lines. As every sequence is charged
once, the sum over the lines is the document's exact share of repeated
content, 1 - distinct sequences / all sequences, and ``found`` are the
documents rejected for that loss.

Words are maximal runs of letters in lower case. Null, empty and short texts
(fewer than ``least_words`` words) have a share of 0 and are never rejected.
Repeated rows give one row each in ``measure`` and once in all in ``found``.
Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseek.llm.words import ALPHA, flat, ngrams, word_hashes

RULES = ("punctuation", "navigation", "boilerplate", "repetition")
#: Short open lines in a row, and equal lines in a document, that fail.
RUN = 3
#: What ends a sentence, what divides the parts of a navigation line, marks of rights.
ENDS = ".!?…。！？:;\"'»”)"
BARS = re.compile(r"[|»›·•→←]|(?<=\s)[>/](?=\s)")
RIGHTS = re.compile(r"[©®™℗]")
_ADDRESSES = re.compile(r"(?:(?:https?://|www\.)\S+|\S+@\S+\.\S+|[\s,;|<>\[\]()])+")
_STRUCTURE = re.compile(r"(?:[*#=]+\s|[-+•]\s|\(?\w{1,3}[.)]\s|[|:!<{\[\\])")
_DIGITS = re.compile(r"\d+")

SCHEMA = (
    "words long, sequences long, distinct_sequences long, repeated_share double, n_lines int, open_lines int, punctuation_lines int, "
    "navigation_lines int, boilerplate_lines int, repeated_lines int, lost_share double, repetitive boolean, rejected boolean"
)
CLEANED = "cleaned string"


def _runs(flags: list[bool]) -> list[bool]:
    """Which flags stand in a run of at least RUN."""
    out, at = [], 0
    while at < len(flags):
        end = at
        while end < len(flags) and flags[end] == flags[at]:
            end += 1
        out += [flags[at] and end - at >= RUN] * (end - at)
        at = end
    return out


def judge(lines: list[str], seen: np.ndarray, every: np.ndarray, line_share: float, rules: tuple[str, ...]) -> list[str | None]:
    """The rule that each line fails, the first of RULES that applies. seen and every count the sequences charged to it."""
    bare = [x.strip() for x in lines]
    full = [i for i, s in enumerate(bare) if s]
    open_ = {i: bare[i][-1] not in ENDS for i in full}
    out: list[str | None] = [None] * len(lines)
    short: list[bool] = []
    if sum(open_.values()) >= RUN:
        short = _runs([open_[i] and len(bare[i].split(None, 3)) <= 3 and not _STRUCTURE.match(bare[i]) for i in full])
    kinds: list[str] = []
    often: set[str] = set()
    if len(full) >= RUN:
        kinds = [_DIGITS.sub("0", bare[i]) for i in full]
        if len(set(kinds)) < len(kinds):
            often = {kind for kind, n in Counter(kinds).items() if n >= RUN}

    def navigates(s: str) -> bool:
        parts = len(BARS.findall(s)) + 1
        return parts > 3 and s[0] != "|" and len(s.split()) <= 4 * parts

    def boilerplate(s: str, k: int) -> bool:
        return bool(RIGHTS.search(s)) or (bool(often) and kinds[k] in often) or (("@" in s or "www." in s or "http" in s) and bool(_ADDRESSES.fullmatch(s)))

    for k, i in enumerate(full):
        s = bare[i]
        if short and short[k] and "punctuation" in rules:
            out[i] = "punctuation"
        elif open_[i] and "navigation" in rules and navigates(s):
            out[i] = "navigation"
        elif "boilerplate" in rules and boilerplate(s, k):
            out[i] = "boilerplate"
        elif every[i] > 0 and seen[i] >= line_share * every[i] and "repetition" in rules:
            out[i] = "repetition"
    return out


def _clean(text: str, seen: np.ndarray, every: np.ndarray, line_share: float, rules: tuple[str, ...]) -> tuple:
    """Lines, open lines, lines by rule, the share of characters in removed lines, and the text without them."""
    lines = text.split("\n")
    verdict = judge(lines, seen, every, line_share, rules)
    size = [len(x.strip()) for x in lines]
    total, lost = sum(size), sum(n for n, v in zip(size, verdict) if v)
    by = Counter(verdict)
    n_open = sum(x.rstrip()[-1] not in ENDS for x in lines if x.strip())
    kept = "\n".join(x for x, v in zip(lines, verdict) if not v)
    return sum(n > 0 for n in size), n_open, *(by[r] for r in RULES), lost / total if total else 0.0, kept


def measure(
    df: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5, least_words: int = 50, line_share: float = 0.5, reject_from: float = 0.3, lost_from: float = 0.3,
    rules: tuple[str, ...] = RULES, cleaned: bool = False,
) -> DataFrame:
    """One row of line and repetition statistics for each row of df, with ``cleaned`` also the text without the removed lines.

    repetitive: the lines of a document of at least ``least_words`` words lose
    at least ``reject_from`` of its sequences. rejected: that, or at least
    ``lost_from`` of its characters stand in removed lines. ``rules`` names the
    rules that remove lines. A null text stays null in the cleaned text.
    """
    if unknown := set(rules) - set(RULES):
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    schema = f"{SCHEMA}, {CLEANED}" if cleaned else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lines = [[ALPHA.findall(x) for x in t.lower().split("\n")] for t in texts]
            per_doc = [[w for x in d for w in x] for d in lines]
            words = np.fromiter(map(len, per_doc), np.int64, len(texts))
            hashes, lengths = flat(([memo[w] for w in d] for d in per_doc), np.uint64)
            grams, owner, at = ngrams(hashes, lengths, n)
            order = np.lexsort((at, grams, owner))
            again = np.zeros(len(grams), bool)
            if len(order) > 1:
                a, b = order[:-1], order[1:]
                again[b] = (grams[a] == grams[b]) & (owner[a] == owner[b])
            total = np.bincount(owner, minlength=len(texts))
            # the line in which each sequence ends
            per_line, _ = flat(([len(x) for x in d] for d in lines), np.int64)
            line_of_word = np.repeat(np.arange(len(per_line)), per_line)
            line = line_of_word[at + n - 1] if len(at) else at
            line_all = np.bincount(line, minlength=len(per_line))
            line_seen = np.bincount(line[again], minlength=len(per_line))
            first = np.concatenate(([0], np.cumsum([len(d) for d in lines])))
            rows = [_clean(t, line_seen[first[i] : first[i + 1]], line_all[first[i] : first[i + 1]], line_share, rules) for i, t in enumerate(texts)]
            # a document's loss is what its lines were charged with
            owner_of_line = np.repeat(np.arange(len(texts)), np.diff(first))
            charged = np.bincount(owner_of_line, line_seen, len(texts)).astype(np.int64)
            share = np.where(total > 0, charged / np.maximum(total, 1), 0.0)
            lost = np.array([r[6] for r in rows], np.float64)
            repetitive = (words >= least_words) & (total > 0) & (total * reject_from <= charged + 1e-9) & ("repetition" in rules)
            rejected = repetitive | ((words >= least_words) & (lost >= lost_from))
            cols = [words, total, total - charged, share] + [np.array([r[k] for r in rows], np.int32) for k in range(6)] + [lost, repetitive, rejected]
            if cleaned:
                cols.append(pa.array([r[7] for r in rows], pa.string(), mask=batch.column(1).is_null().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols)], names=[key, *(x.split()[0] for x in schema.split(", "))])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, {schema}")


def found(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Keys of the documents rejected for what their lines lose to repetition."""
    return measure(df, text, key).filter("repetitive").select(F.col(key)).distinct()
