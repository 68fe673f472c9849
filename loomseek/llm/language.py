"""Language of documents and of their stretches (problem 3).

Error-correcting output codes: every language (and "none" for text in no known
one) has a codeword of 15 bits, any two of which differ in 8. Each bit is
predicted by a logistic classifier over the character n-grams of the words;
a stretch gets the language of the codeword with the smallest loss, bits
weighted by how well they did in training. A small gap to the second language
flags ambiguity. The classifiers are trained here, on a bounded sample of
labelled rows (SAMPLE) whose label agrees with the common words of the line.

Only running prose is judged, as the line model of ``quality`` labels it; a
stretch is a run of consecutive words with the same decision, and "running"
if enough of them are common words of that language. Null and empty texts have
no stretch and no language. Repeated rows give repeated results, except in
``mislabelled``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseek.llm import quality
from loomseek.llm.words import ALPHA, Memo, fold

SAMPLE = 3000
_FEATURES = 1 << 15
#: Words on either side that a word is judged with.
_REACH = 4
#: A run shorter than this joins its neighbour; share of common words that running text has.
_SHORT, _RUNNING = 4, 0.2

#: At least eight words with nothing but spaces and commas between them.
_STRING = re.compile(r"(?:[^\W\d_]+[, ]+){7,}[^\W\d_]+")

#: English names of the languages.
NAMES = {
    "de": "german",
    "en": "english",
    "es": "spanish",
    "fr": "french",
    "nl": "dutch",
    "pt": "portuguese",
    "ru": "russian",
    "sv": "swedish",
}


def codewords(classes: int) -> np.ndarray:
    """Rows of a Hadamard matrix without its constant column: +-1, any two rows differ in 8 of 15."""
    h = np.ones((1, 1), np.int64)
    while len(h) < max(16, classes + 1):
        h = np.block([[h, h], [h, -h]])
    return h[1 : classes + 1, 1:]


def _grams(word: str) -> np.ndarray:
    s = f"^{word}$"
    got = {s} | {s[i : i + n] for n in (1, 2, 3, 4) for i in range(len(s) - n + 1)}
    return np.fromiter((xxhash.xxh32_intdigest(g) % _FEATURES for g in got), np.int64, len(got))


class Languages:
    """Trained classifiers: a score of every bit for every word."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.weights, self.bias, self.trust = langs, weights, bias, trust
        self.code = codewords(len(langs) + 1)

    def score(self, word: str) -> np.ndarray:
        return self.weights[_grams(fold(word))].mean(axis=0)

    def losses(self, scores: np.ndarray) -> np.ndarray:
        """Weighted loss of every class (the last is none) for rows of mean scores."""
        f = (scores + self.bias).astype(np.float32)
        near = np.log1p(np.exp(-np.abs(f)))  # log(1 + exp(-m f)) is this plus max(0, -m f)
        trust = self.trust.astype(np.float32)
        out = (near * trust) @ np.ones((len(trust), len(self.code)), np.float32)
        out += (np.maximum(-f, 0) * trust) @ (self.code > 0).T.astype(np.float32)
        out += (np.maximum(f, 0) * trust) @ (self.code < 0).T.astype(np.float32)
        return out

    @classmethod
    def fit(cls, langs: list[str], lines: list[tuple[list[str], int]], epochs: int = 60, rate: float = 1.5) -> Languages:
        """From (words, class) of lines; class len(langs) is none."""
        rng = np.random.default_rng(5)
        vocabulary: dict[str, int] = {}
        windows, classes = [], []
        for words, c in lines:
            ids = [vocabulary.setdefault(fold(w), len(vocabulary)) for w in words]
            for i in range(0, len(ids), 6):
                part = ids[i : i + int(rng.integers(3, 10))]
                if len(part) >= 3:
                    windows.append(part)
                    classes.append(c)
        code = codewords(len(langs) + 1)
        weights, bias = np.zeros((_FEATURES, code.shape[1])), np.zeros(code.shape[1])
        if not windows:
            return cls(langs, weights, bias, np.ones(code.shape[1]) / code.shape[1])
        y = np.array(classes)
        share = 1.0 / np.bincount(y, minlength=len(langs) + 1).clip(1)[y]
        share *= len(y) / share.sum()
        target = code[y]
        grams = [_grams(w) for w in vocabulary]
        gram, glen = np.concatenate(grams), np.array([len(g) for g in grams])
        gstart = np.cumsum(glen) - glen
        gword = np.repeat(np.arange(len(grams)), glen)
        word, wlen = np.concatenate([np.array(w) for w in windows]), np.array([len(w) for w in windows])
        wstart, wrow = np.cumsum(wlen) - wlen, np.repeat(np.arange(len(windows)), wlen)
        past = np.full_like(weights, 1e-3)
        for _ in range(epochs):
            per_word = np.add.reduceat(weights[gram], gstart, axis=0) / glen[:, None]
            f = np.add.reduceat(per_word[word], wstart, axis=0) / wlen[:, None] + bias
            slope = -target / (1 + np.exp(np.clip(target * f, -30, 30))) * share[:, None] / len(y)
            spread = (slope / wlen[:, None])[wrow]
            for b in range(code.shape[1]):
                per = np.bincount(word, spread[:, b], len(grams)) / glen
                g = np.bincount(gram, per[gword], _FEATURES) + 1e-7 * weights[:, b]
                past[:, b] += (1e3 * g) ** 2
                weights[:, b] -= 30 * rate * (1e3 * g) / np.sqrt(past[:, b]) / 10
            bias -= rate * slope.sum(axis=0)
        right = ((target * f) > 0).mean(axis=0)
        trust = np.log((right + 1e-3) / (1 - right + 1e-3)).clip(0.1)
        return cls(langs, weights.astype(np.float32), bias, trust / trust.sum() * 3)


def named(label: str | None, langs: list[str]) -> str | None:
    """The language that a label names."""
    if label is None:
        return None
    x = label.lower()
    part = x.replace("_", "-").split("-")[0]
    if part in langs:
        return part
    return next((c for c in langs if NAMES.get(c) == x), None)


def train(df: DataFrame, text: str, label: str, key: str, common: quality.Common, sample: int = SAMPLE) -> Languages:
    """Classifiers from about ``sample`` labelled texts, drawn by the hash of their keys."""
    rows = quality.draw(df.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(key, text, label), key, sample)
    langs, lines = common.langs, []
    masks = common.masks
    for r in rows:
        lang = named(r[label], langs)
        for u in quality.units(quality.plain(r[text])):
            words = ALPHA.findall(u)
            if len(words) < 4:
                continue
            counts = [0] * len(langs)
            for w in words:
                m = masks.get(fold(w), 0)
                for i in range(len(langs)):
                    counts[i] += m >> i & 1
            best = max(range(len(langs)), key=counts.__getitem__)
            if counts[best] >= 0.35 * len(words) and langs[best] == lang:
                lines.append((words, best))
            elif counts[best] <= 0.04 * len(words):
                lines.append((words, len(langs)))
    return Languages.fit(langs, lines)


def _runs(label: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal labels."""
    if not len(label):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero((label[1:] != label[:-1]) | (unit[1:] != unit[:-1])) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(label)]))


class Judge:
    """The worker's side: stretches of many texts at once."""

    def __init__(self, languages: Languages, model: quality.LineModel, common: quality.Common):
        self.l, self.model, self.common = languages, model, common
        self.packed = common.packed()
        self.rows = np.zeros((1024, languages.code.shape[1]), np.float32)
        self.masks = np.zeros(1024, np.int64)
        self.ids = Memo(self._new, 1 << 62)  # cleared between batches only

    def _new(self, word: str) -> int:
        i = len(self.ids)
        if i == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.masks = np.concatenate((self.masks, np.zeros_like(self.masks)))
        self.rows[i] = self.l.score(word)
        self.masks[i] = self.common.masks.get(fold(word), 0)
        return i

    def _prose_in(self, line: str) -> Iterator[str]:
        """Running text inside a line of another kind."""
        for m in _STRING.finditer(line):
            code, n, _, _, common = quality.describe(m.group(), self.packed)
            if common >= 0.34 * n:
                yield m.group()

    def stretches(self, texts: list[str | None]) -> list[tuple[int, int, int, str, float, bool, bool]]:
        """(text, first word, words, language, confidence, running, ambiguous); words count within the prose."""
        if len(self.ids) > 300_000:
            self.ids.clear()
        ids: list[int] = []
        lens: list[int] = []
        owner: list[int] = []
        for t, text in enumerate(texts):
            if not text:
                continue
            lines = quality.units(quality.plain(text))
            words = [ALPHA.findall(u) for u in lines]
            labels = self.model.label([quality.describe(u, self.packed, w)[0] for u, w in zip(lines, words)])
            for u, w, label in zip(lines, words, labels):  # a line of prose is one sentence
                for part in [w] if label == quality.PROSE else map(ALPHA.findall, self._prose_in(u)):
                    if part:
                        ids += map(self.ids.__getitem__, part)
                        lens.append(len(part))
                        owner.append(t)
        if not ids:
            return []
        at, unit_len = np.array(ids), np.array(lens)
        unit = np.repeat(np.arange(len(lens)), unit_len)
        first = np.repeat(np.cumsum(unit_len) - unit_len, unit_len)
        n = np.arange(len(at))
        low, high = np.maximum(n - _REACH, first), np.minimum(n + _REACH + 1, first + unit_len[unit])
        total = np.concatenate((np.zeros((1, self.rows.shape[1])), np.cumsum(self.rows[at], axis=0, dtype=np.float64)))
        loss = self.l.losses((total[high] - total[low]) / (high - low)[:, None])
        label = np.argmin(loss, axis=1)
        # short runs inside a sentence join what is before them, or else behind them
        start, end = _runs(label, unit)
        for a, b in zip(start, end):
            if b - a < _SHORT:
                if a and unit[a - 1] == unit[a]:
                    label[a:b] = label[a - 1]
                elif b < len(label) and unit[b] == unit[a]:
                    label[a:b] = label[b]
        text_of = np.array(owner)[unit]
        start, end = _runs(label, text_of)
        best = loss.min(axis=1)
        sure = 1.0 / np.exp(best[:, None] - loss).sum(axis=1)
        rest = loss.copy()
        rest[n, np.argmin(loss, axis=1)] = np.inf
        second = rest.min(axis=1) - best
        hit = (self.masks[at] >> np.minimum(label, len(self.l.langs) - 1)) & 1
        sums = [np.concatenate(([0], np.cumsum(x))) for x in (sure, second, hit)]
        words_before = np.cumsum(np.bincount(text_of, minlength=len(texts))) - np.bincount(text_of, minlength=len(texts))
        out = []
        for a, b in zip(start.tolist(), end.tolist()):
            lang = self.l.langs[label[a]] if label[a] < len(self.l.langs) else None
            if lang is None:
                continue
            t, size = int(text_of[a]), b - a
            conf, gap, share = ((s[b] - s[a]) / size for s in sums)
            out.append((t, a - int(words_before[t]), size, lang, float(conf), bool(share >= _RUNNING), bool(gap < 0.5)))
        return out


STRETCH = "field string, first_word int, words int, lang string, confidence double, running boolean, ambiguous boolean"


def stretches(df: DataFrame, keys: list[str], fields: list[str], languages: Languages, model: quality.LineModel, common: quality.Common) -> DataFrame:
    """Every stretch of the fields: (keys..., field, first_word, words, lang, confidence, running, ambiguous)."""
    shared = df.sparkSession.sparkContext.broadcast((languages, model, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.bool_()]
        for batch in batches:
            for k, field in enumerate(fields):
                rows = judge.stretches(batch.column(len(keys) + k).to_pylist())
                cols = list(zip(*rows)) if rows else [[]] * 7
                take = pa.array(cols[0], pa.int64())
                out = [batch.column(i).take(take) for i in range(len(keys))]
                out += [pa.array(c, t) for c, t in zip(([field] * len(rows), *cols[1:]), kinds)]
                yield pa.RecordBatch.from_arrays(out, names=[*keys, *(x.split()[0] for x in STRETCH.split(", "))])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, *fields).mapInArrow(run, f"{kinds}, {STRETCH}")


def documents(found: DataFrame, keys: list[str], records: DataFrame | None = None) -> DataFrame:
    """(keys..., lang, confidence, words): the language of most words of each record.

    With ``records`` every key of those has a row; one without running text in
    a known language has no language, a confidence of 0 and 0 words.
    """
    per = found.groupBy(*keys, "lang").agg(F.sum("words").alias("words"), (F.sum(F.col("words") * F.col("confidence")) / F.sum("words")).alias("confidence"))
    best = per.groupBy(*keys).agg(F.max_by(F.struct("lang", "confidence", "words"), F.struct("words", "confidence", "lang")).alias("b"))
    if records is not None:
        best = records.select(*keys).distinct().join(best, keys, "left")
    return best.select(*keys, "b.lang", F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("b.words", F.lit(0)).cast("bigint").alias("words"))


def mislabelled(found: DataFrame, keys: list[str], label: str, langs: list[str], least: int = 8) -> DataFrame:
    """(keys..., lang): running stretches of at least ``least`` words in a language that the label doesn't name."""
    x = F.lower(F.col(label))
    part = F.split(x, "[-_]", 2)[0]
    is_named = F.coalesce((part == F.col("lang")) | (x == F.create_map(*[F.lit(v) for c in langs for v in (c, NAMES.get(c, c))])[F.col("lang")]), F.lit(False))
    return found.filter((F.col("words") >= least) & F.col("running") & ~is_named).select(*keys, "lang").distinct()
