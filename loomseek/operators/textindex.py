"""Inverted index over (title, body) and BM25 search in it.

postings: one row for each term of a target: term, key, col (0 title, 1 body),
positions. doc_stats: key, tokens. Both are plain tables. Postings are written
in buckets by the first two characters of the term, so a word or a prefix of
at least two characters reads one bucket, and of it the row groups that hold
it; the texts are never read.

Every query word is a phrase whose last token is a prefix, inside one column;
the words must all match, in any column. A word without a letter or digit
matches nothing. Null titles and bodies have no tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek.functions import text

K1, B = 1.2, 0.75
BUCKETS, _HEAD = 64, 2


def query_words(query: str) -> list[list[str]]:
    """Tokens of each word of the query."""
    return [text.tokenize(w) for w in query.split()]


def match_expression(query: str) -> str:
    """The query as a full-text expression."""
    return " AND ".join('"' + w.replace('"', '""') + '"*' for w in query.split())


def postings(targets: DataFrame) -> DataFrame:
    """(term, key, col, positions), positions from 0. Keys must be unique; a row's terms are gathered where the row is, without a shuffle."""
    kind = targets.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for col in (0, 1):
                rows, terms, places = [], [], []
                for i, tokens in enumerate(batch.column(1 + col).to_pylist()):
                    at: dict[str, list[int]] = {}
                    for k, t in enumerate(tokens or ()):
                        at.setdefault(t, []).append(k)
                    rows += [i] * len(at)
                    terms += at
                    places += at.values()
                keys = batch.column(0).take(pa.array(rows, pa.int64()))
                cols = [pa.array(terms, pa.string()), keys, pa.array([col] * len(rows), pa.int32()), pa.array(places, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["term", "key", "col", "positions"])

    tokens = targets.select("key", text.tokens(F.col("title")).alias("title"), text.tokens(F.col("body")).alias("body"))
    return tokens.mapInArrow(run, f"term string, key {kind.simpleString()}, col int, positions array<int>")


def doc_stats(targets: DataFrame) -> DataFrame:
    """(key, tokens) of every target, without a shuffle."""
    return targets.select("key", _length().alias("tokens"))


def _length() -> Column:
    """Tokens of a row's title and body, counted without making them."""
    one = F.lit(r"[\p{L}\p{N}\p{Mn}]*[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*")
    return F.regexp_count(F.coalesce("title", F.lit("")), one) + F.regexp_count(F.coalesce("body", F.lit("")), one)


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: n, average tokens."""
    return stats.agg(F.count(F.lit(1)).alias("n"), F.avg("tokens").alias("avg_tokens"))


def doc_freq(index: DataFrame) -> DataFrame:
    """(term, df): targets that hold the term."""
    return index.groupBy("term").agg(F.countDistinct("key").alias("df"))


def bucket(term: Column) -> Column:
    """Bucket of a term, by its first characters."""
    return F.pmod(F.crc32(F.substring(term, 1, _HEAD).cast("binary")), F.lit(BUCKETS)).cast("int")


def write_index(index: DataFrame, path: str, parts: int = 8) -> None:
    """Postings below ``path``, in buckets, sorted by term inside."""
    bucketed = index.withColumn("bucket", bucket(F.col("term")))
    # a hot term's postings are spread over several tasks by their keys
    spread = bucketed.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(parts))).sortWithinPartitions("bucket", "term")
    spread.write.partitionBy("bucket").parquet(path)


def _of_word(index: DataFrame, word: str, prefix: bool) -> DataFrame:
    """Postings of a word, or of the words that begin with it."""
    hit = F.startswith("term", F.lit(word)) if prefix else F.col("term") == word
    if "bucket" in index.columns and (len(word) >= _HEAD or not prefix):
        number = zlib.crc32(word[:_HEAD].encode()) % BUCKETS
        hit = (F.col("bucket") == number) & hit
    return index.filter(hit)


def _spaced(column: str) -> Column:
    """The tokens of a column, each behind one space."""
    return F.concat(F.lit(" "), F.regexp_replace(text.fold(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _occurrences(words: list[str]) -> Column:
    """How often one phrase with a prefix at its end occurs in both columns.

    Occurrences may overlap, so places are counted that the phrase follows.
    """
    place = F.lit("(?= " + " ".join(words) + ")")
    return (F.regexp_count(_spaced("title"), place) + F.regexp_count(_spaced("body"), place)).cast("long")


def _idf(n: Column, hits: Column) -> Column:
    idf = F.log((n - hits + 0.5) / (hits + 0.5))
    return F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)


def _term(f: Column, tokens: Column, average: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * tokens / average))


def scan(targets: DataFrame, words: list[list[str]]) -> DataFrame:
    """(key, bm25) straight from the texts: one pass that counts, and its totals as one scalar; no join."""
    f = [f"f{i}" for i in range(len(words))]
    rows = targets.select("key", _length().alias("tokens"), *(_occurrences(w).alias(c) for w, c in zip(words, f)))
    totals = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("tokens").alias("average"), *(F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in f))).scalar()
    hits = rows.filter(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in f])).withColumn("t", totals)
    score = reduce(lambda a, b: a + b, [_idf(F.col("t.n"), F.col(f"t.{c}")) * _term(F.col(c), F.col("tokens"), F.col("t.average")) for c in f])
    return hits.select("key", score.alias("bm25"))


def _shift(positions: str, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def index_hits(index: DataFrame, words: list[str]) -> DataFrame:
    """The same from postings."""
    last = _of_word(index, words[-1], True)
    if len(words) == 1:
        return last.groupBy("key").agg(F.sum(F.size("positions")).cast("long").alias("f"))
    at = last.groupBy("key", "col").agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("starts"))
    at = at.select("key", "col", _shift("starts", len(words) - 1).alias("starts"))
    for k, w in enumerate(words[:-1]):
        mine = _of_word(index, w, False).select("key", "col", _shift("positions", k).alias("p"))
        at = at.join(mine, ["key", "col"]).select("key", "col", F.array_intersect("starts", "p").alias("starts"))
    return at.filter(F.size("starts") > 0).groupBy("key").agg(F.sum(F.size("starts")).cast("long").alias("f"))


def bm25(hits: list[DataFrame], stats: DataFrame) -> DataFrame:
    """(key, bm25) of the targets that every word hits; bm25 is greater for better matches.

    ``hits`` has one (key, f) frame per word. Their sizes, the number of
    targets and the average length are scalar subqueries.
    """
    if not hits:
        return stats.select("key", F.lit(0.0).alias("bm25")).limit(0)
    corpus = corpus_stats(stats).select(F.struct("n", "avg_tokens")).scalar()
    joined, scores = None, []
    for i, h in enumerate(hits):
        h = h.select("key", F.col("f").alias(f"f{i}"))
        joined = h if joined is None else joined.join(h, "key")
    joined = joined.join(stats, "key").withColumn("corpus", corpus)
    for i, h in enumerate(hits):
        joined = joined.withColumn(f"n{i}", h.agg(F.count(F.lit(1))).scalar())
        scores.append(_idf(F.col("corpus.n"), F.col(f"n{i}")) * _term(F.col(f"f{i}"), F.col("tokens"), F.col("corpus.avg_tokens")))
    return joined.select("key", reduce(lambda a, b: a + b, scores).alias("bm25"))


def search(targets: DataFrame, query: str, index: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(key, bm25) for a query, from postings if they are given, else from the texts."""
    words = query_words(query)
    if not words or not all(words):
        return bm25([], doc_stats(targets))
    if index is None:
        return scan(targets, words)
    return bm25([index_hits(index, w) for w in words], doc_stats(targets) if stats is None else stats)


def snippet_text(body: str | None, heads: list[str], most: int = 16) -> str:
    """The first ``most`` words with the most hits, hits in brackets, an ellipsis where something is cut off."""
    words = (body or "").split()
    hits = [any(t.startswith(h) for t in text.tokenize(w) for h in heads) for w in words]
    ahead = [0, *accumulate(hits)]
    last = max(0, len(words) - most)
    at = max(range(last + 1), key=lambda i: (ahead[min(i + most, len(words))] - ahead[i], -i))
    if any(hits[at : at + most]):  # leading words of context
        first = hits.index(True, at)
        at = max(0, min(max(at, first - most // 2), last))
    shown = [f"[{w}]" if h else w for w, h in zip(words[at : at + most], hits[at : at + most])]
    return "…" * (at > 0) + " ".join(shown) + "…" * (at + most < len(words))


def snippet(body: Column, query: str, most: int = 16) -> Column:
    """Snippets of the few rows of an answer; a short body comes whole, without a hit the first words do."""
    heads = [t for w in query_words(query) for t in w]

    @F.pandas_udf(T.StringType())
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda b: snippet_text(b, heads, most))

    return cut(body)
