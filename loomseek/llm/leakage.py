"""Evaluation passages inside training text (problem 9).

The corpus is cut into shards, and of each shard a suffix array over its words
is built, whatever is asked of it: every place of every document, ordered by
the words that follow up to the end of the document. Each suffix of the
evaluation texts is then found in it by binary search on its first ``least``
words. Matches that could begin a word earlier are dropped, the others are
followed to their ends, so every result is the longest verbatim passage, with
its places.

One pass over the corpus: a shard is searched by one block of evaluation texts
after another, and forgotten. A block has at most ``block_chars`` characters,
or a single longer item; blocks are made while the items stream through the
driver, which holds one at a time, and a worker loads one at a time.

Words are maximal runs of letters or digits in lower case, compared by 64-bit
hashes. An item or document with fewer than ``least`` words matches nothing,
null and empty texts included. Items that share a passage are all reported.
Repeated rows give one result in ``found``; in ``matches`` a key of several
texts can have a row for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseek.llm.words import ALNUM, flat, word_hashes

#: Words of a shard, characters of a block, and matches unfolded at a time.
SHARD_WORDS = 1_000_000
BLOCK_CHARS = 8_000_000
_ROOM = 4_000_000


class SuffixShard:
    """Suffix array over the word hashes of some documents."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        # a zero behind every document ends its suffixes; words count from 1
        self.first = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.text = np.zeros(int(self.first[-1]), np.int64)
        self.text[np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)] = ids + 1
        self.order = self._sort()

    def _sort(self) -> np.ndarray:
        """Places in the order of their suffixes, by doubling the length that is compared; only ties are sorted again."""
        n = len(self.text)
        rank = self.text.copy()
        order = np.argsort(rank, kind="stable")
        step = 1
        while True:
            key = rank[order]
            new = np.concatenate(([True], key[1:] != key[:-1])) if n else np.empty(0, bool)
            start = np.flatnonzero(new)
            rank = np.empty(n, np.int64)
            rank[order] = start[np.cumsum(new) - 1] if n else 0
            # ends of documents are equal for good; other groups of more than one are not decided yet
            group = np.diff(np.concatenate((start, [n])))
            open_ = np.repeat((group > 1) & (self.text[order[start]] > 0 if n else False), group)
            at = np.flatnonzero(open_)
            if not len(at):
                return order
            places = order[at]
            # a suffix of ``step`` words that reaches its document's end is the smaller one
            behind = np.where(places + step < n, rank[np.minimum(places + step, n - 1)], -1)
            by = np.lexsort((behind, rank[places]))
            order[at] = places[by]
            head, behind = rank[places][by], behind[by]
            rank[order[at]] = head + self._steps(head, behind)
            step *= 2
            if step > n:
                return order

    @staticmethod
    def _steps(head: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """Place inside its group of the first suffix with the same continuation."""
        i = np.arange(len(head))
        new_head = np.concatenate(([True], head[1:] != head[:-1]))
        new = new_head | np.concatenate(([True], behind[1:] != behind[:-1]))
        return np.maximum.accumulate(np.where(new, i, 0)) - np.maximum.accumulate(np.where(new_head, i, 0))

    def known(self, words: np.ndarray) -> np.ndarray:
        """The shard's numbers of word hashes, 0 for words it has not."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def _bound(self, heads: np.ndarray, after: bool) -> np.ndarray:
        """Binary search of all rows of heads at once: how many suffixes are smaller, with ``after`` smaller or equal."""
        width = heads.shape[1]
        padded = np.concatenate((self.text, np.zeros(width, np.int64)))
        low, high = np.zeros(len(heads), np.int64), np.full(len(heads), len(self.order))
        while (todo := np.flatnonzero(low < high)).size:
            middle = (low[todo] + high[todo]) // 2
            found = padded[self.order[middle][:, None] + np.arange(width)]
            other = found != heads[todo]
            at = np.argmax(other, axis=1)
            row = np.arange(len(todo))
            differs = other[row, at]
            less = np.where(differs, found[row, at] < heads[todo, at], after)
            low[todo[less]] = middle[less] + 1
            high[todo[~less]] = middle[~less]
        return low

    def search(self, items: np.ndarray, ends: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in the shard, places in items, words) of the maximal matches of at least ``least`` words.

        items are word numbers of all items one after another, each with a zero behind; ``ends`` marks those zeros.
        """
        n = len(items) - least + 1
        if n <= 0 or not len(self.text):
            return
        strange = np.concatenate(([0], np.cumsum(items == 0)))
        asked = np.flatnonzero(strange[least:] == strange[:n])
        if not len(asked):
            return
        heads = items[asked[:, None] + np.arange(least)]
        low, high = self._bound(heads, False), self._bound(heads, True)
        hit = np.flatnonzero(high > low)
        asked, low, many = asked[hit], low[hit], (high - low)[hit]
        # unfold a bounded number at a time; one suffix alone has at most as many as the shard has places
        cuts = np.searchsorted(np.cumsum(many), np.arange(_ROOM, int(many.sum()) + _ROOM, _ROOM)) if len(many) else []
        a = 0
        for b in [*(int(c) + 1 for c in cuts), len(many)]:
            b = min(b, len(many))
            if b > a:
                q = np.repeat(asked[a:b], many[a:b])
                inside = np.arange(len(q)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b])
                p = self.order[np.repeat(low[a:b], many[a:b]) + inside]
                # the word before is another one, or there is none
                first = (p == 0) | (q == 0)
                before_p, before_q = self.text[np.maximum(p - 1, 0)], items[np.maximum(q - 1, 0)]
                start = first | (before_p != before_q) | (before_q == 0)
                p, q = p[start], q[start]
                yield p, q, self._follow(p, q, items, least)
                a = b

    def _follow(self, p: np.ndarray, q: np.ndarray, items: np.ndarray, least: int) -> np.ndarray:
        """Words of each match from its places on."""
        length = np.full(len(p), least)
        alive = np.arange(len(p))
        while len(alive):
            x, y = p[alive] + length[alive], q[alive] + length[alive]
            inside = (x < len(self.text)) & (y < len(items))
            alive, x, y = alive[inside], x[inside], y[inside]
            same = (self.text[x] == items[y]) & (items[y] > 0)
            alive = alive[same]
            length[alive] += 1
        return length


def _blocks(items: DataFrame, least: int, block_chars: int) -> list:
    """Broadcast blocks (item ids, words of each, word hashes of all), made from the streamed items."""
    context = items.sparkSession.sparkContext
    memo, blocks = word_hashes(), []
    ids: list[int] = []
    lists: list[list[int]] = []
    held = 0

    def close() -> None:
        nonlocal held
        if ids:
            values, lengths = flat(lists, np.uint64)
            blocks.append(context.broadcast((np.array(ids, np.int64), lengths, values)))
            ids.clear()
            lists.clear()
        held = 0

    for r in items.toLocalIterator():
        words = ALNUM.findall(r["t"].lower())
        if len(words) < least:
            continue
        if held and held + len(r["t"]) > block_chars:
            close()
        ids.append(r["item_id"])
        lists.append([memo[w] for w in words])
        held += len(r["t"])
    close()
    return blocks


def _scan(blocks: list, least: int, shard_words: int, key: str):
    """The worker's side: all blocks against all shards of a partition."""

    def flush(rows: list[tuple[pa.Array, int]], words: list[np.ndarray], lengths: list[int]) -> Iterator[pa.RecordBatch]:
        size = np.array(lengths, np.int64)
        shard = SuffixShard(np.concatenate(words), size)
        keys = pa.concat_arrays([k for k, _ in rows])
        for block in blocks:
            ids, many, hashes = block.value
            if len(blocks) > 1:
                del block._value  # one block is held at a time
            ends = np.cumsum(many + 1) - 1
            items = np.zeros(int(many.sum()) + len(many), np.int64)
            items[np.arange(len(hashes)) + np.repeat(np.arange(len(many)), many)] = shard.known(hashes)
            begins = np.concatenate(([0], ends + 1))[:-1]
            best = None
            for p, q, n in shard.search(items, ends, least):
                doc = np.searchsorted(shard.first, p, "right") - 1
                item = np.searchsorted(ends, q)
                got = np.stack((doc, item, -n, p - shard.first[doc], q - begins[item]))
                got = got if best is None else np.concatenate((best, got), axis=1)
                got = got[:, np.lexsort(got[::-1])]
                best = got[:, np.concatenate(([True], (got[0, 1:] != got[0, :-1]) | (got[1, 1:] != got[1, :-1])))[: got.shape[1]]]
            if best is not None and best.shape[1]:
                cols = [keys.take(pa.array(best[0])), pa.array(ids[best[1]]), *(pa.array(x.astype(np.int32)) for x in (-best[2], best[3], best[4]))]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "item_id", "match_words", "doc_word", "item_word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        rows: list = []
        words: list[np.ndarray] = []
        lengths: list[int] = []
        held = 0
        for batch in batches:
            lists = [ALNUM.findall(t.lower()) if t else [] for t in batch.column(1).to_pylist()]
            taken = [i for i, w in enumerate(lists) if len(w) >= least]
            a = 0
            while a < len(taken):
                b = a
                while b < len(taken) and held < shard_words:
                    held += len(lists[taken[b]])
                    b += 1
                values, many = flat(([memo[w] for w in lists[i]] for i in taken[a:b]), np.uint64)
                rows.append((batch.column(0).take(pa.array(taken[a:b], pa.int64())), b - a))
                words.append(values)
                lengths += many.tolist()
                a = b
                if held >= shard_words:
                    yield from flush(rows, words, lengths)
                    rows, words, lengths, held = [], [], [], 0
        if rows:
            yield from flush(rows, words, lengths)

    return run


def matches(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", least: int = 12, shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The longest verbatim passage of each document and item that share at least ``least`` words.

    Columns: key, item_id, match_words, doc_word, item_word (places in words
    from 0; of equally long ones the first in the document, then in the item).
    """
    kind = docs.schema[key].dataType.simpleString()
    items = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("t")).filter("item_id is not null and t is not null").distinct()
    blocks = _blocks(items, least, block_chars)
    return docs.select(key, text).mapInArrow(_scan(blocks, least, shard_words, key), f"{key} {kind}, item_id long, match_words int, doc_word int, item_word int")


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every leak."""
    return matches(docs, items).select("doc_id", "item_id").distinct()


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents without those that hold an evaluation passage."""
    return docs.join(matches(docs, items, key=key).select(key).distinct(), key, "left_anti")
