"""Near-duplicate records by word n-gram sets (problem 2).

Exact similarity join of the sets of n-grams (sequences of ``n`` consecutive
words). Each set is ordered rare-first and only a prefix of it is joined, so
long that two similar sets share SHARED n-grams of their prefixes at least.
Rare is what isn't hot (see below), and then what has rare words. Of the
records that meet at an n-gram those pairs go on whose sizes (length filter)
and places of the n-gram (positional filter) allow the similarity; then those
that met often enough; then those whose sets are not too far apart (suffix
filter: a lower bound of the Hamming distance, summed over hash ranges, from
64 bytes a set). Only for those the sets are brought together, and each pair
is verified once.

Scale: records of equal sets are one class, joined once and expanded at the
end. Frequent words and n-grams are found by sketches of all records: a task
counts with a bounded number of counters, and what has a share of at least
1 / MAX_HOT of all is known afterwards, at most MAX_HOT of each, whatever the
size of the collection. Hot n-grams come last in every set, so one of them is
in a prefix only if most of its record is as frequent. Such an n-gram is cut into tiles of about TILE classes, each joined by itself with
each other one; no task gets a whole hot n-gram. Classes with a share of at
least a thousandth of all records are divided where members are joined.

Words are maximal runs of letters or digits in lower case. A record with fewer
than ``n`` words - null and empty texts too - is similar to none. n-grams are
compared by hashes, of 40 bits inside a pair. Rows that repeat a key count
once; if they differ in text, the key is similar to what any of its texts is
similar to, and never to itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseek.llm.words import ALNUM, flat, mix, ngrams, word_hashes
from loomseek.operators.joins import divide, hot_keys, lookup, repeat
from loomseek.session import cut, release

#: Bound of the tables of hot n-grams and of words, counters of a task, and classes of a tile.
MAX_HOT, COUNTERS, TILE = 100_000, 400_000, 20_000
#: Shared prefix n-grams that make a candidate; prefixes are longer by one less.
SHARED = 3
#: Bytes of an n-gram's hash in a stored set, and hash ranges of the suffix filter.
_BYTES, _RANGES = 5, 512
#: Pairs unfolded at a time.
_ROOM = 1_000_000


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _distinct(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the distinct (record, key) pairs, sorted."""
    order = np.lexsort((keys, owner))
    if not len(order):
        return order
    o, k = owner[order], keys[order]
    return order[np.concatenate(([True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])))]


class _Sets:
    """Distinct n-grams (40 bits, salted by tab) of the records of a batch, by record and hash; size and id of each record's set."""

    def __init__(self, tabs: list, texts: list, n: int, memo: dict):
        self.words, lengths = flat(([memo[w] for w in ALNUM.findall(t.lower())] if t else [] for t in texts), np.uint64)
        grams, owner, at = ngrams(self.words, lengths, n)
        names = {t: i for i, t in enumerate(dict.fromkeys(tabs))}
        salts = np.array([memo[f"tab:{t}"] for t in names], np.uint64)
        if len(grams):
            grams = (grams ^ salts[np.array([names[t] for t in tabs], np.int64)[owner]]) >> np.uint64(64 - 8 * _BYTES)
        once = _distinct(owner, grams)
        self.grams, self.owner, self.at = grams[once], owner[once], at[once]
        self.size = np.bincount(self.owner, minlength=len(tabs))
        total = np.zeros(len(tabs), np.uint64)
        np.add.at(total, self.owner, mix(self.grams))
        self.ids = _signed(mix(total))


class _New:
    """Which sets a task has not met yet; it may forget, then a set counts as new again."""

    def __init__(self):
        self.said: set[int] = set()

    def mark(self, sets: _Sets) -> np.ndarray:
        new = np.zeros(len(sets.ids), bool)
        for i in np.flatnonzero(sets.size).tolist():
            if (s := int(sets.ids[i])) not in self.said:
                self.said.add(s)
                new[i] = True
        if len(self.said) > 2_000_000:
            self.said.clear()
        return new


def _pack(grams: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary of _BYTES per n-gram for each set."""
    data = grams.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _BYTES :].tobytes()
    offsets = np.concatenate(([0], np.cumsum(sizes))) * _BYTES
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, _BYTES)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, 8 - _BYTES :] = raw
    return full.view(">u8").ravel().astype(np.uint64)


def _marks(grams: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """For each set the hash ranges that it meets, as bits."""
    bits = np.zeros((size, _RANGES), bool)
    bits[owner, (mix(grams) % np.uint64(_RANGES)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


class _Sketch:
    """Counts of the frequent hashes, in a bounded number of counters; no count is too high."""

    def __init__(self):
        self.hashes, self.counts, self.total = np.empty(0, np.uint64), np.empty(0, np.int64), 0

    def add(self, hashes: np.ndarray) -> None:
        self.total += len(hashes)
        new, n = np.unique(hashes, return_counts=True)
        both = np.concatenate((self.hashes, new))
        self.hashes, at = np.unique(both, return_inverse=True)
        self.counts = np.bincount(at, np.concatenate((self.counts, n))).astype(np.int64)
        if len(self.hashes) > COUNTERS:
            self.counts -= np.partition(self.counts, -COUNTERS - 1)[-COUNTERS - 1]
            keep = self.counts > 0
            self.hashes, self.counts = self.hashes[keep], self.counts[keep]

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        keep = self.counts >= max(2, self.total // (2 * MAX_HOT))
        return self.hashes[keep], self.counts[keep]


_STAGED = "kind string, hot long, n long, sid long, tab string, rec_key string, size int, marks binary"
_WORDS, _GRAMS = "word", "gram"


def stage(df: DataFrame, n: int) -> DataFrame:
    """One written table: the frequent words and n-grams of each task (kind, hot, n; with hot null: how many in all), the records' sets (sid, tab, rec_key), and once a task facts on each set (size, marks)."""
    names = [x.split()[0] for x in _STAGED.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary()]

    def rows(**known) -> pa.RecordBatch:
        size = len(next(iter(known.values())))
        return pa.RecordBatch.from_arrays([known.get(k, pa.nulls(size)).cast(t) for k, t in zip(names, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, sketches = word_hashes(), _New(), {_WORDS: _Sketch(), _GRAMS: _Sketch()}
        for batch in batches:
            tabs = batch.column(0).to_pylist()
            sets = _Sets(tabs, batch.column(2).to_pylist(), n, memo)
            new, has = seen.mark(sets), np.flatnonzero(sets.size)
            sketches[_WORDS].add(sets.words)
            sketches[_GRAMS].add(sets.grams[new[sets.owner]])
            marks = pa.array([m.tobytes() if k else None for m, k in zip(_marks(sets.grams, sets.owner, len(tabs)), new)], pa.binary())
            take = pa.array(has)
            yield rows(sid=pa.array(sets.ids[has]), tab=batch.column(0).take(take), rec_key=batch.column(1).take(take), size=pa.array(sets.size[has]), marks=marks.take(take))
        for kind, sketch in sketches.items():
            hot, counts = sketch.frequent()
            yield rows(kind=pa.array([kind] * (len(hot) + 1)), hot=pa.array([*_signed(hot).tolist(), None], pa.int64()), n=pa.array([*counts.tolist(), sketch.total], pa.int64()))

    return cut(df.mapInArrow(run, _STAGED), "neardup-stage")


def frequent(staged: DataFrame, kind: str, most: int = MAX_HOT) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a kind that are at least 1/most of all, sorted, and how often each comes, about."""
    counts = staged.filter(F.col("kind") == kind).groupBy("hot").agg(F.sum("n").alias("n"))
    total = counts.filter("hot is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.filter((F.col("n") >= max(2, -(-total // most))) & F.col("hot").isNotNull()).collect()  # at most ``most`` rows
    hashes, n = _signed(np.array([r["hot"] for r in rows], np.int64)).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _look(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """The table's numbers for hashes, 0 for what isn't in it."""
    known, n = table
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, n[at], 0)


def prefixes(df: DataFrame, words: tuple[np.ndarray, np.ndarray], hot: tuple[np.ndarray, np.ndarray], n: int, num: int, den: int, tile: int = TILE) -> DataFrame:
    """(slot, sid, place): the rare-first prefix of each set. place holds the size, the position and the side in a tile.

    A slot is an n-gram, or a pair of parts of a hot one.
    """
    level = (16 * np.log2(words[1] / words[1].min())).astype(np.int64) + 1 if len(words[1]) else words[1]
    shared = df.sparkSession.sparkContext.broadcast(((words[0], level), hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = word_hashes(), _New()
        common, known = shared.value
        for batch in batches:
            sets = _Sets(batch.column(0).to_pylist(), batch.column(2).to_pylist(), n, memo)
            new = seen.mark(sets)
            of_word = _look(common, sets.words)
            keep = new[sets.owner]
            grams, own, at = sets.grams[keep], sets.owner[keep], sets.at[keep]
            usual = sum((of_word[at + k] for k in range(n)), np.zeros(len(at), np.int64))
            many = _look(known, grams)
            slot = mix(grams)
            order = np.lexsort((slot, usual, many, own))
            slot, many = slot[order], many[order]
            size = np.where(new, sets.size, 0)
            pos = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            least = -(-size * num // den)  # n-grams that a partner shares at least
            keep = pos < (size - least + SHARED)[own]
            slot, many, pos, own = slot[keep], many[keep], pos[keep], own[keep]
            parts, place, sid = -(-many // tile), (size[own] << 34) | (pos << 2), sets.ids[own]
            cold = parts < 2
            out = [(slot[cold], sid[cold], place[cold] | 2)]
            for i in np.flatnonzero(~cold).tolist():  # the pairs of its own part with every part
                k = int(parts[i])
                mine = int(sid[i]) % k
                others = np.arange(k)
                low, high = np.minimum(mine, others).astype(np.uint64), np.maximum(mine, others).astype(np.uint64)
                slots = mix(slot[i] ^ mix((low << np.uint64(32)) | high))
                out.append((slots, np.full(k, sid[i]), place[i] | np.where(others == mine, 2, np.where(others > mine, 0, 1))))
            cols = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(_signed(cols[0].astype(np.uint64))), pa.array(cols[1]), pa.array(cols[2])], names=["slot", "sid", "place"])

    return df.mapInArrow(run, "slot long, sid long, place long")


def with_sets(df: DataFrame, n: int) -> DataFrame:
    """(sid, grams) of the records, each set once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = word_hashes(), _New()
        for batch in batches:
            sets = _Sets(batch.column(0).to_pylist(), batch.column(2).to_pylist(), n, memo)
            new = seen.mark(sets)
            packed = _pack(sets.grams[new[sets.owner]], sets.size[new])
            yield pa.RecordBatch.from_arrays([pa.array(sets.ids[new]), packed], names=["sid", "grams"])

    return df.mapInArrow(run, "sid long, grams binary")


def _meet(sid: np.ndarray, size: np.ndarray, pos: np.ndarray, side: np.ndarray, start: np.ndarray, end: np.ndarray, num: int, den: int) -> Iterator[tuple]:
    """(a, b, need) of the pairs of each group [start, end) that length and position allow; rows are sorted by group and size."""
    group_end = np.repeat(end, end - start)
    # partners stand behind a row and are not too large for it
    row = np.arange(len(sid))
    group = np.repeat(np.arange(len(start)), end - start)
    scale = int(size.max()) * den + 1 if len(size) else 1
    last = np.searchsorted(group * scale + size, group * scale + np.minimum(size * den // num, scale - 1), "right")
    many = np.minimum(last, group_end) - row - 1
    total = np.cumsum(many)
    a = 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _ROOM)))
        k = many[a:b]
        x = np.repeat(row[a:b], k)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
        need = -(-(size[x] + size[y]) * num // (num + den))
        room = np.minimum(pos[x], pos[y]) + np.minimum(size[x] - pos[x], size[y] - pos[y])
        # of the pair's own prefixes, which may be shorter than those of all pairs
        inside = (pos[x] < size[x] - need + SHARED) & (pos[y] < size[y] - need + SHARED)
        keep = inside & (room >= need) & (sid[x] != sid[y]) & ((side[x] == 2) | (side[x] != side[y]))
        x, y, need = x[keep], y[keep], need[keep]
        yield np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y]), np.minimum(need, SHARED)
        a = b


def candidates(prefix: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of classes that may reach the similarity num/den, by their prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3, 0), np.int64)

        def join(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            slot = rows[0]
            same = np.concatenate(([False], slot[1:] == slot[:-1], [False]))
            rows = rows[:, same[:-1] | same[1:]]  # what meets nothing goes
            if not rows.shape[1]:
                return
            rows = rows[:, np.lexsort((rows[1], rows[2] >> 34, rows[0]))]
            # a class that several tasks gave counts once
            again = np.concatenate(([False], (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1])))
            slot, sid, place = rows[:, ~again]
            new = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
            for a, b, need in _meet(sid, place >> 34, (place >> 2) & 0xFFFFFFFF, place & 3, new, np.concatenate((new[1:], [len(slot)])), num, den):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(need.astype(np.int32))], names=["a", "b", "need"])

        for batch in batches:
            rows = np.concatenate((held, np.stack([c.to_numpy() for c in batch.columns])), axis=1)
            if not rows.shape[1]:
                continue
            whole = int(np.searchsorted(rows[0], rows[0, -1]))  # the last slot may go on
            yield from join(rows[:, :whole])
            held = rows[:, whole:]
        yield from join(held)

    met = prefix.repartition("slot").sortWithinPartitions("slot").mapInArrow(run, "a long, b long, need int")
    return met.groupBy("a", "b", "need").count().filter("count >= need").select("a", "b")


def near_enough(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """The candidates (a, b) that pass the suffix filter on facts (sid, size, marks)."""
    side = lambda x: facts.select(F.col("sid").alias(x), F.col("size").alias(f"size_{x}"), F.col("marks").alias(f"marks_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = [batch.column(k).to_numpy().astype(np.int64) for k in (2, 4)]
            marks = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (3, 5)]
            apart = np.bitwise_count(marks[0] ^ marks[1]).sum(axis=1).astype(np.int64)
            need = -(-(size[0] + size[1]) * num // (num + den))
            keep = pa.array((size[0] + size[1] - apart) // 2 >= need)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "size_a", "marks_a", "size_b", "marks_b").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, similarity) of the pairs that reach num/den by their sets (sid, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, np.uint64)
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if b != last:
                    last, held = b, _unpack(y)
                mine = _unpack(x)
                same = len(np.intersect1d(mine, held, assume_unique=True))
                if same * (num + den) >= num * (len(mine) + len(held)):
                    rows.append((a, b, same / (len(mine) + len(held) - same)))
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    side = lambda x: sets.select(F.col("sid").alias(x), F.col("grams").alias(f"grams_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a long, b long, similarity double")


def class_pairs(df: DataFrame, n: int = 3, num: int = 1, den: int = 2, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Pairs of similar classes (a, b, similarity), and members (sid, tab, rec_key).

    df has tab, rec_key and text. The threshold is the fraction num/den.
    """
    df = df.select("tab", "rec_key", "text").filter("rec_key is not null and text is not null")
    staged = stage(df, n)
    members = staged.filter("sid is not null").select("sid", "tab", "rec_key").distinct()
    met = cut(candidates(prefixes(df, frequent(staged, _WORDS), frequent(staged, _GRAMS), n, num, den, tile), num, den), "neardup-met")
    facts = staged.filter("marks is not null").groupBy("sid").agg(F.first("size").alias("size"), F.first("marks").alias("marks"))
    pairs = cut(near_enough(met, facts, num, den), "neardup-pairs")
    release(met)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = with_sets(df, n).join(asked, "sid", "left_semi").groupBy("sid").agg(F.first("grams").alias("grams"))
    verified = cut(verify(pairs, wanted, num, den), "neardup-verified")
    release(pairs)
    return verified, members


def _members(pairs: DataFrame, side: str, members: DataFrame, hot: DataFrame) -> DataFrame:
    """pairs with the records of one side's class; those of a hot class are divided."""
    named = hot.withColumnRenamed("sid", side)
    mine = divide(members, hot, "sid", "rec_key").select(F.col("sid").alias(side), "part", F.col("tab").alias(f"tab_{side}"), F.col("rec_key").alias(f"key_{side}"))
    return repeat(pairs, named, side).join(mine, [side, "part"]).drop("part")


def record_pairs(df: DataFrame, n: int = 3, num: int = 1, den: int = 2, tile: int = TILE) -> DataFrame:
    """(tab, key_a, key_b) of distinct similar records, the smaller key first."""
    pairs, members = class_pairs(df, n, num, den, tile)
    twins = members.groupBy("sid").count().filter("count > 1").select(F.col("sid").alias("a"), F.col("sid").alias("b"))
    hot = hot_keys(members, "sid")
    out = _members(_members(pairs.select("a", "b").unionByName(twins), "a", members, hot), "b", members, hot)
    out = out.filter("key_a != key_b and tab_a = tab_b")
    return out.select(F.col("tab_a").alias("tab"), F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()


def classes(df: DataFrame, n: int = 3, num: int = 1, den: int = 2) -> DataFrame:
    """(tab, rec_key, class_key, copies, links): each record's class of equal sets, its size, and the number of similar other classes.

    As many rows as records, however many copies there are.
    """
    pairs, members = class_pairs(df, n, num, den)
    links = pairs.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("sid").agg(F.min("rec_key").alias("class_key"), F.count(F.lit(1)).alias("copies"))
    facts = sizes.join(links, "sid", "left")
    return lookup(members, facts, "sid", "rec_key").select("tab", "rec_key", "class_key", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node of the pairs (a, b): the smallest node it is connected to.

    Every round each node's neighbours are linked to its smallest one, and the
    trees are halved; rounds end when nothing changes. All rounds are joins and
    aggregates over written tables.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    first = edges
    while True:
        # large star: larger neighbours of a node to its smallest
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours to the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(small_low.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "edges")
        same = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").limit(1).count() == 0
        if edges is not first:
            release(edges)
        edges = after
        if same:
            break
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def groups(df: DataFrame, n: int = 3, num: int = 1, den: int = 2) -> DataFrame:
    """(tab, rec_key, group_id, size): records that are connected by similarity; records alone are left out."""
    pairs, members = class_pairs(df, n, num, den)
    roots = components(pairs)
    mine = members.join(roots, members.sid == roots.node, "left").select("tab", "rec_key", F.coalesce("root", "sid").alias("root"))
    sizes = mine.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("tab", "rec_key")).alias("first")).filter("size > 1")
    return lookup(mine, sizes, "root", "rec_key").select("tab", "rec_key", F.concat_ws(":", "first.tab", "first.rec_key").alias("group_id"), "size").distinct()
