"""Most similar vectors (problem 5): vantage-point trees per shard.

Distance is the chord between unit vectors, a metric with
cosine = 1 - distance^2 / 2.

``similar`` answers every usable vector within a radius. Vantage points
divide the vectors of a model into cells (shards); a vector lives in the cell
of its nearest vantage point and visits each other cell that the triangle
inequality leaves open: if d(q, v) - d(q, nearest v) > 2 * radius, no vector
of v's cell is within the radius. In a cell a vantage-point tree prunes in the
same way. Both tests are relaxed by a tunable factor that shrinks the radius
in them, in proportion to how close the vectors lie as a whole; factor one
restores the exact search. Vantage points are members of a bounded sample,
apart from each other at the coarsest scale that gives enough of them. A cell
that the sample shows overfull is divided by further members of its own.
Only a cell of equal vectors is cut by hash: there a vector finds as good
neighbours in one part as in another, and visits one.

``nearest`` answers a given set of queries exactly (factor one) against all
vectors, in blocks of bounded size.

Usable is a vector that is not null, has exactly ``dim`` values, all finite
and not all zero; other rows are left out. Repeated rows count once; a digest
with several usable vectors has the similarity of its best one and is never
its own neighbour. Of equal similarities ``similar`` puts the smaller hash of
the digest first (among cut parts of equal vectors any), ``nearest`` the
smaller digest.
Models never mix, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomseek.session import cut

#: Vectors wanted in a cell, bound of the vantage points chosen first, and rows of the sample; no more points than those are sent to workers.
CELL, MAX_CELLS, SAMPLE = 1500, 4096, 16384
#: A cell with more vectors than this is divided, if so many rows of the sample lie in it.
MAX_MEMBERS, FEW = 6000, 8
#: Similarities to vantage points computed at a time.
_ROOM = 4_000_000
#: Similarities below which vantage points lie apart, the coarsest first.
SCALES = (0.8, 0.85, 0.9, 0.94, 0.97, 0.985, 0.995, 0.999, 0.99999)
#: Relaxation of the choice of cells and of the trees inside them.
CELL_FACTOR, TREE_FACTOR = 24.0, 6.0


def chord(cosine):
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


class VPTree:
    """Vantage-point tree over unit vectors, searched by many queries at once."""

    def __init__(self, x: np.ndarray, leaf: int = 512):
        self.x = x
        self.root = self._build(np.arange(len(x)), leaf)

    def _build(self, rows: np.ndarray, leaf: int):
        if len(rows) <= leaf:
            return rows
        far = rows[np.argmin(self.x[rows] @ self.x[rows[0]])]  # far from an arbitrary member
        d = chord(self.x[rows] @ self.x[far])
        middle = np.median(d)
        inner = d <= middle
        if inner.all() or not inner.any():
            return rows
        return self.x[far], float(middle), self._build(rows[inner], leaf), self._build(rows[~inner], leaf)

    def leaves(self, q: np.ndarray, radius: np.ndarray, factor: float = 1.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, members) of each leaf that may hold a member within the query's radius.

        The caller may shrink ``radius`` between leaves.
        """
        todo = [(self.root, np.arange(len(q)), np.zeros(len(q)))]
        while todo:
            node, who, gap = todo.pop()
            keep = gap * factor <= radius[who]
            who = who[keep]
            if not len(who):
                continue
            if isinstance(node, np.ndarray):
                yield who, node
                continue
            point, middle, inner, outer = node
            off = chord(q[who] @ point) - middle
            gap = gap[keep]
            todo.append((outer, who, np.maximum(gap, -off)))
            todo.append((inner, who, np.maximum(gap, off)))


def _relaxed(factor: float, spread: float) -> float:
    """The factor for vectors that lie as close as ``spread`` says; one stays exact."""
    return 1.0 if factor <= 1 else max(1.0, factor / spread)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(model, rows, vectors) of the usable rows of a batch of (model_id, dim, vector, ...)."""
    models, dims, lists = batch.column(0), batch.column(1), batch.column(2)
    dim = dims.fill_null(-1).to_numpy(zero_copy_only=False)
    size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = (dim == size) & (size > 0) & models.is_valid().to_numpy(zero_copy_only=False)
    values = lists.values.to_numpy(zero_copy_only=False)
    start = lists.offsets.to_numpy()[:-1]
    code = models.dictionary_encode()
    names, codes = code.dictionary.to_pylist(), code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for m, d in sorted({(int(a), int(b)) for a, b in zip(codes[fits], dim[fits])}):
        rows = np.flatnonzero(fits & (codes == m) & (dim == d))
        x = values[start[rows][:, None] + np.arange(d)].astype(np.float32)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            yield names[m], rows[good], x[good]


def _plan(vectors: DataFrame, cell: int, sample: int) -> tuple[dict, dict]:
    """For each (model, dim): its number, and if it needs cells their vantage points, parts and spread."""
    fits = vectors.filter("vector is not null and size(vector) = dim and dim > 0")
    counts = {(r["model_id"], r["dim"]): r["count"] for r in fits.filter("model_id is not null").groupBy("model_id", "dim").count().collect()}
    numbers = {m: i for i, m in enumerate(sorted(counts))}
    large = {m: c for m, c in counts.items() if c > cell}
    total = sum(large.values())
    plans: dict = {}
    if not large:
        return numbers, plans
    span = 1 << 30
    first = F.pmod(F.xxhash64("text_digest", F.lit("sample")), F.lit(span))
    mine = [(F.col("model_id") == model) & (F.col("dim") == dim) for model, dim in large]
    rows = fits.filter((first < int(min(1.0, sample / total) * span)) & reduce(lambda a, b: a | b, mine)).select("model_id", "dim", "vector", "text_digest")
    # the smallest hashes, whatever the partitions
    drawn = rows.distinct().orderBy(first, "text_digest", F.xxhash64("model_id", "vector")).limit(2 * sample)
    kept: dict = {m: [] for m in large}
    for batch in drawn.toArrow().to_batches():
        digests = batch.column(3).to_pylist()
        for model, at, x in _usable(batch):
            kept[model, x.shape[1]] += [(digests[r], v) for r, v in zip(at, _unit(x))]
    cells = max(1.0, min(MAX_CELLS, total / cell))
    for m, c in large.items():
        rows = sorted(kept[m], key=lambda r: (r[0] or "", r[1].tobytes()))
        if rows:
            plans[m] = _cells(np.stack([v for _, v in rows]).astype(np.float32), max(1, round(cells * c / total)), c, cell)
    return numbers, plans


def _cells(x: np.ndarray, k: int, count: int, cell: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(vantage points, parts of each cell, spread) for ``count`` vectors of which x is a sample.

    The spread is the typical chord between two vectors, 1 for directions without any trend.
    """
    other = np.random.default_rng(3).permutation(len(x))
    spread = float(np.median(chord(np.einsum("ij,ij->i", x, x[other])))) / np.sqrt(2)
    points, weight = _spread(x, k), count / len(x)
    whole: set[bytes] = set()  # cells of equal vectors
    while True:
        home = np.argmax(x @ points.T, axis=1)
        sampled = np.bincount(home, minlength=len(points))
        members = sampled * weight
        # a cell with few rows of the sample stays, however many vectors it stands for
        full = [i for i in np.flatnonzero((members > MAX_MEMBERS) & (sampled >= FEW)) if points[i].tobytes() not in whole]
        if not full:
            break
        more = []
        for i in full:
            inside = _spread(np.concatenate((points[i : i + 1], x[home == i])), 1 + int(np.ceil(members[i] / cell)), first=True)[1:]
            more.append(inside)
            if not len(inside):
                whole.add(points[i].tobytes())
        points = np.concatenate((points, *more))
    parts = np.where([p.tobytes() in whole for p in points], np.ceil(members / MAX_MEMBERS), 1).astype(np.int64)
    return points, np.maximum(parts, 1), min(1.0, max(spread, 1e-3))


def _spread(x: np.ndarray, k: int, first: bool = False) -> np.ndarray:
    """At most k vantage points of x (with ``first`` its first row is one), as far apart as so many can be found."""
    chosen: list[int] = []
    near = np.full(len(x), -1.0, np.float32)
    order = np.random.default_rng(7).permutation(len(x))
    for scale in SCALES:
        for i in ([0] if first and not chosen else []) + order.tolist():
            if near[i] < scale:
                chosen.append(i)
                near = np.maximum(near, x @ x[i])
                if len(chosen) >= k:
                    return x[chosen]
    return x[chosen]


def similar(vectors: DataFrame, k: int = 5, least: float = 0.82, cell_factor: float = CELL_FACTOR, tree_factor: float = TREE_FACTOR, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """(model_id, digest_a, digest_b, cosine, place): the k most similar digests of each digest, if at least ``least``.

    vectors has model_id, text_digest, dim and vector.
    """
    vectors = vectors.select("model_id", "dim", "vector", "text_digest").filter("text_digest is not null")
    numbers, plans = _plan(vectors, cell, sample)
    radius = float(chord(least))
    shared = vectors.sparkSession.sparkContext.broadcast((numbers, plans))  # no more points than rows of the sample

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, plans = shared.value
        for batch in batches:
            ids = batch.column(3).to_numpy()
            for model, rows, x in _usable(batch):
                m = (model, x.shape[1])
                base = numbers[m] << 40
                raw = [v.tobytes() for v in x]
                if m not in plans:
                    shard, guest, who = np.full(len(rows), base), np.zeros(len(rows), bool), np.arange(len(rows))
                else:
                    points, parts, spread = plans[m]
                    u, step, margin = _unit(x).astype(np.float32), max(1, _ROOM // len(points)), 2 * radius / _relaxed(cell_factor, spread)
                    visits = []
                    for i in range(0, len(u), step):
                        d = chord(u[i : i + step] @ points.T)
                        near = d.min(axis=1)
                        who, to = np.nonzero(d <= near[:, None] + margin)
                        visits.append((who + i, to, to != np.argmin(d, axis=1)[who]))
                    who, to, guest = (np.concatenate(v) for v in zip(*visits))
                    shard = base + (to << 16) + ids[rows[who]] % parts[to]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int64)), pa.array(guest), pa.array(ids[rows[who]]), pa.array([raw[i] for i in who], pa.binary())],
                    names=["shard", "guest", "id", "raw"],
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        now, held = None, []
        spreads = {numbers[m]: plan[2] for numbers, plans in [shared.value] for m, plan in plans.items()}

        def read(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
            once = list(dict.fromkeys(rows))
            return np.array([r[0] for r in once], np.int64), _unit(np.stack([np.frombuffer(r[1], np.float32) for r in once]))

        def ask(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            t, mid, mx = tree
            q = x.astype(np.float32)
            reach = np.full(len(q), radius)
            # so many rows hold k digests other than the query's, and equal similarities beside them
            room = max(64, 2 * (k + 1)) + len(mid) - len(np.unique(mid))
            qs, ms = [], []
            for who, rows in t.leaves(q, reach, _relaxed(tree_factor, spreads.get(int(now) >> 40, 1.0))):
                s = q[who] @ t.x[rows].T
                if s.shape[1] > room:  # more than the best of a leaf are never needed
                    floor = np.partition(s, -room, axis=1)[:, -room]
                    crowded = np.flatnonzero(floor >= least - 1e-4)
                    for i in crowded:
                        top = np.argpartition(-s[i], room - 1)[:room]
                        kept = s[i, top]
                        s[i] = -2
                        s[i, top] = kept
                    reach[who[crowded]] = np.minimum(reach[who[crowded]], chord(floor[crowded]) + 1e-3)
                a, b = np.nonzero(s >= least - 1e-4)
                qs.append(who[a])
                ms.append(rows[b])
            a = np.concatenate(qs) if qs else np.empty(0, np.int64)
            b = np.concatenate(ms) if ms else np.empty(0, np.int64)
            cosine = np.einsum("ij,ij->i", x[a], mx[b])
            keep = (cosine >= least) & (ids[a] != mid[b])
            a, b, cosine = ids[a[keep]], mid[b[keep]], cosine[keep]
            a, b, cosine = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((cosine, cosine))
            # the k best of each side, each neighbour once
            order = np.lexsort((-cosine, b, a))
            a, b, cosine = a[order], b[order], cosine[order]
            once = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
            a, b, cosine = a[once], b[once], cosine[once]
            order = np.lexsort((b, -np.round(cosine, 9), a))
            a, b, cosine = a[order], b[order], cosine[order]
            new = np.concatenate(([True], a[1:] != a[:-1]))[: len(a)]
            first = np.flatnonzero(new)
            keep = np.arange(len(a)) - (first[np.cumsum(new) - 1] if len(a) else 0) < k
            return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(cosine[keep])], names=["a", "b", "cosine"])

        def close() -> Iterator[pa.RecordBatch]:
            """Build the tree of the members held and let them ask it."""
            nonlocal tree, held
            if held:
                mid, mx = read(held)
                tree = VPTree(mx.astype(np.float32)), mid, mx
                held = []
                for i in range(0, len(mid), 4096):
                    yield ask(mid[i : i + 4096], mx[i : i + 4096])

        for batch in batches:
            shards = batch.column(0).to_numpy()
            guest = batch.column(1).to_numpy(zero_copy_only=False)
            rows = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            edges = np.flatnonzero(np.diff(shards)) + 1
            for i, j in zip([0, *edges], [*edges, len(rows)]):
                if shards[i] != now:
                    yield from close()
                    now, tree = shards[i], None
                first = i + int(np.searchsorted(guest[i:j], True))
                held += rows[i:first]
                if first < j:
                    yield from close()
                    if tree is not None:
                        yield ask(*read(rows[first:j]))
        yield from close()

    named = vectors.withColumn("id", F.xxhash64("model_id", "text_digest"))
    routed = named.select("model_id", "dim", "vector", "id").mapInArrow(route, "shard long, guest boolean, id long, raw binary")
    pairs = routed.repartition("shard").sortWithinPartitions("shard", "guest").mapInArrow(search, "a long, b long, cosine double")
    links = pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    place = Window.partitionBy("a").orderBy(F.desc(F.round("cosine", 9)), "b")
    best = links.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)
    names = named.select("id", "model_id", "text_digest").distinct()
    best = best.join(names.select(F.col("id").alias("b"), F.col("text_digest").alias("digest_b")), "b")
    return best.join(names.select(F.col("id").alias("a"), "model_id", F.col("text_digest").alias("digest_a")), "a").select("model_id", "digest_a", "digest_b", "cosine", "place")


def found(vectors: DataFrame) -> DataFrame:
    """(model_id, digest_a, digest_b) with either among the other's 5 most similar, from cosine 0.82 on."""
    pairs = similar(vectors)
    return pairs.select("model_id", F.least("digest_a", "digest_b").alias("digest_a"), F.greatest("digest_a", "digest_b").alias("digest_b")).distinct()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, block: int = 65536) -> DataFrame:
    """(model_id, digest, neighbour, cosine, place): the k most similar other digests of each query digest.

    Both frames have model_id, text_digest, dim and vector. The queries are
    taken in blocks of about ``block`` rows, each sent to every task, which
    keeps the k best of each query; a tree is built of what one Arrow batch
    holds.
    """
    context = queries.sparkSession.sparkContext
    queries = cut(queries.select("model_id", "dim", "vector", "text_digest").filter("text_digest is not null").distinct(), "queries")
    vectors = vectors.select("model_id", "dim", "vector", "text_digest").filter("text_digest is not null")
    blocks = max(1, -(-queries.count() // block))

    def best(shared):
        def top(q: np.ndarray, code: np.ndarray, cos: np.ndarray) -> np.ndarray:
            """Places of the k best of each query, each code once; of equal ones the smaller code."""
            order = np.lexsort((-cos, code, q))
            order = order[np.concatenate(([True], (q[order][1:] != q[order][:-1]) | (code[order][1:] != code[order][:-1])))[: len(order)]]
            order = order[np.lexsort((code[order], -np.round(cos[order], 9), q[order]))]
            new = np.concatenate(([True], q[order][1:] != q[order][:-1]))[: len(order)]
            place = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
            return order[place < k]

        def ask(tree: VPTree, m: np.ndarray, x: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(query, member, cosine) of the ``room`` best members of each query, and those equal to the last of them."""
            q, reach = x.astype(np.float32), np.full(len(x), 2.0)
            who, at, got = [], [], []
            floor = np.full(len(x), -2.0, np.float32)
            for asks, leaf in tree.leaves(q, reach, factor):
                s = q[asks] @ tree.x[leaf].T
                if s.shape[1] > room:
                    floor[asks] = np.maximum(floor[asks], np.partition(s, -room, axis=1)[:, -room] - 1e-5)
                    reach[asks] = np.minimum(reach[asks], chord(floor[asks]) + 1e-3)
                i, j = np.nonzero(s >= floor[asks][:, None])
                who.append(asks[i])
                at.append(leaf[j])
                got.append(s[i, j])
            who, at, got = (np.concatenate(v) for v in (who, at, got))
            keep = got >= floor[who]
            who, at = who[keep], at[keep]
            return who, at, np.einsum("ij,ij->i", x[who], m[at])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            state = {m: (np.empty(0, np.int64), np.empty(0, object), np.empty(0)) for m in asked}
            for batch in batches:
                digests = np.array(batch.column(3).to_pylist(), object)
                for model, rows, raw in _usable(batch):
                    if (key := (model, raw.shape[1])) not in asked:
                        continue
                    names, x = asked[key]
                    mine, m = digests[rows], _unit(raw)
                    tree = VPTree(m.astype(np.float32), 2048)
                    # room for repeated rows and the query itself among the best
                    room = k + 1 + len(mine) - len(set(mine))
                    for i in range(0, len(x), 4096):
                        who, at, cos = ask(tree, m, x[i : i + 4096], room)
                        who, found = who + i, mine[at]
                        other = found != names[who]
                        q, d, c = (np.concatenate(v) for v in zip(state[key], (who[other], found[other], cos[other])))
                        part = np.flatnonzero((q >= i) & (q < i + 4096))
                        _, code = np.unique(d[part].astype(str), return_inverse=True)
                        kept = np.concatenate((np.flatnonzero((q < i) | (q >= i + 4096)), part[top(q[part], code, c[part])]))
                        state[key] = q[kept], d[kept], c[kept]
            for (model, _), (q, d, c) in state.items():
                names = asked[model, _][0]
                cols = [pa.array([model] * len(q), pa.string()), pa.array(names[q], pa.string()), pa.array(d, pa.string()), pa.array(c)]
                yield pa.RecordBatch.from_arrays(cols, names=["model_id", "digest", "neighbour", "cosine"])

        return run

    result = None
    for b in range(blocks):
        asked: dict = {}
        table = queries.filter(F.pmod(F.xxhash64("text_digest", "vector"), F.lit(blocks)) == b).toArrow()  # one block of bounded size
        for batch in table.to_batches():
            digests = batch.column(3).to_pylist()
            for model, rows, raw in _usable(batch):
                asked.setdefault((model, raw.shape[1]), []).extend(zip([digests[r] for r in rows], _unit(raw)))
        packed = {m: (np.array([w for w, _ in rows], object), np.stack([v for _, v in rows])) for m, rows in asked.items()}
        part = vectors.mapInArrow(best(context.broadcast(packed)), "model_id string, digest string, neighbour string, cosine double")
        result = part if result is None else result.unionByName(part)
    once = result.groupBy("model_id", "digest", "neighbour").agg(F.max("cosine").alias("cosine"))
    place = Window.partitionBy("model_id", "digest").orderBy(F.desc(F.round("cosine", 9)), "neighbour")
    return once.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)
