"""Centred and hub-corrected similarity of a query to stored vectors.

Vectors are centred on the corpus mean and renormalised. A vector's hub is the
mean similarity to its nearest others; what is close to everything is worth
less. score = cosine - lambda * hub; z tells how far a score stands out of the
pool of candidates.

``hubs`` is quadratic by definition: rows are sent in blocks of bounded size
to every task, each of which keeps the best similarities per row. ``prepare``
writes centred vectors and hubs, once per version of the vectors; searches
read them from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomseek.config import Config
from loomseek.functions import vectors as V


def mean_vector(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """(pos, mean) of each component."""
    return rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def mean_array(rows: DataFrame, vector: str = "vector") -> list[float]:
    """The mean on the driver: as many numbers as the vectors have."""
    return [r["mean"] for r in sorted(mean_vector(rows, vector).collect(), key=lambda r: r["pos"])]


def centred(rows: DataFrame, mean: list[float], key: str = "digest", vector: str = "vector") -> DataFrame:
    """(key, c): centred vectors of unit length, norms floored at 1e-12."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.array(mean)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy()).astype(np.float64) - m
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({key: pdf[key], "c": list(x)})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, vector).mapInPandas(run, f"{key} {kind}, c array<double>")


def hubs(cent: DataFrame, key: str = "digest", neighbours: int = 10, block: int = 16384) -> DataFrame:
    """(key, hub): mean of the similarities to the ``neighbours`` most similar other rows; 0 if there is none.

    Keys must be unique. A block of rows goes to all tasks at a time; ``cent``
    is read once for each block and should be a written table.
    """
    kind = cent.schema[key].dataType.simpleString()
    context = cent.sparkSession.sparkContext
    kind_of_key = to_arrow_type(cent.schema[key].dataType)
    blocks = max(1, -(-cent.count() // block))
    result = None
    for b in range(blocks):
        mine = cent.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toArrow()  # about ``block`` rows
        if not mine.num_rows:
            continue
        shared = context.broadcast((mine.column(0).to_pylist(), _matrix(mine.column(1).combine_chunks())))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            places, q32 = {k: i for i, k in enumerate(ids)}, q.astype(np.float32)
            top = np.full((len(ids), neighbours), -np.inf)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(1))
                x32 = x.astype(np.float32)
                same = [(places[k], j) for j, k in enumerate(batch.column(0).to_pylist()) if k in places]
                mine, other = np.array(same, np.int64).reshape(-1, 2).T
                for i in range(0, len(ids), 1024):
                    s = q32[i : i + 1024] @ x32.T
                    here = (mine >= i) & (mine < i + 1024)
                    s[mine[here] - i, other[here]] = -np.inf
                    k = min(neighbours, s.shape[1])
                    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    exact = np.einsum("ij,ikj->ik", q[i : i + 1024], x[at])
                    exact[~np.isfinite(np.take_along_axis(s, at, 1))] = -np.inf
                    both = np.concatenate((top[i : i + 1024], exact), axis=1)
                    top[i : i + 1024] = -np.partition(-both, neighbours - 1, axis=1)[:, :neighbours]
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind_of_key), pa.array([r[np.isfinite(r)] for r in top], pa.list_(pa.float64()))], names=[key, "s"])

        part = cent.mapInArrow(best, f"{key} {kind}, s array<double>")
        result = part if result is None else result.unionByName(part)
    if result is None:
        return cent.select(key, F.lit(0.0).alias("hub"))
    merged = result.groupBy(key).agg(F.slice(F.sort_array(F.flatten(F.collect_list("s")), asc=False), 1, neighbours).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return merged.select(key, F.when(F.size("s") > 0, total / F.size("s")).otherwise(0.0).alias("hub"))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1).astype(np.float64)


def prepare(rows: DataFrame, path: str, key: str = "digest", config: Config = Config()) -> None:
    """Write the centred vectors of rows (key, vector) with their hubs, and the mean, below ``path``."""
    spark = rows.sparkSession
    mean = mean_array(rows)
    spark.createDataFrame([(mean,)], "mean array<double>").write.parquet(f"{path}/mean")
    centred(rows, mean, key).write.parquet(f"{path}/centred")
    cent = spark.read.parquet(f"{path}/centred")
    hubs(cent, key, config.hub_neighbours, config.hub_block).write.parquet(f"{path}/hubs")


def prepared(spark: SparkSession, path: str) -> tuple[list[float], DataFrame, DataFrame]:
    """(mean, centred rows, hubs) as they were written."""
    mean = spark.read.parquet(f"{path}/mean").first()["mean"]
    return list(mean), spark.read.parquet(f"{path}/centred"), spark.read.parquet(f"{path}/hubs")


def score(cent: DataFrame, hub: DataFrame, mean: list[float], query: list[float], config: Config = Config(), key: str = "digest", digests: DataFrame | None = None) -> DataFrame:
    """(key, cosine, score, z, pool) of every candidate; ``digests`` restricts the pool only."""
    q = np.array(query, float) - np.array(mean)
    q = q / max(np.linalg.norm(q), 1e-12)
    cosine = V.dot(F.col("c"), F.array(*[F.lit(float(x)) for x in q]))
    scored = cent.join(hub, key).select(key, cosine.alias("cosine"), (cosine - config.hub_lambda * F.col("hub")).alias("score"))
    if digests is not None:
        scored = scored.join(digests.select(key).distinct(), key, "left_semi")
    # one struct of scalars, computed once
    stats = scored.agg(F.struct(F.median("score").alias("middle"), F.stddev_pop("score").alias("spread"), F.count(F.lit(1)).alias("pool"))).scalar()
    out = scored.withColumn("stats", stats)
    spread = F.when(F.col("stats.spread") == 0, 1e-9).otherwise(F.col("stats.spread"))
    return out.select(key, "cosine", "score", ((F.col("score") - F.col("stats.middle")) / spread).alias("z"), F.col("stats.pool").alias("pool"))


def gate(config: Config) -> Column:
    """Keeps what stands out, if the pool is large enough to tell."""
    return (F.col("pool") < config.min_pool_for_z) | (F.col("z") >= config.semantic_min_z)


def top(scored: DataFrame, k: int, config: Config = Config(), key: str = "digest") -> DataFrame:
    return scored.filter(gate(config)).orderBy(F.desc("score"), key).limit(max(0, k))


def target_hits(scored: DataFrame, chunks: DataFrame) -> DataFrame:
    """(target_key, score, z): the best chunk of each target. A text under several targets belongs to the smallest key."""
    owner = chunks.groupBy("text_digest").agg(F.min("target_key").alias("target_key"))
    per = scored.select(F.col("digest").alias("text_digest"), "score", "z").join(owner, "text_digest")
    return per.groupBy("target_key").agg(F.max("score").alias("score"), F.max_by("z", "score").alias("z"))
