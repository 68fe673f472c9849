"""Embedding as a service: a set of vectors under digests, and requests as dicts.

Vectors are kept in a versioned table; centred vectors and hubs are written
once for a version, at the first search after a change. ``handle`` never
raises: an error is an answer with its type and message.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek.config import Config, Preset
from loomseek.errors import QueryError
from loomseek.functions import vectors as V
from loomseek.operators import scoring
from loomseek.operators.manifest import VersionedTable

LOADED = T.StructType([T.StructField("digest", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])


@dataclass
class EmbeddingService:
    """``embed`` makes the column of vectors of a column of texts, ``tokens`` counts what the model would read of a text."""

    spark: SparkSession
    path: str
    preset: Preset
    embed_column: Callable[[Column], Column]
    tokens: Callable[[Column], Column] = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda t: t != ""))
    config: Config = Config()

    def __post_init__(self):
        self.table = VersionedTable(self.spark, f"{self.path}/vectors", LOADED)

    def hello(self) -> dict:
        """What the model says about itself."""
        return V.model_info(self.preset)

    def embedded(self, texts: DataFrame, kind: str = "passage") -> DataFrame:
        """texts (text, ...) with vector, and truncated for those that the model reads in part only."""
        prefixed = F.concat(F.lit(self.preset.query_prefix if kind == "query" else self.preset.passage_prefix), F.coalesce("text", F.lit("")))
        read = texts.withColumn("read", prefixed).withColumn("raw", self.embed_column(F.col("read")))
        return read.withColumn("vector", V.normalize(F.col("raw"))).withColumn("truncated", self.tokens(F.col("read")) > self.preset.most_tokens).drop("read", "raw")

    def embed(self, texts: list[str], kind: str = "passage") -> dict:
        """Vectors of a few texts, in order, and how many were cut."""
        rows = self.spark.createDataFrame(list(enumerate(texts)), "n int, text string")
        made = self.embedded(rows, kind).withColumn("vector", F.col("vector").cast("array<float>"))
        got = made.select("n", V.encode_vector("vector").alias("coded"), "truncated").orderBy("n").collect()
        return {"vectors": [r["coded"] for r in got], "truncated": sum(r["truncated"] for r in got)}

    def load_rows(self, rows: DataFrame) -> int:
        """Add (digest, vector) rows, replacing those with the same digest; vectors of another length are an error."""
        if rows.filter(F.size("vector") != self.preset.dimension).limit(1).count():
            raise QueryError(f"vectors must have {self.preset.dimension} values")
        kept = rows.dropDuplicates(["digest"])
        self.table.commit(kept, kept, ["digest"])
        return kept.count()

    def load(self, items: list[dict]) -> dict:
        rows = self.spark.createDataFrame([(i["digest"], i["vector"]) for i in items], "digest string, coded string")
        self.load_rows(rows.select("digest", V.decode_vector("coded").alias("vector")))
        return {"loaded": len(items)}

    def unload(self, digests: list[str]) -> dict:
        gone = self.spark.createDataFrame([(d,) for d in digests], "digest string")
        n = self.table.read().join(gone, "digest", "left_semi").count()
        if n:
            self.table.commit(None, gone, ["digest"])
        return {"unloaded": n}

    def prepared(self) -> str:
        """Where the centred vectors and hubs of the present version are."""
        at = f"{self.path}/prepared/{self.table.latest().version}"
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/hubs/_SUCCESS")
        if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            scoring.prepare(self.table.read(), at, config=self.config)
        return at

    def search_rows(self, query: str, digests: DataFrame | None = None, config: Config | None = None) -> DataFrame:
        """(digest, cosine, score, z, pool) of all candidates."""
        mean, cent, hub = scoring.prepared(self.spark, self.prepared())
        asked = self.embedded(self.spark.createDataFrame([(query,)], "text string"), "query").first()["vector"]
        return scoring.score(cent, hub, mean, asked, config or self.config, digests=digests)

    def search(self, query: str, k: int = 10, digests: list[str] | None = None, min_z: float | None = None, hub_lambda: float = 0.5, min_pool_for_z: int = 10) -> dict:
        if not self.table.read().limit(1).count():
            return {"results": []}
        c = Config(hub_lambda=hub_lambda, semantic_min_z=float("-inf") if min_z is None else min_z, min_pool_for_z=min_pool_for_z)
        pool = None if digests is None else self.spark.createDataFrame([(d,) for d in digests], "digest string")
        rows = scoring.top(self.search_rows(query, pool, c), k, c).collect()  # at most k rows
        return {"results": [{n: r[n] for n in ("digest", "score", "cosine", "z")} for r in rows]}

    def handle(self, request: dict) -> dict:
        """The answer to {id, op, ...}: {id, result} or {id, error: {type, message}}."""
        operations = {"hello": self.hello, "embed": self.embed, "load": self.load, "unload": self.unload, "search": self.search}
        try:
            if request.get("op") not in operations:
                raise QueryError(f"unknown operation: {request.get('op')!r}")
            rest = {k: v for k, v in request.items() if k not in ("id", "op")}
            return {"id": request.get("id"), "result": operations[request["op"]](**rest)}
        except Exception as e:
            return {"id": request.get("id"), "error": {"type": type(e).__name__, "message": str(e).split("\n")[0]}}


def self_test(service: EmbeddingService, query: str, paraphrase: str, distractor: str) -> bool:
    """Whether a text with the query's meaning comes before one without."""
    rows = service.spark.createDataFrame([("paraphrase", paraphrase), ("distractor", distractor)], "digest string, text string")
    service.load_rows(service.embedded(rows).select("digest", F.col("vector").cast("array<float>").alias("vector")))
    return service.search(query, 1)["results"][0]["digest"] == "paraphrase"
