"""Settings, with the defaults that ranked answers depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Root:
    """A named folder of sources. Patterns match the path below the folder; no include selects all."""

    name: str
    path: str
    includes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    roots: tuple[Root, ...] = ()
    search_limit: int = 20
    most_results: int = 100
    work_budget: int = 2000
    page_size: int = 100
    most_page: int = 200
    fuzzy_candidates: int = 500
    alias_properties: tuple[str, ...] = ()
    model: str = "e5-small"
    reconcile_seconds: int = 600
    pool_size: int = 50
    weights: dict[str, float] = field(default_factory=lambda: {"exact": 1.0, "semantic": 1.0, "lexical": 0.8, "fuzzy": 0.3})
    fusion_k: int = 60
    semantic_min_z: float = 3.0
    hub_lambda: float = 0.5
    semantic_hits: int = 10
    hub_neighbours: int = 10
    min_pool_for_z: int = 10
    hub_block: int = 16384
    chunk_chars: int = 1500
    chunk_overlap: int = 300
    outline_depth: int = 2
    chunk_words: int = 6
    embed_batch: int = 32
    outline_headings: int = 500

    def limit(self, asked: int | None) -> int:
        return max(1, min(self.most_results, asked or self.search_limit))

    def page(self) -> int:
        return max(1, min(self.most_page, self.page_size))


@dataclass(frozen=True)
class Preset:
    """An embedding model."""

    name: str
    dimension: int
    pooling: str
    query_prefix: str
    passage_prefix: str
    most_tokens: int
    model_id: str = ""


#: The known models.
PRESETS = {
    "e5-small": Preset("e5-small", 384, "mean", "query: ", "passage: ", 512, "intfloat/multilingual-e5-small"),
    "e5-base": Preset("e5-base", 768, "mean", "query: ", "passage: ", 512, "intfloat/multilingual-e5-base"),
    "bge-m3": Preset("bge-m3", 1024, "cls", "", "", 8192, "BAAI/bge-m3"),
}


def read_presets(spark, path: str) -> dict[str, Preset]:
    """Presets from a JSON file of objects with the fields of Preset; model_id may be missing."""
    df = spark.read.option("multiLine", True).json(path)
    rows = df.select(*(n for n in Preset.__dataclass_fields__ if n != "model_id" or n in df.columns)).collect()
    return {r["name"]: Preset(**r.asDict()) for r in rows}
