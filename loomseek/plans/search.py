"""Ranked answers: candidate providers, filters before limits, fusion, and the result-set.

A provider's rows are bounded by its budget before any window or join, so a
search reads the table once per provider and moves only candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseek.config import Config
from loomseek.errors import CapabilityError, QueryError
from loomseek.functions import text
from loomseek.operators import budget, fusion, scoring, textindex
from loomseek.operators.budget import Work
from loomseek.operators.filters import Filters
from loomseek.session import cut, fresh_path

MODES = ("exact", "lexical", "fuzzy", "semantic")

#: (query, filters, limit) -> DataFrame(key, score, z), at most ``limit`` rows
SemanticProvider = Callable[[str, Filters, int], DataFrame]


@dataclass
class Corpus:
    """What a search reads: target rows, and if there are any its index, the sources' present digests and a semantic provider."""

    targets: DataFrame
    index: DataFrame | None = None
    stats: DataFrame | None = None
    current: DataFrame | None = None
    semantic: SemanticProvider | None = None
    config: Config = field(default_factory=Config)


@dataclass
class ResultSet:
    """A ranked answer with what is known about its completeness and freshness."""

    query: str
    requested: list[str]
    used: list[str]
    degraded: str | bool
    freshness: str
    limit: int
    completeness: str
    truncated: bool
    work_examined: int
    provider_errors: list[dict]
    results: DataFrame

    def to_dict(self) -> dict:
        rows = [r.asDict(True) for r in self.results.orderBy("rank").collect()]  # at most ``limit`` rows
        return {
            "schema_version": 1, "query": self.query, "requested": {m: True for m in self.requested}, "used": self.used, "degraded": self.degraded, "freshness": self.freshness,
            "limit": self.limit, "candidate_count": len(rows), "completeness": self.completeness, "truncated": self.truncated, "work_examined": self.work_examined,
            "provider_errors": self.provider_errors, "results": rows,
        }


def default_modes(corpus: Corpus) -> list[str]:
    """All modes that the corpus can serve."""
    return ["exact", "lexical", "fuzzy"] + ["semantic"] * (corpus.semantic is not None)


def exact_title(targets: DataFrame, title: str, limit: int | None = None, config: Config = Config()) -> DataFrame:
    """Targets with exactly this title, in the order of path and position."""
    return targets.filter(F.col("title") == title).orderBy("path", "position").limit(config.limit(limit))


def alias_rows(targets: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """File rows that mention one of the properties at all."""
    blob = F.lower(F.to_json("properties"))
    hit = F.lit(False)
    for n in names:
        hit = hit | F.contains(blob, F.lit(n.lower()))
    return targets.filter((F.col("kind") == "file") & F.coalesce(hit, F.lit(False)))


def alias_match(names: tuple[str, ...], query: str) -> Column:
    """Whether one alias of the row is the query; case ignored, no part of one."""
    wanted = F.lit(query.strip().lower())
    hit = F.lit(False)
    for n in names:
        hit = hit | F.array_contains(F.transform(text.aliases(text.prop(F.col("properties"), n)), lambda a: F.lower(a)), wanted)
    return F.coalesce(hit, F.lit(False))


def fuzzy_candidates(targets: DataFrame, query: str) -> DataFrame:
    """Targets that share a padded trigram of the query with their lower-case title."""
    grams = text.trigrams(query.strip())
    title = F.lower(F.coalesce("title", F.lit("")))
    return targets.filter(F.exists(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(title, g)))


def fuzzy_scored(targets: DataFrame, query: str, candidates: int) -> DataFrame:
    """The first candidates in the order of titles with their similarity, from 60 on."""
    first = fuzzy_candidates(targets, query).orderBy("title", "path", "position").limit(candidates)
    return first.withColumn("similarity", text.similarity(F.col("title"), query.strip())).filter("similarity >= 60")


def fuzzy_order() -> list[Column]:
    return [F.desc("similarity"), F.desc("title"), F.desc("path"), F.desc("position")]


def _read(rows: DataFrame, order: list[Column], filters: Filters, extra: Column, limit: int, left: int, corpus: Corpus) -> tuple[DataFrame, Work]:
    """A provider's eligible rows up to the limit, and the work it took."""
    numbered = budget.number(rows, order, left, filters.column() & extra)
    w = budget.account(numbered, limit, left, corpus.config.page()).first()
    seen = numbered.filter(F.col("place") <= w["examined"])
    return seen.filter(F.col("eligible") & (F.col("nth") <= limit)), Work(w["examined"], w["incomplete"], w["extra"], _stale(seen, corpus))


def _stale(rows: DataFrame, corpus: Corpus) -> bool:
    """Whether a source of one of the (bounded) rows is gone or changed."""
    if corpus.current is None:
        return False
    now = corpus.current.select(F.col("path").alias("p"), F.col("digest").alias("d"))
    checked = rows.select("path", "digest").distinct().join(now, F.col("path") == F.col("p"), "left")
    return bool(checked.filter(~F.col("d").eqNullSafe(F.col("digest"))).limit(1).count())


def semantic_provider(embed_query: Callable[[str], list[float]], vectors: DataFrame, chunks: DataFrame, targets: DataFrame, config: Config = Config(), prefilter: bool = False, prepared: str | None = None) -> SemanticProvider:
    """Centred, hub-corrected search in the vectors of the configured model.

    Filters apply to the best chunks, or with ``prefilter`` to the pool.
    ``prepared`` is where ``scoring.prepare`` has written these vectors;
    without it they are written now.
    """
    spark = vectors.sparkSession
    if prepared is None:
        prepared = fresh_path(spark, "vectors")
        rows = vectors.filter(F.col("model_id") == config.model).select(F.col("text_digest").alias("digest"), "vector")
        scoring.prepare(rows, prepared, config=config)
    mean, cent, hub = scoring.prepared(spark, prepared)

    def search(query: str, filters: Filters, limit: int) -> DataFrame:
        k = min(200, max(50, limit * 5))
        allowed = targets.filter(filters.column()).select(F.col("key").alias("target_key"))
        pool = chunks.join(allowed, "target_key", "left_semi").select(F.col("text_digest").alias("digest")) if prefilter else None
        best = scoring.top(scoring.score(cent, hub, mean, embed_query(query), config, digests=pool), k, config)
        hits = scoring.target_hits(best, chunks).join(allowed, "target_key", "left_semi")
        return hits.orderBy(F.desc("score"), "target_key").limit(min(limit, config.semantic_hits)).select(F.col("target_key").alias("key"), "score", "z")

    return search


def search_api(corpus: Corpus, query: str, limit: int | None = None, fuzzy: bool = False, filters: Filters = Filters(), modes: list[str] | None = None) -> ResultSet:
    """The versioned, bounded answer to a query.

    A provider that fails is listed and the others still run. An empty corpus
    gives a complete, empty answer.
    """
    if not isinstance(query, str):
        raise QueryError("a query string is required")
    c = corpus.config
    limit = c.limit(limit)
    modes = list(modes) if modes else ["exact", "lexical"] + ["fuzzy"] * fuzzy
    if bad := [m for m in modes if m not in MODES]:
        raise QueryError(f"unknown modes: {bad}")
    filters = filters.normalized()
    pool, left = max(limit, c.pool_size), c.work_budget
    targets = corpus.targets
    parts: list[DataFrame] = []
    used: list[str] = []
    errors: list[dict] = []
    work: list[Work] = []

    def run(mode: str, provider: Callable[[], tuple[DataFrame, Work]]) -> None:
        nonlocal left
        try:
            part, w = provider()
        except Exception as e:
            errors.append({"provider": mode, "message": str(e).split("\n")[0]})
            return
        parts.append(part)
        work.append(w)
        left -= w.examined
        if mode not in used:
            used.append(mode)

    def semantic() -> tuple[DataFrame, Work]:
        if corpus.semantic is None:
            raise CapabilityError("no semantic provider is configured")
        rows = corpus.semantic(query, filters, pool)
        stale = _stale(rows.select("key").join(targets.select("key", "path", "digest"), "key"), corpus)
        return fusion.hits(rows, "semantic", fusion.SEMANTIC, [F.desc("score"), F.asc("key")], F.col("score"), F.col("z")), Work(0, False, False, stale)

    def exact() -> tuple[DataFrame, Work]:
        rows, w = _read(targets.filter(F.col("title") == query), [F.asc("path"), F.asc("position")], filters, F.lit(True), pool, left, corpus)
        return fusion.hits(rows, "exact", fusion.EXACT, [F.asc("place")]), w

    def alias() -> tuple[DataFrame, Work]:
        rows, w = _read(alias_rows(targets, c.alias_properties), [F.asc("path")], filters, alias_match(c.alias_properties, query), pool, left, corpus)
        return fusion.hits(rows, "exact", fusion.ALIAS, [F.asc("place")]), w

    def lexical() -> tuple[DataFrame, Work]:
        ranked = textindex.search(targets, query, corpus.index, corpus.stats).join(targets, "key")
        rows, w = _read(ranked, [F.desc("bm25"), F.asc("path"), F.asc("position")], filters, F.lit(True), pool, left, corpus)
        return fusion.hits(rows, "lexical", fusion.LEXICAL, [F.asc("place")]), w

    def fuzzy_titles() -> tuple[DataFrame, Work]:
        cap = min(left, c.fuzzy_candidates)
        first = fuzzy_candidates(targets, query).orderBy("title", "path", "position").limit(cap)
        scored = first.withColumn("eligible", filters.column()).withColumn("similarity", text.similarity(F.col("title"), query.strip()))
        good = F.col("eligible") & (F.col("similarity") >= 60)
        n = scored.agg(F.count(F.lit(1)).alias("examined"), F.count(F.when(good, 1)).alias("good")).first()
        extra = n["good"] > pool
        incomplete = n["examined"] >= cap and not extra and left <= c.fuzzy_candidates
        rows = scored.filter(good).orderBy(*fuzzy_order()).limit(pool)
        return fusion.hits(rows, "fuzzy", fusion.FUZZY, fuzzy_order(), F.col("similarity") * 0.84), Work(n["examined"], incomplete, extra, _stale(first, corpus))

    if "semantic" in modes:
        run("semantic", semantic)
    if "exact" in modes and left > 0:
        run("exact", exact)
        if c.alias_properties and left > 0:
            run("exact", alias)
    if "lexical" in modes and left > 0 and query.split():
        run("lexical", lexical)
    if ("fuzzy" in modes or fuzzy) and left > 0 and query.strip():
        run("fuzzy", fuzzy_titles)

    if parts:
        fused = cut(fusion.fuse(parts, c), "fused")  # at most the pools' rows
        found = fused.count()
        results = fusion.finish(fused, targets, limit)
    else:
        found = 0
        results = fusion.finish(fusion.fuse([fusion.hits(targets.limit(0), "exact", fusion.EXACT, [F.asc("key")])], c), targets, limit)
    if corpus.current is not None:
        now = corpus.current.select(F.col("path").alias("p"), F.col("digest").alias("d"))
        results = results.join(now, F.col("path") == F.col("p"), "left").withColumn("source_current", F.col("d").eqNullSafe(F.col("digest"))).drop("p", "d")
    else:
        results = results.withColumn("source_current", F.lit(True))
    incomplete, extra = any(w.incomplete for w in work), any(w.extra for w in work) or found > limit
    stale = any(w.stale for w in work)
    return ResultSet(
        query=query, requested=modes, used=used, degraded="provider-error" if errors else "incomplete" if incomplete else False,
        freshness="stale-source-present" if stale else "sources-checked-current" if found else "index-checked", limit=limit,
        completeness="incomplete" if incomplete or errors else "truncated" if extra else "complete",
        truncated=bool(incomplete or errors or extra), work_examined=c.work_budget - left, provider_errors=errors, results=results,
    )


def search(corpus: Corpus, query: str, limit: int | None = None, fuzzy: bool = False) -> DataFrame:
    """The results alone."""
    return search_api(corpus, query, limit, fuzzy).results
