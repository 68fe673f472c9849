"""Weighted reciprocal-rank fusion of ranked candidate lists.

Every provider gives (key, mode, seq, rank, raw_score, z), rank from 0 inside
its list and seq the provider's place among the providers. Exact hits are
pinned above the fused order; ties keep the order in which the providers, and
inside them the ranks, came.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseek.config import Config
from loomseek.functions import text

#: Rows of an answer that are sent to the targets; a longer answer is joined.
MOST_SENT = 10_000
#: Places of the providers.
SEMANTIC, EXACT, ALIAS, LEXICAL, FUZZY = range(5)


def contribution(mode: Column, rank: Column, z: Column, config: Config) -> Column:
    """What one hit adds to the fused score."""
    weight = F.lit(0.0)
    for name, w in config.weights.items():
        weight = F.when(mode == name, F.lit(float(w))).otherwise(weight)
    sure = F.when((mode == "semantic") & z.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), z / 5.0))).otherwise(F.lit(1.0))
    return weight * sure / (F.lit(float(config.fusion_k)) + rank + 1)


def raw_score(mode: Column, rank: Column, score: Column) -> Column:
    """A provider's own score, or one made from the rank."""
    return F.coalesce(score, F.when(mode == "exact", F.lit(100.0)).otherwise(F.greatest(F.lit(85.0), 94.0 - rank * 0.01)))


def hits(rows: DataFrame, mode: str, seq: int, order: list[Column], score: Column | None = None, z: Column | None = None) -> DataFrame:
    """Ranked hits of one provider; ``rows`` must be bounded, for their order is one window."""
    ranked = rows.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))
    raw = raw_score(F.lit(mode), F.col("rank"), F.lit(None).cast("double") if score is None else score)
    return ranked.select("key", F.lit(mode).alias("mode"), F.lit(seq).alias("seq"), "rank", raw.cast("double").alias("raw_score"), (F.lit(None) if z is None else z).cast("double").alias("z"))


def fuse(parts: list[DataFrame], config: Config = Config()) -> DataFrame:
    """(key, score, pinned, match_type, modes, first_seq, first_rank) of each hit target."""
    all_hits = reduce(DataFrame.unionByName, parts)
    c = contribution(F.col("mode"), F.col("rank"), F.col("z"), config)
    scored = all_hits.withColumn("c", c)
    # of equal contributions the later provider's is the strongest; its modes come latest first
    entry = F.struct((-F.col("seq")).alias("o"), "mode", "rank", "raw_score", "z", "c")
    fused = scored.groupBy("key").agg(
        F.sum("c").alias("score"),
        F.max((F.col("mode") == "exact").cast("int")).cast("boolean").alias("pinned"),
        F.max_by("mode", F.struct("c", "seq")).alias("match_type"),
        F.sort_array(F.collect_list(entry)).alias("entries"),
        F.min(F.struct("seq", "rank")).alias("first"),
    )
    return fused.select("key", "score", "pinned", "match_type", "entries", F.col("first.seq").alias("first_seq"), F.col("first.rank").alias("first_rank"))


def order() -> list[Column]:
    """The final order of fused rows."""
    return [F.desc("pinned"), F.desc("score"), F.asc("first_seq"), F.asc("first_rank")]


def _strongest_first(entries: Column) -> Column:
    return F.array_sort(entries, lambda a, b: F.when(a["c"] > b["c"], -1).when(a["c"] < b["c"], 1).when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))


def modes(entries: Column = F.col) -> Column:
    """(mode, rank, raw_score, z) of the contributions, the latest provider first."""
    e = F.col("entries") if entries is F.col else entries
    return F.transform(e, lambda x: F.struct(x["mode"].alias("mode"), x["rank"].alias("rank"), x["raw_score"].alias("raw_score"), x["z"].alias("z")))


def match_reason() -> Column:
    """Contributions in words, the strongest first."""

    def say(x: Column) -> Column:
        plain = F.concat(x["mode"], F.lit(" #"), (x["rank"] + 1).cast("string"))
        return F.when(x["z"].isNull(), plain).otherwise(F.concat(plain, F.lit(" z"), F.format_string("%.1f", x["z"])))

    return F.array_join(F.transform(_strongest_first(F.col("entries")), say), " + ")


def modes_summary() -> Column:
    """The same in short, as for a column of a list."""
    short = lambda m: F.when(m == "lexical", "lex").when(m == "semantic", "sem").otherwise(m)

    def say(x: Column) -> Column:
        return F.when((x["mode"] == "semantic") & x["z"].isNotNull(), F.concat(F.lit("sem"), F.rint(x["z"]).cast("int").cast("string"))).otherwise(short(x["mode"]))

    return F.array_join(F.transform(_strongest_first(F.col("entries")), say), "+")


def finish(fused: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """The ranked answer: the best ``limit`` fused rows with their targets' fields, rank, margin, reason and link."""
    top = fused.orderBy(*order()).limit(limit)
    w = Window.orderBy(*order())  # over at most ``limit`` rows
    ranked = top.withColumn("result_rank", F.row_number().over(w)).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    joined = (F.broadcast(ranked) if limit <= MOST_SENT else ranked).join(targets, "key")
    return joined.select(
        F.col("result_rank").alias("rank"), "key", "path", "kind", "title", "org_id", "position", "digest", F.substring("body", 1, 160).alias("snippet"), "level", "outline_path", "properties",
        "match_type", modes().alias("modes"), "score", "pinned", "margin", match_reason().alias("match_reason"), text.link().alias("link"), modes_summary().alias("via"),
    )


def group_results(results: DataFrame) -> DataFrame:
    """Fuzzy headings of one file and title as one row: (lead_key, title, n, keys, pinned, score, rank)."""
    groupable = (F.col("match_type") == "fuzzy") & (F.col("kind") == "heading")
    group = F.when(groupable, F.concat_ws("\x1f", F.lit("g"), "path", "title")).otherwise(F.concat_ws("\x1f", F.lit("k"), "key"))
    best = F.struct(F.col("pinned").cast("int").alias("p"), F.col("score").alias("s"), (-F.col("rank")).alias("r"))
    return results.groupBy(group.alias("group")).agg(
        F.max_by("key", best).alias("lead_key"), F.max_by("title", best).alias("title"), F.count(F.lit(1)).cast("int").alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("keys"), F.max("pinned").alias("pinned"), F.max("score").alias("score"), F.min("rank").alias("rank"),
    ).drop("group")


def display(results: DataFrame) -> DataFrame:
    """Rows of a results list."""
    return results.select("key", F.coalesce("title", F.lit("")).alias("title"), "kind", F.regexp_extract("path", "([^/]*)$", 1).alias("source"), "match_type", F.when(F.col("source_current"), "yes").otherwise("stale").alias("fresh"), "via")
