"""Registered queries of the training-text problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseek.llm import language, leakage, markup, nearest, neardup, quality, repetition, split, tokens
from loomseek.session import table

Query = Callable[[SparkSession, str], DataFrame]


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies of targets and texts of chunks under one name: tab, rec_key, text."""
    targets = table(spark, folder, "targets").select(F.lit("targets").alias("tab"), F.col("target_key").alias("rec_key"), F.col("body").alias("text"))
    chunks = table(spark, folder, "chunks").select(F.lit("chunks").alias("tab"), F.col("chunk_key").alias("rec_key"), "text")
    return targets.unionByName(chunks)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.found(table(spark, folder, "targets"), ["target_key"], ["title", "body"])


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean(table(spark, folder, "targets"), ["target_key"], ["title", "body"]).distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.record_pairs(records(spark, folder))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(records(spark, folder))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(records(spark, folder))


def stretches(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "targets").select("target_key", "title", "body", F.col("properties")["LANGUAGE"].alias("label"))
    common = quality.read_common(table(spark, folder, "common_words"))
    model = quality.train(targets, "body", "target_key", common)
    languages = language.train(targets, "body", "label", "target_key", common)
    return language.stretches(targets, ["target_key", "label"], ["title", "body"], languages, model, common)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.mislabelled(stretches(spark, folder), ["target_key"], "label", list(language.NAMES))


def p3_stretches(spark: SparkSession, folder: str) -> DataFrame:
    return stretches(spark, folder).drop("label").distinct()


def p3_languages(spark: SparkSession, folder: str) -> DataFrame:
    return language.documents(p3_stretches(spark, folder), ["target_key"], table(spark, folder, "targets", "target_key"))


def statistics(spark: SparkSession, folder: str) -> DataFrame:
    common = quality.read_common(table(spark, folder, "common_words"))
    model = quality.train(table(spark, folder, "targets", "target_key", "body"), "body", "target_key", common)
    behind = F.when(F.col("text").rlike(r"\n[ \t]*\n"), F.regexp_replace("text", r"(?s)\A.*?\n[ \t]*\n", ""))
    mine = records(spark, folder).withColumn("text", F.when(F.col("tab") == "chunks", F.coalesce(behind, "text")).otherwise(F.col("text")))
    return quality.measure(mine, ["tab", "rec_key"], "text", model, common)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.not_prose(statistics(spark, folder), ["tab", "rec_key"])


def p4_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return statistics(spark, folder).distinct()


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics that need no model."""
    rounded = (F.round(c, 6).alias(c) for c in ("mean_word_length", "punctuated_lines"))
    return statistics(spark, folder).select("tab", "rec_key", "characters", "lines", "words", *rounded).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.found(table(spark, folder, "vectors"))


def p5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Exact neighbours of every row whose digest's first 32 bits are divisible by 50, against all rows."""
    vectors = table(spark, folder, "vectors")
    asked = F.conv(F.substring("text_digest", 1, 8), 16, 10).cast("long") % 50 == 0
    got = nearest.nearest(vectors, vectors.filter(asked))
    return got.select("model_id", "digest", "neighbour", F.round("cosine", 6).alias("cosine"), "place")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return split.oversized(records(spark, folder), "text", ["tab", "rec_key"])


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.split(records(spark, folder).distinct(), "text", ["tab", "rec_key"])


def p7_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Of each text what its pieces give put together without their overlaps, and whether sizes, overlaps and order hold."""
    rows = records(spark, folder).distinct().withColumn("digest", F.md5(F.col("text").cast("binary")))
    pieces = split.split(rows, "text", ["tab", "rec_key", "digest"])
    last = F.lag("piece").over(Window.partitionBy("tab", "rec_key", "digest").orderBy("ord"))
    right = (F.length("piece") <= split.LIMIT) & (F.col("repeated") <= split.OVERLAP) & F.endswith(F.coalesce(last, F.lit("")), F.expr("left(piece, repeated)"))
    new = F.struct("ord", F.expr("substr(piece, repeated + 1)").alias("s"))
    whole = pieces.select("tab", "rec_key", "digest", "ord", right.alias("fits"), new.alias("new")).groupBy("tab", "rec_key", "digest")
    parts = whole.agg(F.sort_array(F.collect_list("new")).alias("parts"), F.min("fits").alias("fits"), (F.max("ord") == F.count(F.lit(1)) - 1).alias("in_order"))
    return parts.select("tab", "rec_key", "digest", F.md5(F.array_join("parts.s", "").cast("binary")).alias("rebuilt"), "fits", "in_order")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents", "doc_id", "text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.found(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def p9_matches(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.matches(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.found(table(spark, folder, "documents", "doc_id", "text"))


def p10_lines(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.measure(table(spark, folder, "documents", "doc_id", "text"), cleaned=True)


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of repeated content of every document."""
    got = repetition.measure(table(spark, folder, "documents", "doc_id", "text"))
    return got.select("doc_id", "words", "sequences", "distinct_sequences", F.round("repeated_share", 6).alias("repeated_share"), "repetitive")


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from loomseek.llm.oracle import SQL

    return dict(SQL)
