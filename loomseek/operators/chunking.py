"""Passages to embed from target rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseek.config import Config
from loomseek.functions import text
from loomseek.operators.joins import lookup


def file_outlines(targets: DataFrame, depth: int = 2) -> DataFrame:
    """(path, file_title, outline): the file's title, and titles of its shallow headings in order."""
    shallow = F.when((F.col("kind") == "heading") & (F.col("level") <= depth), F.struct("position", "title"))
    return targets.groupBy("path").agg(
        F.min_by("title", "position").alias("first_title"), F.max(F.when(F.col("kind") == "file", F.col("title"))).alias("file_title"),
        F.array_join(F.transform(F.sort_array(F.collect_list(shallow)), lambda x: x["title"]), "\n").alias("outline"),
    ).drop("first_title")


def passages(targets: DataFrame, config: Config = Config()) -> DataFrame:
    """(key, path, text): a file's title, outline and body; a heading's context and body.

    A heading with too few words gets its file's title in front.
    """
    about = file_outlines(targets, config.outline_depth)
    is_file = F.coalesce(F.col("kind") == "file", F.lit(False))
    # an outline belongs to one row; the many headings of a file need its title only
    files = targets.filter(is_file).join(about, "path")
    headings = lookup(targets.filter(~is_file), about.select("path", "file_title"), "path", "key").withColumn("outline", F.lit(None).cast("string"))
    return passage_rows(files.unionByName(headings), config)


def passage_rows(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """The same of target rows that know their file's title and outline."""
    body = text.strip_noise(F.col("body"))
    context = text.context_line()
    short = text.word_count(F.concat_ws(" ", context, body)) < config.chunk_words
    file = F.concat_ws("\n", "title", "outline", body)
    heading = F.concat_ws("\n\n", F.when(short, F.col("file_title")), context, body)
    return rows.select("key", "path", F.when(F.col("kind") == "file", file).otherwise(heading).alias("text"))


def chunks(targets: DataFrame, config: Config = Config(), dedup: bool = False) -> DataFrame:
    """(key, target_key, path, ord, text, text_digest). ord counts all windows, also those left out for too few words."""
    return windowed(passages(targets, config), config, dedup)


def windowed(rows: DataFrame, config: Config = Config(), dedup: bool = False) -> DataFrame:
    """The same from passages."""
    cut = rows.select("key", "path", F.posexplode(text.windows(F.col("text"), config.chunk_chars, config.chunk_overlap, dedup)).alias("ord", "text"))
    kept = cut.filter(text.word_count(F.col("text")) >= config.chunk_words)
    return kept.select(F.concat("key", F.lit("#chunk:"), F.col("ord").cast("string")).alias("key"), F.col("key").alias("target_key"), "path", "ord", "text", text.digest(F.col("text")).alias("text_digest"))


def coverage(chunk_rows: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """One row (covered, total), counted in chunk rows."""
    have = vectors.filter(F.col("model_id") == model).select("text_digest").distinct().withColumn("there", F.lit(1))
    return chunk_rows.select("text_digest").join(have, "text_digest", "left").agg(F.count("there").alias("covered"), F.count(F.lit(1)).alias("total"))


def pending(chunk_rows: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(text_digest, text) that have no vector of the model, each digest once."""
    have = vectors.filter(F.col("model_id") == model).select("text_digest")
    return chunk_rows.select("text_digest", "text").join(have, "text_digest", "left_anti").groupBy("text_digest").agg(F.min("text").alias("text"))
