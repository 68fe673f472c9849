"""Tables as corpora of target rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseek.operators import scoring, textindex
from loomseek.operators.incremental import usable_rows
from loomseek.operators.store import latest
from loomseek.session import stored, table

#: Columns of the model and of the stored tables.
_NAMES = {"key": "target_key", "position": "char_position", "level": "heading_level"}
COLUMNS = ("key", "path", "kind", "title", "body", "org_id", "position", "digest", "level", "outline_path", "properties")


def notes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Targets, each key as it was indexed last, with the columns asked for.

    The repeated deliveries are settled once and stored, so a query reads its
    columns alone, and its filters reach the scan.
    """

    def write(path: str) -> None:
        raw = table(spark, folder, "targets").select(*(F.col(_NAMES.get(c, c)).alias(c) for c in COLUMNS), "indexed_at")
        last = latest(raw, ["key"], "indexed_at", *(c for c in COLUMNS if c != "key")).select(*COLUMNS)
        last.sortWithinPartitions("path", "position").write.parquet(path)

    stored_notes = spark.read.parquet(stored(spark, "notes", [f"{folder}/targets.parquet"], write))
    return stored_notes.select(*(columns or COLUMNS))


def text_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of the notes, made once and stored."""
    rows = notes(spark, folder, "key", "title", "body")
    inputs = [f"{folder}/targets.parquet"]
    index = stored(spark, "postings", inputs, lambda path: textindex.write_index(textindex.postings(rows), path))
    stats = stored(spark, "lengths", inputs, lambda path: textindex.doc_stats(rows).write.parquet(path))
    return spark.read.parquet(index), spark.read.parquet(stats)


def passages(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Chunks, repeated rows once."""
    raw = table(spark, folder, "chunks").withColumnRenamed("chunk_key", "key")
    return raw.select(*(columns or raw.columns)).distinct()


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as headings: the name is the title, the type the body."""
    p = table(spark, folder, "part")
    path = F.concat(F.lit("/parts/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"))
    return p.select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"), path.alias("path"), F.lit("heading").alias("kind"), F.col("p_name").alias("title"), F.col("p_type").alias("body"),
        F.lit(None).cast("string").alias("org_id"), F.col("p_size").cast("bigint").alias("position"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("digest"),
        F.lit(1).alias("level"), F.array("p_brand", "p_name").alias("outline_path"), F.create_map(F.lit("BRAND"), "p_brand", F.lit("TYPE"), "p_type").alias("properties"),
    )


def embedded(spark: SparkSession, folder: str) -> DataFrame:
    """Stored vectors under a digest."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("digest"), F.col("embedding").alias("vector"))


def prepared_vectors(spark: SparkSession, folder: str) -> tuple[list[float], DataFrame, DataFrame]:
    """(mean, centred rows, hubs) of the embeddings, computed once for these vectors."""
    path = stored(spark, "vectors", [f"{folder}/embeddings.parquet"], lambda p: scoring.prepare(embedded(spark, folder), p))
    return scoring.prepared(spark, path)


def note_vectors(spark: SparkSession, folder: str, model: str = "lantern-s") -> DataFrame:
    """(digest, vector): one usable vector of the model for each text, of several the smallest; vectors of zeros are left out."""
    rows = usable_rows(table(spark, folder, "vectors"), model).filter(F.exists("vector", lambda x: x != 0))
    return rows.groupBy(F.col("text_digest").alias("digest")).agg(F.min("vector").alias("vector"))


def prepared_notes(spark: SparkSession, folder: str) -> tuple[list[float], DataFrame, DataFrame]:
    """(mean, centred rows, hubs) of the notes' vectors, computed once for these vectors."""
    path = stored(spark, "note-vectors", [f"{folder}/vectors.parquet"], lambda p: scoring.prepare(note_vectors(spark, folder), p))
    return scoring.prepared(spark, path)
