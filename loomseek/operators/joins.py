"""Joins that a hot key can't hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of all rows, and so many of them, is hot.
SHARE, LEAST = 1000, 10_000


def hot_keys(rows: DataFrame, key: str, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """(key, parts) of the keys that hold at least 1/share of rows, at most ``share`` of them, and into how many parts each is cut."""
    counts = rows.groupBy(key).count()
    total = counts.agg(F.sum("count")).scalar()
    hot = counts.filter((F.col("count") >= least) & (F.col("count") * share >= total))
    return F.broadcast(hot.select(key, (F.col("count") * share / total).cast("int").alias("parts")))


def divide(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """rows with the part in which they belong, by the hash of a column."""
    parts = F.coalesce("parts", F.lit(1))
    return rows.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts")


def repeat(rows: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """rows once for each part of their key."""
    parts = F.coalesce("parts", F.lit(1))
    return rows.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")


def lookup(rows: DataFrame, facts: DataFrame, key: str, by: str, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """rows with the columns of the one row of facts that has their key; rows without one are left out.

    The rows of a hot key are divided among tasks by the column ``by``; only
    the facts of hot keys are repeated for that.
    """
    hot = hot_keys(rows, key, share, least)
    return divide(rows, hot, key, by).join(repeat(facts, hot, key), [key, "part"]).drop("part")
