"""Filtering before the limit under a budget of rows to examine, in closed form.

Rows come in an order, in pages. A page is examined whole; reading stops after
the page in which one more eligible row than the limit was seen, or at the
budget. Instead of paging, the rows up to the budget are numbered once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Work:
    examined: int
    incomplete: bool
    extra: bool
    stale: bool = False


def number(rows: DataFrame, order: list[Column], budget: int, eligible: Column) -> DataFrame:
    """The first ``budget`` rows with place (from 1), eligible and the running count of eligible rows.

    The limit keeps the single partition of the window bounded.
    """
    first = rows.orderBy(*order).limit(budget + 1).withColumn("eligible", eligible)
    w = Window.orderBy(*order)
    return first.withColumn("place", F.row_number().over(w)).withColumn("nth", F.sum(F.col("eligible").cast("int")).over(w))


def account(numbered: DataFrame, limit: int, budget: int, page: int) -> DataFrame:
    """One row (examined, extra, incomplete) for numbered rows."""
    overflow = F.min(F.when(F.col("eligible") & (F.col("nth") == limit + 1) & (F.col("place") <= budget), F.col("place")))
    total = F.count(F.lit(1))
    filled = F.least(F.ceil(F.col("overflow") / page) * page, F.lit(budget), F.col("total"))
    a = numbered.agg(overflow.alias("overflow"), total.alias("total"), F.max(F.when(F.col("place") <= budget, F.col("nth"))).alias("kept"))
    # reading ends without knowing more rows if the budget is used up by whole pages
    short = (F.col("total") < budget) | ((F.col("total") == 0))
    return a.select(
        F.coalesce(filled, F.least(F.col("total"), F.lit(budget))).cast("int").alias("examined"),
        F.col("overflow").isNotNull().alias("extra"),
        (F.col("overflow").isNull() & ~short).alias("incomplete"),
    )
