"""Run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.operators.fetches import SUCCESS
from pagelens.operators.ranks import CHUNK_WIDTH, running_total
from pagelens.sources.tables import store


def batch_progress(
    results: DataFrame, batch_col: str = "batch", chunk_width: int = CHUNK_WIDTH
) -> DataFrame:
    """Per batch: size, successes, and URLs processed up to and including it."""
    per_batch = results.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("urls"),
        F.count_if(F.col("status") == SUCCESS).alias("succeeded"),
    )
    # Stored, as the running total reads it twice.
    per_batch = store(per_batch, "batches")
    return running_total(per_batch, batch_col, F.col("urls"), "processed", chunk_width)


def run_summary(results: DataFrame) -> DataFrame:
    """One row: total, successful and failed."""
    succeeded = F.count_if(F.col("status") == SUCCESS)
    total = F.count(F.lit(1))
    return results.agg(
        total.alias("total"),
        succeeded.alias("successful"),
        (total - succeeded).alias("failed"),
    )


def category_distribution(results: DataFrame) -> DataFrame:
    """Successful pages per category with their share in percent, largest first.

    The window runs over one row per category.
    """
    counts = (
        results.filter(F.col("status") == SUCCESS)
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("pages"))
    )
    total = F.sum("pages").over(Window.partitionBy())
    share = F.col("pages") / total * 100
    return counts.withColumn("percent", share).orderBy(F.desc("pages"), "category")
