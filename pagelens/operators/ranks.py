"""Global running totals and ranks without pulling all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_WIDTH = 1 << 20


def running_total(
    frame: DataFrame,
    order_col: str,
    value: Column,
    out: str,
    chunk_width: int = CHUNK_WIDTH,
) -> DataFrame:
    """Add the sum of ``value`` over all rows up to this one by ``order_col``.

    ``order_col`` is a whole number from zero. Rows of equal positions are counted one
    after the other. Rows are cut into chunks by number
    range, so no chunk can exceed ``chunk_width`` rows however the data is
    spread. Each chunk is summed on its own; only one total per chunk meets in
    the single-partition window over chunk offsets.
    """
    # Whole-number division: positions of large scans are beyond what a double holds.
    chunk = F.expr(f"`{order_col}` div {int(chunk_width)}")
    rows = frame.withColumns({"_chunk": chunk, "_value": value})
    totals = rows.groupBy("_chunk").agg(F.sum("_value").alias("_total"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )
    within = (
        Window.partitionBy("_chunk")
        .orderBy(order_col)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_within", F.sum("_value").over(within))
        .join(offsets, "_chunk")
        .withColumn(out, F.col("_offset") + F.col("_within"))
        .select(*frame.columns, out)
    )
