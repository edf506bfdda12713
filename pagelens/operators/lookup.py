"""Joins of a large side to a lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
SALTS = 32


def lookup_join(
    large: DataFrame, table: DataFrame, on: str, table_rows: int, spread_by: str, how: str = "inner"
) -> DataFrame:
    """Join ``table`` of at most ``table_rows`` rows to ``large`` on ``on``.

    A table of few rows is left to Spark, which broadcasts it if its bytes allow and
    splits hot keys if not. A larger one is copied to ``SALTS`` salt values and the large
    side is salted by ``spread_by``, so a key holding a third of all rows is spread over
    that many tasks.
    """
    if table_rows <= BROADCAST_ROWS:
        return large.join(table, on, how)
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large.withColumn("_salt", salt).join(copies, [on, "_salt"], how).drop("_salt")
