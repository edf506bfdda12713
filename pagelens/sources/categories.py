"""Category configuration: one row per category, in order."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens import schemas


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """Read a ``{"categories": [{name, keywords, domains}]}`` file."""
    envelope = (
        spark.read.schema(schemas.CATEGORY_FILE).option("multiLine", True).json(path)
    )
    return _with_defaults(
        envelope.select(F.posexplode("categories").alias("cat_idx", "category")).select(
            "cat_idx", "category.*"
        )
    )


def categories_frame(spark: SparkSession, categories: Iterable[Mapping]) -> DataFrame:
    """The same rows from a Python list of mappings."""
    rows = [
        (i, c["name"], list(c["keywords"]), list(c.get("domains") or []))
        for i, c in enumerate(categories)
    ]
    schema = "cat_idx int, name string, keywords array<string>, domains array<string>"
    return _with_defaults(spark.createDataFrame(rows, schema))


def _with_defaults(frame: DataFrame) -> DataFrame:
    """Name and keywords are required; a missing domain list is empty."""
    return frame.select(
        "cat_idx",
        F.when(F.col("name").isNull(), F.raise_error(F.lit("category without a name")))
        .otherwise(F.col("name"))
        .alias("name"),
        F.when(F.col("keywords").isNull(), F.raise_error(F.lit("category without keywords")))
        .otherwise(F.col("keywords"))
        .alias("keywords"),
        F.coalesce("domains", F.array().cast("array<string>")).alias("domains"),
    )


def write_categories(categories: DataFrame, path: str) -> None:
    """Write the envelope that ``read_categories`` reads, as one JSON record.

    A category set is configuration: it is small, and its file format is a
    single document, so one task writes it.
    """
    ordered = F.array_sort(F.collect_list(F.struct("cat_idx", "name", "keywords", "domains")))
    envelope = categories.agg(ordered.alias("c")).select(
        F.transform("c", lambda c: F.struct(c["name"], c["keywords"], c["domains"])).alias(
            "categories"
        )
    )
    envelope.coalesce(1).write.mode("overwrite").json(path)
