"""URL lists, fetched pages, labels and saved frontier state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens import schemas
from pagelens.session import scratch_path

# Cell texts that a label file may use for a missing value.
MISSING_CELLS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file or folder as ``(value, seq)``; seq follows file order.

    The id grows along each scan split, and splits are numbered in file order. It
    ranks lines; it is not a line number.
    """
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGE).parquet(path)


def read_fetches(spark: SparkSession, path: str) -> DataFrame:
    """Pages as a crawler stored them, successes and failures alike."""
    return spark.read.schema(schemas.FETCH).parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Columns ``url`` and ``category`` of CSV files with a header.

    Cells may hold line breaks, so a file is parsed across lines, by one task. Other
    columns are pruned, cells that mean "missing" become null, and a file without the two
    columns is refused.
    """
    frame = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    missing = [f.name for f in schemas.LABEL if f.name not in frame.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    return frame.select(
        *[
            F.when(F.col(f.name).isin(list(MISSING_CELLS)), F.lit(None))
            .otherwise(F.col(f.name))
            .cast(f.dataType)
            .alias(f.name)
            for f in schemas.LABEL
        ]
    )


def read_queue_document(spark: SparkSession, path: str) -> DataFrame:
    """Import a saved queue: one JSON document of four URL arrays.

    The format is a single record, so one task reads it. Use it to move an old
    queue over, then keep state with ``write_queue`` and ``read_queue``.
    """
    document = spark.read.schema(schemas.QUEUE_FILE).option("multiLine", True).json(path)
    lists = F.array(
        *[
            F.struct(F.lit(field.name).alias("list"), F.col(field.name).alias("urls"))
            for field in schemas.QUEUE_FILE
        ]
    )
    # A missing key reads as null, which explodes to no rows.
    return (
        document.select(F.explode(lists).alias("l"))
        .select("l.list", F.posexplode("l.urls").alias("seq", "url"))
        .select("list", "url", F.col("seq").cast("long"))
    )


def write_queue(state: DataFrame, path: str) -> None:
    """Save frontier state as a Parquet table, one folder per list."""
    state.select("list", "url", "seq").write.mode("overwrite").partitionBy("list").parquet(path)


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.QUEUE).parquet(path).select("list", "url", "seq")


def store(frame: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared folder and read it back.

    What follows starts from files every executor can read: no step is computed
    twice, and a lost executor costs only its running tasks.
    """
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
