"""Page streams: read, deduplicate, count, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pagelens import schemas
from pagelens.functions.urls import is_valid_url, normalise_url

SALTS = 16


def read_page_stream(
    spark: SparkSession,
    path: str,
    schema: StructType = schemas.PAGE,
    files_per_trigger: int = 1000,
) -> DataFrame:
    """Parquet files under a path or glob, in bounded batches."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def distinct_url_stream(
    pages: DataFrame,
    spread_by: str,
    event_time: str | None = None,
    delay: str | None = None,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Valid URLs, each emitted once over the whole life of the stream.

    URLs of the stored table ``seen`` are not emitted at all.

    A stream deduplicates after the shuffle, so rows are first deduplicated per
    salt: a URL filling a third of the stream is spread over ``SALTS`` tasks, and
    at most that many copies go on to the second step. State grows with the
    number of distinct URLs; give an event time and a delay to bound it.
    """
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")
    kept = [] if event_time is None else [F.col(event_time)]
    urls = pages.select(normalise_url(F.col("url")).alias("url"), salt.alias("_salt"), *kept)
    urls = urls.filter(is_valid_url(F.col("url")))
    if seen is not None:
        urls = urls.join(seen.select("url").distinct(), "url", "left_anti")
    if event_time is None:
        return urls.dropDuplicates(["url", "_salt"]).dropDuplicates(["url"]).select("url")
    return (
        urls.withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(["url", "_salt"])
        .dropDuplicatesWithinWatermark(["url"])
        .select("url", event_time)
    )


def status_counts(results: DataFrame) -> DataFrame:
    """Running number of results per status."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def append_stream(
    results: DataFrame, path: str, checkpoint: str, file_format: str = "parquet"
) -> StreamingQuery:
    """Append each batch's files exactly once, until the input is used up.

    Started again with the same checkpoint it goes on where it stopped.
    """
    return (
        results.writeStream.format(file_format)
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def count_stream(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the running counters after every batch, one folder per batch.

    A replayed batch overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counters as of the last batch written by ``count_stream``."""
    history = spark.read.schema("status string, n long, batch long").parquet(path)
    return history.groupBy("status").agg(F.max_by("n", "batch").alias("n"))


def drain(query: StreamingQuery) -> None:
    """Wait for an availableNow query; its failure is raised here."""
    query.awaitTermination()
