"""Fetches stored in buckets by URL, for queues too large to broadcast.

A run over plain files of fetches extracts the signals of every stored page when its queue is
large, or else would have to shuffle HTML. Here the HTML is moved when it is stored; a run
deals its queue, which is URLs alone, in the same way, and each bucket of fetches meets its
URLs where it is read. Files are ``path/fetches``, a bucketed Parquet table; ``path/layout``
holds the number of buckets, so a session that does not know the table registers it again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens import schemas
from pagelens.functions.urls import is_valid_url, normalise_url
from pagelens.operators.fetches import ERROR, SUCCESS, error_text, one_per_url

BUCKETS = 256
LAYOUT = "buckets int"


def _table(path: str) -> str:
    return "pagelens_fetches_" + hashlib.sha256(path.encode()).hexdigest()[:16]


def write_fetch_store(fetches: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store fetches by their normalised URL; other URLs than valid ones are never asked for.

    Of a URL's fetches one stays, chosen as a run would; equally late ones with the same
    outcome by a digest of the fetch. Tasks keep one row a URL before the shuffle, so a URL
    fetched very often fills no bucket. HTML moves twice here, and not in any run.
    """
    if buckets < 1:
        raise ValueError("a store needs at least one bucket")
    spark = fetches.sparkSession
    layout = spark.createDataFrame([(buckets,)], LAYOUT).coalesce(1)
    layout.write.mode("errorifexists").parquet(f"{path}/layout")
    _put(fetches, path, buckets, "errorifexists")


def append_fetches(fetches: DataFrame, path: str) -> None:
    """Add fetches to a store. A URL it has already is kept once more; a run takes the latest."""
    spark = fetches.sparkSession
    read_fetch_store(spark, path)
    _put(fetches, path, store_buckets(spark, path), "append")


def _put(fetches: DataFrame, path: str, buckets: int, mode: str) -> None:
    names = [f.name for f in schemas.FETCH]
    error = error_text(
        F.col("failure"), F.col("failure_text"), F.col("http_code"), F.col("content_type")
    )
    valid = fetches.select(*names).withColumn("url", normalise_url(F.col("url")))
    valid = valid.where(is_valid_url(F.col("url")))
    marked = valid.withColumn("status", F.when(error.isNull(), SUCCESS).otherwise(ERROR))
    rows = one_per_url(marked).select(*names).repartition(buckets, "url")
    (
        rows.write.mode(mode)
        .format("parquet")
        .bucketBy(buckets, "url")
        .option("path", f"{path}/fetches")
        .saveAsTable(_table(path))
    )


def store_buckets(spark: SparkSession, path: str) -> int:
    """The number of buckets of a store."""
    return spark.read.schema(LAYOUT).parquet(f"{path}/layout").first()["buckets"]


def read_fetch_store(spark: SparkSession, path: str) -> DataFrame:
    """The fetches of a store, with URLs normalised, in its buckets."""
    name = _table(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.FETCH)
        folder = f"{path}/fetches".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet "
            f"CLUSTERED BY (url) INTO {store_buckets(spark, path)} BUCKETS LOCATION '{folder}'"
        )
    return spark.table(name)


def pick(fetches: DataFrame, urls: DataFrame, buckets: int) -> DataFrame:
    """The rows of a store's ``fetches`` whose URL is in ``urls(url)``. Moves URLs, no HTML.

    A task hashes the URLs asked for in its bucket, and reads the bucket past them unsorted.
    """
    asked = urls.select("url").repartition(buckets, "url").hint("shuffle_hash")
    return fetches.join(asked, "url", "left_semi")
