"""One JSON document in ordered parts.

Below the path are ``0-head``, ``1-results`` and ``2-tail``. Their files, in the order of
their names, concatenate to a single valid document ``{generated_at, total_urls, results}``;
no task holds more than its own records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelens.functions.formats import iso_timestamp
from pagelens.sources.tables import store

HEAD, RESULTS, TAIL = "0-head", "1-results", "2-tail"
MANIFEST = "generated_at string, total_urls long"


def _write_line(spark: SparkSession, value, path: str) -> None:
    spark.range(1, numPartitions=1).select(value.alias("value")).write.mode("overwrite").text(path)


def write_json_document(results: DataFrame, path: str) -> None:
    """Write every field of ``results`` as one document in parts; nulls are written.

    A record is a line, and all but the first begin with a comma. Which one is first is
    known once the records are stored, so they are computed once.
    """
    spark = results.sparkSession
    fields = [
        (iso_timestamp(F.col(name)) if kind == "timestamp" else F.col(name)).alias(name)
        for name, kind in results.dtypes
    ]
    record = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    records = store(results.select(record.alias("value")), "json-records")
    # Ids follow the scan's splits, and so do the names of the files written from it.
    records = records.select("value", F.monotonically_increasing_id().alias("place"))
    found = records.agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).first()
    led = F.when(F.col("place") == F.lit(found["first"]), F.col("value"))
    led = led.otherwise(F.concat(F.lit(","), F.col("value")))
    records.select(led.alias("value")).write.mode("overwrite").text(f"{path}/{RESULTS}")
    head = F.concat(
        F.lit('{"generated_at":"'),
        iso_timestamp(F.current_timestamp()),
        F.lit(f'","total_urls":{found["n"]},"results":['),
    )
    _write_line(spark, head, f"{path}/{HEAD}")
    _write_line(spark, F.lit("]}"), f"{path}/{TAIL}")


def read_json_document(
    spark: SparkSession, path: str, schema: StructType
) -> tuple[DataFrame, DataFrame]:
    """The records and the manifest ``(generated_at, total_urls)`` of a document in parts."""
    lines = spark.read.text(f"{path}/{RESULTS}")
    record = F.from_json(F.regexp_replace("value", "^,", ""), schema)
    head = spark.read.text(f"{path}/{HEAD}")
    manifest = F.from_json(F.concat("value", F.lit("]}")), MANIFEST)
    return (
        lines.select(record.alias("r")).select("r.*"),
        head.select(manifest.alias("m")).select("m.*"),
    )
