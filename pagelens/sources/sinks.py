"""Result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.formats import four_places, iso_timestamp
from pagelens.schemas import REPORT_COLUMNS

# Quotes are doubled, and nulls and empty strings both print as nothing.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
}


def report_rows(results: DataFrame) -> DataFrame:
    """The ten report columns in order, as text; absent ones are empty."""

    def cell(name: str):
        if name not in results.columns:
            return F.lit("")
        column, kind = F.col(name), dict(results.dtypes)[name]
        if kind == "timestamp":
            column = iso_timestamp(column)
        elif kind == "double":
            column = four_places(column)
        return F.coalesce(column.cast("string"), F.lit(""))

    return results.select(*[cell(name).alias(name) for name in REPORT_COLUMNS])


def _on_one_line(cell: Column) -> Column:
    """The cell without line breaks: a backslash and a letter for each, and for a backslash."""
    cell = F.replace(cell, F.lit("\\"), F.lit("\\s"))
    return F.replace(F.replace(cell, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def _with_line_breaks(cell: Column) -> Column:
    """What ``_on_one_line`` was given. Backslashes come last, as each was followed by an s."""
    cell = F.replace(F.replace(cell, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.replace(cell, F.lit("\\s"), F.lit("\\"))


def write_report(
    results: DataFrame, path: str, append: bool = False, one_line: bool = False
) -> None:
    """Write the report as a folder of CSV files, each with its own header.

    With ``one_line`` line breaks in cells are escaped, so that ``read_report``, told so too,
    can cut a file into many tasks' parts.
    """
    rows = report_rows(results)
    if one_line:
        rows = rows.select(*[_on_one_line(F.col(c)).alias(c) for c in rows.columns])
    mode = "append" if append else "overwrite"
    rows.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def read_report(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    schema = ", ".join(f"{name} string" for name in REPORT_COLUMNS)
    # Otherwise error texts may hold line breaks, so records are parsed across lines.
    rows = (
        spark.read.schema(schema)
        .options(**CSV_OPTIONS)
        .option("multiLine", not one_line)
        .csv(path)
        .na.fill("")
    )
    if one_line:
        rows = rows.select(*[_with_line_breaks(F.col(c)).alias(c) for c in rows.columns])
    return rows


def write_json_export(results: DataFrame, path: str) -> None:
    """Write every field as JSON lines, and one manifest record beside them.

    A single enveloped document would pass all results through one task. The
    manifest counts what was written by reading it back, so the results are
    computed once and the count cannot differ from the files.
    """
    formatted = results
    for name, kind in results.dtypes:
        if kind == "timestamp":
            formatted = formatted.withColumn(name, iso_timestamp(F.col(name)))
    formatted.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/results")
    written = results.sparkSession.read.schema(formatted.schema).json(f"{path}/results")
    manifest = written.agg(
        iso_timestamp(F.current_timestamp()).alias("generated_at"),
        F.count(F.lit(1)).alias("total_urls"),
    )
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def read_json_export(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """Result rows and the manifest record."""
    results = spark.read.schema(schema).json(f"{path}/results")
    manifest = spark.read.schema("generated_at string, total_urls long").json(f"{path}/manifest")
    return results, manifest
