"""Turn stored fetches into page results with one status and one error text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.operators.signals import extract_signals

# Status and error texts.
SUCCESS, ERROR = "SUCCESS", "ERROR"
TIMEOUT = "Timeout"
TOO_MANY_REDIRECTS = "Too many redirects"


def is_html(content_type: Column) -> Column:
    """Case-sensitive, anywhere in the header; a missing header is not HTML."""
    header = F.coalesce(content_type, F.lit(""))
    return header.contains("text/html") | header.contains("application/xhtml")


def error_text(failure: Column, text: Column, code: Column, content_type: Column) -> Column:
    """Null for a usable response. Transport comes before status before type."""
    message = F.coalesce(text, F.lit(""))
    return (
        F.when(failure == "timeout", F.lit(TIMEOUT))
        .when(failure == "redirects", F.lit(TOO_MANY_REDIRECTS))
        .when(failure == "connection", F.concat(F.lit("Connection error: "), message))
        .when(failure.isNotNull(), message)
        .when(code.between(400, 599), F.concat(F.lit("HTTP "), code.cast("string")))
        .when(
            ~is_html(content_type),
            F.concat(F.lit("Non-HTML content-type: "), F.coalesce(content_type, F.lit(""))),
        )
    )


def normalise_outcomes(fetches: DataFrame) -> DataFrame:
    """Status, error text and the fields an error blanks. Row by row, no shuffle.

    An error row has no code, no HTML, and its own URL as final URL.
    """
    error = error_text(
        F.col("failure"), F.col("failure_text"), F.col("http_code"), F.col("content_type")
    )
    failed = F.col("error").isNotNull()
    blanked = {
        "final_url": F.when(failed, F.col("url")).otherwise(F.coalesce("final_url", "url")),
        "status": F.when(failed, F.lit(ERROR)).otherwise(F.lit(SUCCESS)),
        "http_code": F.when(~failed, F.col("http_code")),
        "html": F.when(~failed, F.col("html")),
    }
    return (
        fetches.withColumn("error", error)
        .withColumns(blanked)
        .drop("failure", "failure_text", "content_type")
    )


def page_results(fetches: DataFrame) -> DataFrame:
    """Outcomes with signals; an error row's signals are blank."""
    return extract_signals(normalise_outcomes(fetches))


def one_per_url(results: DataFrame) -> DataFrame:
    """One result of each URL, whatever the order of the rows.

    The latest by ``crawled_at`` stays, a missing time being the earliest; of equally late
    ones a success, then the one whose content has the smallest digest. Each task keeps one
    row a URL before the shuffle, so a URL that was fetched very often is no hot key.
    """
    content = F.xxhash64(*[c for c in results.columns if c != "url"])
    latest = Window.partitionBy("url").orderBy(
        F.desc_nulls_last("crawled_at"), F.desc(F.col("status") == SUCCESS), content
    )
    ranked = results.withColumn("_place", F.row_number().over(latest))
    return ranked.where("_place = 1").drop("_place")
