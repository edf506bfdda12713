"""Output formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_timestamp(moment: Column) -> Column:
    """``2026-01-31T08:15:00.123456+00:00``; the fraction is left out when zero."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))
    fraction = F.when(
        F.date_format(utc, "SSSSSS") == "000000", F.lit("")
    ).otherwise(F.date_format(utc, ".SSSSSS"))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def four_places(number: Column) -> Column:
    """``0.25``, ``0.0``, ``0.0009``: plain digits, never an exponent."""
    digits = number.cast("decimal(20,4)").cast("string")
    return F.regexp_replace(digits, r"(\.\d+?)0+$", "$1")
