"""Let-binding for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row.

    Writing an expensive expression into several places of another one copies
    it, and copies in conditional branches or lambdas are evaluated again. A
    one-element ``transform`` names the value instead.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
