"""Signals of a page, one row in and one row out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions import html as H
from pagelens.schemas import SIGNAL_COLUMNS


def extract_signals(
    pages: DataFrame,
    html_col: str = "html",
    body_limit: int | None = None,
    weights: dict[str, int] | None = None,
) -> DataFrame:
    """Replace the HTML column by the eight signal columns. No shuffle.

    Work is staged in projections that each read the one before several times,
    so Catalyst keeps them apart and every pattern runs once per page. The whole
    document is read, and the body signal is its whole text unless ``body_limit``
    says how many of its characters to keep.
    """
    doc, metas, texts = F.col("_doc"), F.col("_metas"), F.col("_texts")
    body = F.get(F.get(texts, 4), 0)
    if body_limit is not None:
        body = F.substring(body, 1, body_limit)
    staged = (
        pages.withColumn("_doc", H.markup(F.col(html_col)))
        .drop(html_col)
        .withColumns({"_metas": H.metas(doc), "_texts": H.texts(doc)})
        .drop("_doc")
        .withColumns(
            {
                "title": F.get(F.get(texts, 0), 0),
                "description": H.meta_content(metas, "description"),
                "keywords": H.meta_content(metas, "keywords"),
                **{f"h{level}": H.join_texts(F.get(texts, level)) for level in (1, 2, 3)},
                "body_text": body,
            }
        )
        .withColumn("combined_text", H.combined_text(weights))
    )
    kept = [c for c in pages.columns if c != html_col]
    return staged.select(*kept, *SIGNAL_COLUMNS)
