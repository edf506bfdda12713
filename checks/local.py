"""Scratch space for sessions on one machine that name no shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from pagelens.session import CHECKPOINT_DIR, SCRATCH_DIR


def with_scratch(spark: SparkSession) -> SparkSession:
    """Give a local session a folder for intermediate files; others must name their own."""
    unset = not (spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get(SCRATCH_DIR, None))
    if unset and spark.sparkContext.master.split("[")[0] == "local":
        spark.conf.set(SCRATCH_DIR, tempfile.mkdtemp(prefix="pagelens-"))
    return spark
