"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: The same where the first is unset and can no longer be set, as in tests.
SCRATCH_DIR = "pagelens.scratch.dir"

# Runtime settings every job relies on; all can be set on a live session.
RUNTIME_CONF = {
    # Timestamps are written as UTC whatever the host is set to.
    "spark.sql.session.timeZone": "UTC",
    # Coalesces small shuffle partitions and splits skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A scan holds a batch of rows per task, and these rows are whole pages: the
    # default of 4,096 rows would be 400 MB at 100 KB each.
    "spark.sql.parquet.columnarReaderBatchSize": "256",
    # Deduplication state is unbounded, so it lives on disk and not on the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(
    app_name: str = "pagelens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings above. On a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RUNTIME_CONF, **(extra_conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``."""
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get(SCRATCH_DIR, None)
    if not root:
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    return f"{root.rstrip('/')}/pagelens-{label}-{uuid.uuid4().hex}"
