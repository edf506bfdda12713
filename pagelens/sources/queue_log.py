"""Queue state as a log: a run appends what it changed, a reader folds the changes.

Below the log's path are ``deltas/run=n``, the changes of run n; ``snapshots/run=n``, the
whole state after it; and ``commits``, a row for each of these that is complete. A folder
without its row is the rest of a failure: it is not read, and written anew. So a run writes
in proportion to its own URLs, and replaying it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators.frontier import record_outcomes

CHANGE = "list string, url string, seq long, present boolean, run long"
COMMIT = "kind string, run long"
DELTA, SNAPSHOT = "deltas", "snapshots"


def _commit(spark: SparkSession, path: str, kind: str, run: int) -> None:
    row = spark.createDataFrame([(kind, run)], COMMIT).coalesce(1)
    row.write.mode("append").parquet(f"{path}/commits")


def create_log(state: DataFrame, path: str) -> None:
    """A log at ``path`` that begins with ``state(list, url, seq)`` as run 0."""
    _write_snapshot(state, path, 0)


def _write_snapshot(state: DataFrame, path: str, run: int) -> None:
    rows = state.select("list", "url", "seq", F.lit(True).alias("present"))
    rows.write.mode("overwrite").parquet(f"{path}/{SNAPSHOT}/run={run}")
    _commit(state.sparkSession, path, SNAPSHOT, run)


def last_runs(spark: SparkSession, path: str) -> tuple[int, int]:
    """The last run that is in the log, and the last one with a snapshot."""
    commits = spark.read.schema(COMMIT).parquet(f"{path}/commits")
    found = commits.agg(
        F.max("run").alias("run"), F.max(F.when(F.col("kind") == SNAPSHOT, F.col("run"))).alias("snapshot")
    ).first()
    return found["run"], found["snapshot"]


def run_changes(fresh: DataFrame, results: DataFrame) -> DataFrame:
    """What a run changes: new URLs ``(url, seq)`` it queued, and ``results(url, status)``.

    New URLs join pending and seen; processed ones leave pending and join their outcome's list.
    """
    queued = fresh.select(
        F.explode(F.array(F.lit("pending"), F.lit("seen"))).alias("list"), "url", "seq",
        F.lit(True).alias("present"),
    )
    outcomes = record_outcomes(results)
    none = F.lit(None).cast("long").alias("seq")
    done = outcomes.select("list", "url", none, F.lit(True).alias("present"))
    gone = outcomes.select(
        F.lit("pending").alias("list"), "url", none, F.lit(False).alias("present")
    )
    return queued.union(done).union(gone)


def append_changes(changes: DataFrame, path: str, run: int) -> None:
    """Add the changes of ``run``, which comes behind all runs in the log."""
    last, _ = last_runs(changes.sparkSession, path)
    if run <= last:
        raise ValueError(f"run {run} is not behind run {last}")
    changes.write.mode("overwrite").parquet(f"{path}/{DELTA}/run={run}")
    _commit(changes.sparkSession, path, DELTA, run)


def _changes(spark: SparkSession, path: str) -> DataFrame:
    """The last snapshot's rows and the changes since, pruned by folder."""
    last, base = last_runs(spark, path)
    rows = spark.read.schema(CHANGE).option("basePath", f"{path}/{SNAPSHOT}")
    rows = rows.parquet(f"{path}/{SNAPSHOT}/run={base}")
    if last > base:
        # Folders are chosen by their number, whether or not a failure left others.
        since = spark.read.schema(CHANGE).parquet(f"{path}/{DELTA}")
        rows = rows.unionByName(since.where(F.col("run").between(base + 1, last)))
    return rows


def joined_since(spark: SparkSession, path: str, name: str, run: int) -> DataFrame:
    """``(url)`` of the changes after ``run`` that joined list ``name``; repeats are possible.

    If a snapshot came since, what it holds is among them.
    """
    rows = _changes(spark, path).where((F.col("list") == name) & F.col("present"))
    return rows.where(F.col("run") > run).select("url")


def next_position(spark: SparkSession, path: str) -> int:
    """A position behind all in the log. Reads one column and folds nothing."""
    last = _changes(spark, path).agg(F.max("seq").alias("seq")).first()["seq"]
    return 0 if last is None else last + 1


def read_log(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The queue state ``(list, url, seq)`` after the last run in the log.

    A URL is in a list if its latest change there says so; within a run, leaving comes
    after joining. Its position is the first it was given. With ``name`` only that list's
    changes are read and folded.
    """
    latest = F.struct("run", ~F.col("present"))
    changes = _changes(spark, path)
    if name is not None:
        changes = changes.where(F.col("list") == name)
    folded = changes.groupBy("list", "url").agg(
        F.max_by("present", latest).alias("present"), F.min("seq").alias("seq")
    )
    return folded.where("present").select("list", "url", "seq")


def compact(spark: SparkSession, path: str) -> None:
    """Write the state as a snapshot, from which reading starts.

    Folders of runs up to the snapshot are not read any more and may be deleted.
    """
    last, base = last_runs(spark, path)
    if last > base:
        _write_snapshot(read_log(spark, path), path, last)
