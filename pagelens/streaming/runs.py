"""A run over a stream of fetches, batch by batch.

Each micro-batch does what a step of the batch run does: takes the fetches of URLs not
dealt with yet, categorises them, appends to the report, records the outcomes and counts
them. Every part of a batch goes to a folder named after it, so a batch that is replayed
after a failure overwrites its own files and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelens.functions.urls import is_valid_url, normalise_url
from pagelens.operators import frontier
from pagelens.operators.model import CategoryModel
from pagelens.plans.runs import categorise_pages, results_for, url_bytes
from pagelens.sources import seen_index, sinks, tables

OUTCOMES = "list string, url string, batch long"
COUNTERS = "status string, n long, batch long"


def _start(stream: DataFrame, step, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(step)
        .start()
    )


def categorise_stream(
    pages: DataFrame, model: CategoryModel, path: str, checkpoint: str
) -> StreamingQuery:
    """Append each batch of pages with signals and category to Parquet, once.

    A model of any size will do, since a batch is an ordinary table.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        found = categorise_pages(batch, model)
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(pages, step, checkpoint)


def run_stream(
    fetches: DataFrame,
    model: CategoryModel,
    path: str,
    checkpoint: str,
    state: DataFrame | None = None,
    buckets: int = seen_index.BUCKETS,
) -> StreamingQuery:
    """Categorise a stream of fetches below ``path`` until the input is used up.

    A URL is dealt with once: not if a stored ``state`` has seen it, nor if an earlier batch
    has its outcome. Fetched several times within a batch, it has one result, chosen as in
    a batch run. Started again with the same checkpoint the run goes on behind the last
    finished batch.

    The URLs to deal with are found first, from the URLs alone; a batch's HTML is read and
    not shuffled. They are compared with an index of the URLs of earlier batches, and with
    another of the state's, which is read once a start; so a batch costs by its own URLs.
    ``buckets`` deals both indexes when they are made.
    """
    spark = fetches.sparkSession
    # So that the first batch has outcomes to look at.
    spark.createDataFrame([], "list string, url string").write.mode("ignore").parquet(
        f"{path}/outcomes/batch=-1"
    )
    seen, before = f"{path}/seen", f"{path}/seen-before"
    seen_index.create_index(spark, seen, buckets, if_missing=True)
    if state is not None:
        seen_index.create_index(spark, before, buckets, if_missing=True)
        old = state.where("list = 'seen'").select("url").distinct()
        added = tables.store(seen_index.unseen(old, before), "seen-before")
        if not added.isEmpty():
            seen_index.add_segment(added, before, seen_index.last_segment(spark, before) + 1)

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        _index_batches(session, path, seen, batch_id)
        urls = batch.select(normalise_url(F.col("url")).alias("url")).distinct()
        urls = tables.store(urls.where(is_valid_url(F.col("url"))), "batch-urls")
        fresh = seen_index.unseen(urls, seen)
        if state is not None:
            fresh = seen_index.unseen(fresh, before)
        fresh = tables.store(fresh, "fresh-urls")
        found = results_for(batch, fresh, model, url_bytes(fresh) or 0)
        found.write.mode("overwrite").parquet(f"{path}/results/batch={batch_id}")
        results = session.read.schema(found.schema).parquet(f"{path}/results/batch={batch_id}")
        sinks.write_report(results, f"{path}/report/batch={batch_id}")
        outcomes = frontier.record_outcomes(results)
        outcomes.write.mode("overwrite").parquet(f"{path}/outcomes/batch={batch_id}")
        counts = results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/counters/batch={batch_id}")

    return _start(fetches, step, checkpoint)


def _index_batches(spark: SparkSession, path: str, seen: str, batch_id: int) -> None:
    """Bring the index up to the batches before this one.

    Segment n holds what came before batch n. A batch's own URLs are added by the next one, so
    a batch that is replayed does not meet itself.
    """
    have = max(seen_index.last_segment(spark, seen), 0)
    if have < batch_id:
        done = stream_outcomes(spark, path).where(F.col("batch").between(have, batch_id - 1))
        seen_index.add_segment(done.select("url").distinct(), seen, batch_id)
        seen_index.tidy(spark, seen)


def stream_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """``(list, url, batch)`` of all batches so far."""
    return spark.read.schema(OUTCOMES).parquet(f"{path}/outcomes")


def stream_counters(spark: SparkSession, path: str) -> DataFrame:
    """Results per status over all batches so far."""
    counts = spark.read.schema(COUNTERS).parquet(f"{path}/counters")
    return counts.groupBy("status").agg(F.sum("n").alias("n"))


def stream_report(spark: SparkSession, path: str) -> DataFrame:
    """The report rows of all batches so far."""
    return sinks.read_report(spark, f"{path}/report/batch=*")


def stream_queue(spark: SparkSession, path: str, state: DataFrame) -> DataFrame:
    """``state`` after the stream: its outcomes recorded, and off the pending list."""
    outcomes = stream_outcomes(spark, path)
    status = F.when(F.col("list") == "completed", "SUCCESS").otherwise("ERROR")
    return frontier.advance_state(state, outcomes.select("url", status.alias("status")))
