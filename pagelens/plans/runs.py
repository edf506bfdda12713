"""A batch run: URL list and fetches in, results and queue state out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.urls import normalise_url
from pagelens.operators import frontier
from pagelens.operators.classify import classify
from pagelens.operators.fetches import one_per_url, page_results
from pagelens.operators.model import CategoryModel
from pagelens.operators.signals import extract_signals
from pagelens.schemas import RESULT_COLUMNS
from pagelens.sources import fetch_store, queue_log, seen_index, sinks, tables


#: A queue whose URLs are that many bytes together is sent to all executors.
BROADCAST_BYTES = 64 << 20


def categorise_fetches(fetches: DataFrame, model: CategoryModel) -> DataFrame:
    """The 16 result columns of every fetch. Row by row with a small model."""
    return classify(page_results(fetches), model).select(*RESULT_COLUMNS)


def categorise_pages(pages: DataFrame, model: CategoryModel) -> DataFrame:
    """Signals and category of pages that are known to be good HTML."""
    return classify(extract_signals(pages), model)


def queue_lines(
    lines: DataFrame, state: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Queue state with the new URLs behind those pending, and the load counters.

    URLs already seen are not queued again, so finished and failed ones are not
    redone. The lines are read once: both answers come from the stored counts per URL.
    """
    counts = tables.store(frontier.line_counts(frontier.parse_lines(lines)), "lines")
    fresh = frontier.counted_urls(counts)
    if state is not None:
        seen = state.filter("list = 'seen'").select("url").distinct()
        fresh = tables.store(fresh.join(seen, "url", "left_anti"), "fresh")
    return frontier.start_state(fresh, state), frontier.counters_of(counts, fresh)


def url_bytes(urls: DataFrame) -> int | None:
    """About how many bytes the URLs are; null if there are none."""
    return urls.agg(F.sum(F.octet_length("url") + 16).alias("bytes")).first()["bytes"]


def results_for(
    fetches: DataFrame,
    pending: DataFrame,
    model: CategoryModel,
    pending_bytes: int,
    fetch_buckets: int | None = None,
) -> DataFrame:
    """One result for each pending URL that was fetched, as ``one_per_url`` chooses it.

    A queue of counted, broadcast size picks its fetches in the scan. A larger
    one is joined to the results, so that the shuffle carries short texts and not
    HTML. That is an inner join on purpose: the optimizer moves a semi join below
    the extraction, and the pending URLs are distinct anyway.

    Fetches of a fetch store, dealt into ``fetch_buckets`` by URL, are not moved at all: the
    larger queue is dealt in the same way and meets them bucket by bucket, before extraction.
    """
    urls = pending.select("url").distinct()
    if fetch_buckets is not None and pending_bytes > BROADCAST_BYTES:
        wanted = fetch_store.pick(fetches, urls, fetch_buckets)
        return one_per_url(categorise_fetches(wanted, model))
    if fetch_buckets is None:
        fetches = fetches.withColumn("url", normalise_url(F.col("url")))
    if pending_bytes <= BROADCAST_BYTES:
        wanted = fetches.join(F.broadcast(urls), "url", "left_semi")
        return one_per_url(categorise_fetches(wanted, model))
    # Both need the results by URL, so there is one shuffle.
    return one_per_url(categorise_fetches(fetches, model).join(urls, "url"))


class Steps:
    """The steps of a run that are finished, as rows of a small table below its path.

    With ``resume`` a run goes on behind them, else it starts over.
    """

    def __init__(self, spark: SparkSession, path: str, resume: bool):
        self.spark, self.path = spark, f"{path}/steps"
        none = spark.createDataFrame([], "step string")
        none.write.mode("ignore" if resume else "overwrite").parquet(self.path)
        self.done = {r["step"] for r in spark.read.schema("step string").parquet(self.path).collect()}

    def once(self, name: str, step: Callable[[], None]) -> None:
        """Do a step unless it is finished, and then record that it is."""
        if name not in self.done:
            step()
            row = self.spark.createDataFrame([(name,)], "step string").coalesce(1)
            row.write.mode("append").parquet(self.path)
            self.done.add(name)


def _process(
    steps: Steps,
    fetches: DataFrame,
    pending: DataFrame,
    model: CategoryModel,
    path: str,
    export: bool,
    fetch_buckets: int | None = None,
) -> DataFrame:
    """The results of the pending URLs, written with their report and export."""
    spark = fetches.sparkSession

    def results() -> None:
        size = url_bytes(pending)
        if size is None:
            raise ValueError("no valid URLs to process")
        found = results_for(fetches, pending, model, size, fetch_buckets)
        found.write.mode("overwrite").parquet(f"{path}/results")

    steps.once("results", results)
    schema = categorise_fetches(fetches, model).schema
    written = spark.read.schema(schema).parquet(f"{path}/results")
    steps.once("report", lambda: sinks.write_report(written, f"{path}/report"))
    if export:
        steps.once("export", lambda: sinks.write_json_export(written, f"{path}/export"))
    return written


def run(
    lines: DataFrame,
    fetches: DataFrame,
    model: CategoryModel,
    path: str,
    state: DataFrame | None = None,
    json_export: bool = False,
    resume: bool = False,
    fetch_buckets: int | None = None,
) -> DataFrame:
    """One run below ``path``; returns the queue state after it.

    Each step is written before the next reads it, so nothing is computed twice
    and a lost executor costs one step's tasks: first the queue, then the
    results, then report, export and new queue from the results table. Raises
    when nothing is pending. With ``resume``, steps that an earlier call with the same
    path finished are not done again. Fetches read from a fetch store come with its number
    of buckets.
    """
    spark = fetches.sparkSession
    steps = Steps(spark, path, resume)

    def queue() -> None:
        begun, counters = queue_lines(lines, state)
        tables.write_queue(begun, f"{path}/queue_before")
        counters.write.mode("overwrite").json(f"{path}/counters")

    steps.once("queue", queue)
    begun = tables.read_queue(spark, f"{path}/queue_before")
    pending = begun.filter("list = 'pending'")
    results = _process(steps, fetches, pending, model, path, json_export, fetch_buckets)
    after = frontier.advance_state(begun, results)
    steps.once("state", lambda: tables.write_queue(after, f"{path}/queue"))
    return tables.read_queue(spark, f"{path}/queue")


def run_logged(
    lines: DataFrame,
    fetches: DataFrame,
    model: CategoryModel,
    path: str,
    log: str,
    json_export: bool = False,
    index: str | None = None,
    fetch_buckets: int | None = None,
) -> DataFrame:
    """One run whose queue is the log at ``log``; returns the queue state after it.

    Like ``run``, but it writes only what it changes: new URLs and outcomes. Called again
    with the same ``path`` after a failure, it goes on behind the last finished step; after
    the last one it changes nothing.

    With the path of a seen ``index`` it brings that up to the log, and compares its URLs with
    the index in place of all URLs seen. Both ways give the same answers.
    """
    spark = fetches.sparkSession
    steps = Steps(spark, path, resume=True)

    def queue() -> None:
        counts = tables.store(frontier.line_counts(frontier.parse_lines(lines)), "lines")
        urls = frontier.counted_urls(counts)
        if index is None:
            seen = queue_log.read_log(spark, log, "seen").select("url")
            new = urls.join(seen, "url", "left_anti")
        else:
            seen_index.follow(spark, index, log)
            new = seen_index.unseen(urls, index)
        behind = queue_log.next_position(spark, log)
        new.select("url", (F.col("seq") + behind).alias("seq")).write.mode("overwrite").parquet(
            f"{path}/fresh"
        )
        written = spark.read.schema("url string, seq long").parquet(f"{path}/fresh")
        counters = frontier.counters_of(counts, written)
        counters.write.mode("overwrite").json(f"{path}/counters")

    steps.once("queue", queue)
    fresh = spark.read.schema("url string, seq long").parquet(f"{path}/fresh")
    old = queue_log.read_log(spark, log, "pending").select("url", "seq")
    results = _process(steps, fetches, old.union(fresh), model, path, json_export, fetch_buckets)

    def record() -> None:
        number = queue_log.last_runs(spark, log)[0] + 1
        queue_log.append_changes(queue_log.run_changes(fresh, results), log, number)

    steps.once("log", record)
    return queue_log.read_log(spark, log)


def batched_results(
    results: DataFrame, queue: DataFrame, size: int = frontier.BATCH_SIZE
) -> DataFrame:
    """Results labelled with the batch their URL was queued in."""
    batches = frontier.assign_batches(queue, size).select("url", "batch")
    return results.join(batches, "url")
