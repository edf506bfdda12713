"""The list of URLs still to process, and what became of the others.

State is a long table ``(list, url, seq)`` whose ``list`` is one of pending,
seen, completed and failed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions.text import strip_whitespace
from pagelens.functions.urls import is_valid_url, normalise_url
from pagelens.operators.ranks import CHUNK_WIDTH, running_total

BATCH_SIZE = 50


def parse_lines(lines: DataFrame, value_col: str = "value", seq_col: str = "seq") -> DataFrame:
    """Classify raw lines as skipped (blank or comment), invalid or valid URLs.

    Works on any frame with a text column, so files and in-memory lists share it.
    """
    parsed = lines.select(
        F.coalesce(strip_whitespace(F.col(value_col)), F.lit("")).alias("line"),
        normalise_url(F.col(value_col)).alias("url"),
        F.col(seq_col).cast("long").alias("seq"),
    )
    kind = (
        F.when(F.col("line").rlike(r"^(?:#|\z)"), "skipped")
        .when(is_valid_url(F.col("url")), "valid")
        .otherwise("invalid")
    )
    return parsed.select("url", "seq", kind.alias("kind"))


def distinct_urls(parsed: DataFrame) -> DataFrame:
    """One row per valid URL at its first position.

    ``min`` combines before the shuffle, so a URL repeated millions of times
    costs one row per task.
    """
    return parsed.filter("kind = 'valid'").groupBy("url").agg(F.min("seq").alias("seq"))


def new_urls(parsed: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Distinct valid URLs not in ``seen``.

    Both sides are reduced to distinct URLs first. They arrive partitioned by
    URL, so the anti join adds no shuffle and has no hot key.
    """
    fresh = distinct_urls(parsed)
    if seen is None:
        return fresh
    return fresh.join(seen.select("url").distinct(), "url", "left_anti")


def load_counters(parsed: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One row: URLs added, invalid lines, duplicates. One pass over the lines."""
    per_url = (
        parsed.filter("kind <> 'skipped'")
        .withColumn("url", F.when(F.col("kind") == "valid", F.col("url")))
        .groupBy("url")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = F.lit(False)
    if seen is not None:
        marked = seen.select("url").distinct().withColumn("known", F.lit(True))
        per_url = per_url.join(marked, "url", "left")
        known = F.coalesce("known", F.lit(False))
    valid = F.col("url").isNotNull()
    totals = per_url.agg(
        F.count_if(valid & ~known).alias("added"),
        F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)).alias("invalid"),
        F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0)).alias("valid"),
    )
    return totals.select("added", "invalid", (F.col("valid") - F.col("added")).alias("duplicate"))


def line_counts(parsed: DataFrame) -> DataFrame:
    """``(url, seq, n)``: lines of each valid URL and its first position, from one pass.

    Invalid lines are counted together under a null URL; skipped ones are not counted. New
    URLs and counters both come from this table, so the lines need not be read twice.
    """
    valid = F.col("kind") == "valid"
    return (
        parsed.filter("kind <> 'skipped'")
        .groupBy(F.when(valid, F.col("url")).alias("url"))
        .agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    )


def counted_urls(counts: DataFrame) -> DataFrame:
    """The distinct URLs ``(url, seq)`` of ``line_counts``."""
    return counts.where("url IS NOT NULL").select("url", "seq")


def counters_of(counts: DataFrame, fresh: DataFrame) -> DataFrame:
    """``load_counters`` from ``line_counts`` and the new URLs among them."""

    def lines(chosen):
        return F.coalesce(F.sum(F.when(chosen, F.col("n"))), F.lit(0))

    known = F.col("url").isNotNull()
    totals = counts.agg(lines(~known).alias("invalid"), lines(known).alias("valid"))
    added = fresh.agg(F.count(F.lit(1)).alias("added"))
    # One row each.
    both = totals.select("*", added.scalar().alias("added"))
    return both.select("added", "invalid", (F.col("valid") - F.col("added")).alias("duplicate"))


def assign_batches(
    frontier: DataFrame, size: int = BATCH_SIZE, chunk_width: int = CHUNK_WIDTH
) -> DataFrame:
    """Number every URL's batch, first in first out, batches of ``size`` from 1."""
    ranked = running_total(frontier, "seq", F.lit(1).cast("long"), "_rank", chunk_width)
    batch = F.floor((F.col("_rank") - 1) / size) + 1
    return ranked.withColumn("batch", batch.cast("long")).drop("_rank")


def pop_batch(frontier: DataFrame, size: int = BATCH_SIZE) -> tuple[DataFrame, DataFrame]:
    """The first ``size`` URLs, and the rest. The batch is a bounded top-k."""
    batch = frontier.orderBy("seq").limit(size)
    return batch, frontier.join(batch.select("url"), "url", "left_anti")


def record_outcomes(results: DataFrame) -> DataFrame:
    """Which list each processed URL joins; a repeat changes nothing."""
    joined = F.when(F.col("status") == "SUCCESS", "completed").otherwise("failed")
    return results.select(joined.alias("list"), "url").distinct()


def start_state(fresh: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Add new URLs to the pending and seen lists, behind those already there.

    Positions of a new list start at zero again, so they are moved behind the last one of
    the stored state.
    """
    entries = fresh.select(
        F.explode(F.array(F.lit("pending"), F.lit("seen"))).alias("list"), "url", "seq"
    )
    if state is None:
        return entries
    behind = F.coalesce(state.agg(F.max("seq") + 1).scalar(), F.lit(0))
    return state.unionByName(entries.withColumn("seq", F.col("seq") + behind))


def advance_state(state: DataFrame, results: DataFrame) -> DataFrame:
    """Take processed URLs off the pending list and record their outcomes."""
    outcomes = record_outcomes(results)
    pending = state.filter("list = 'pending'")
    still = pending.join(outcomes.select("url").distinct(), "url", "left_anti")
    recorded = outcomes.select("list", "url", F.lit(None).cast("long").alias("seq"))
    return (
        state.filter("list <> 'pending'")
        .unionByName(still)
        .unionByName(recorded)
        .groupBy("list", "url")
        .agg(F.min("seq").alias("seq"))
    )


def frontier_stats(state: DataFrame) -> DataFrame:
    """One row: size of each list, and whether nothing is pending."""

    def size(name: str):
        return F.count_if(F.col("list") == name)

    return state.agg(
        size("pending").alias("pending"),
        size("completed").alias("completed"),
        size("failed").alias("failed"),
        size("seen").alias("total_seen"),
        (size("pending") == 0).alias("is_empty"),
    )
