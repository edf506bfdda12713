"""Helpers of several operators: tables, folds, components, text rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.sources.tables import store

# The Unicode White_Space characters, as a character class.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"

#: White space and the word behind it. No pre-tokenizer used here joins two of these:
#: their patterns never cross from a visible character into white space.
CHUNK = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")


#: Caches of this Python worker, and the operator whose tasks use them.
_CACHES: list = []
_OWNER: list[str] = []


def kept_between_tasks(make: Callable) -> Callable:
    """Marks a cache of ``functools`` that an operator's tasks fill in a Python worker."""
    _CACHES.append(make)
    return make


def begin_task(operator: str) -> None:
    """Drop what other operators' tasks have kept in this Python worker.

    Spark gives a worker to one operator after the other, so that what each had kept would
    add up.
    """
    if _OWNER != [operator]:
        for kept in _CACHES:
            kept.cache_clear()
        pa.default_memory_pool().release_unused()
        _OWNER[:] = [operator]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key's text modulo ``parts``; a null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string")) % parts, F.lit(0))


def row_key() -> Column:
    """A digest of doc_id and text, by which a row is found again.

    Each part is written with its length, a null as a mark of its own, so that different
    rows never spell the same.
    """
    spelt = []
    for part in (F.col("doc_id").cast("string"), F.col("text")):
        size = F.octet_length(part).cast("string")
        spelt += [F.coalesce(F.concat(size, F.lit(":")), F.lit("-")), F.coalesce(part, F.lit(""))]
    return F.sha2(F.concat(*spelt), 256)


def free_name(frame: DataFrame, stem: str) -> str:
    """A column name that ``frame`` does not have."""
    taken = {c.lower() for c in frame.columns}
    while stem in taken:
        stem += "_"
    return stem


def forest(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the pairs, some that join the same nodes; fewer than nodes."""
    parent: dict[int, int] = {}
    kept = []
    for a, b in pairs:
        x, y = a, b
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        while parent.setdefault(y, y) != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the smallest node names it.

    Each round gives a node the smallest of itself and its neighbours, follows that
    pointer twice more, and replaces the ends of all edges by what they point to. Edges
    inside a component vanish, so the rounds are about the logarithm of the longest path.
    A node with very many edges is combined before each shuffle; joins read stored
    tables on both sides, so that adaptive execution can split a hot key.
    """
    pair = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pair = store(pair.where("a < b").distinct(), "edges")
    nodes = pair.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    maps = []
    while not pair.isEmpty():
        both = pair.union(pair.select("b", "a"))
        step = both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("to"))
        step = store(step, "pointers")
        for _ in range(2):
            onward = step.select(F.col("node").alias("to"), F.col("to").alias("on"))
            step = step.join(onward, "to", "left").select(
                "node", F.coalesce("on", "to").alias("to")
            )
            step = store(step, "pointers")
        maps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = pair.join(left, "a").join(right, "b").where("x != y")
        pair = store(
            moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
    out = nodes.withColumn("component", F.col("node"))
    for step in maps:
        hop = step.select(F.col("node").alias("component"), F.col("to").alias("on"))
        out = out.join(hop, "component", "left").select(
            "node", F.coalesce("on", "component").alias("component")
        )
    return store(out, "components")
