"""Token counts through a cache of digests.

Counts are kept in a table keyed by a digest of the text and one of the tokenizer's file.
Texts that the cache does not know are encoded once each, however often they occur, and
their counts are appended; all texts then look theirs up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.shared import store, table
from pagelens.llm.tokens import default_path, token_counts
from pagelens.session import scratch_path

LIMIT = 512
CACHE = "text_digest binary, tokenizer_digest binary, n_tokens long"


@cache
def tokenizer_digest(path: str) -> bytes:
    """SHA-256 of the tokenizer's file: another version has other counts."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).digest()


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The counts at ``path``; a digest that two runs appended counts once."""
    return spark.read.schema(CACHE).parquet(path)


def create_cache(spark: SparkSession, path: str) -> None:
    """An empty cache at ``path``, unless there is one."""
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(path)


def add_misses(docs: DataFrame, cache_path: str, tokenizer: str) -> None:
    """Encode each distinct text of ``docs`` that the cache lacks, and append its count."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select(text_digest(F.col("text")).alias("text_digest"), "text")
    known = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == F.lit(version))
    if not known.isEmpty():
        texts = texts.join(known.select("text_digest"), "text_digest", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counts(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                yield pa.RecordBatch.from_pydict(
                    {
                        "text_digest": part.column(0),
                        "tokenizer_digest": pa.array([version] * part.num_rows, pa.binary()),
                        "n_tokens": pa.array(count(part.column(1).to_pylist()), pa.int64()),
                    }
                )

    # Copies are dropped within each task before the shuffle.
    texts.distinct().mapInArrow(run, CACHE).write.mode("append").parquet(cache_path)


def count_tokens(
    docs: DataFrame, cache_path: str, tokenizer: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs(doc_id, text)``.

    ``cache_path`` is a table that later calls go on using; a missing one is created.
    The content digest is of the text as it is, null as empty: these tokenizers tell
    letter cases and white space apart, so nothing else may be made equal.

    * A null or empty text has no bytes and no tokens. An empty table gives no rows.
    * Texts repeated within the table, or known to the cache, are not encoded again.
    * Very long texts are encoded whole. A null or repeated doc_id is kept.
    * Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_path("byte_bpe_50k.json")
    create_cache(spark, cache_path)
    add_misses(docs, cache_path, tokenizer)
    version = F.lit(tokenizer_digest(tokenizer))
    counts = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version)
    counts = counts.groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))
    # Stored, so that both sides of the join are read and a hot digest can be split.
    counts = store(counts, "counts")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        text_digest(text).alias("text_digest"),
    )
    return rows.join(counts, "text_digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "token-counts"))
