"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and
numbered, which names each block by an integer. Adjacent names form pairs, distinct
pairs are sorted and numbered in turn, and so on, until a text has one name. Equal
names at one level mean equal texts: a name stands for its content, never for a hash.

Block contents are shuffled once, to find the distinct ones. Texts then learn their
blocks' names by digest. That is exact as well, because the digests of the distinct
contents are counted first; if two contents share a digest, the content itself is the
key instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.llm.shared import begin_task, free_name, row_key, store, table

#: Bytes of a block. Most texts are one block; a text of a gigabyte takes 18 rounds.
BLOCK_BYTES = 4096


def _normalised(column: pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes with A-Z lowered; ``bytes.lower`` changes nothing else."""
    for text in column.to_pylist():
        yield (text or "").encode("utf-8", "surrogatepass").lower()


def _cut(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)] or [b""]


def _distinct_blocks(docs: DataFrame, size: int, digest_bytes: int) -> DataFrame:
    """``(name, digest, block)``: the distinct blocks, sorted and numbered."""

    def run(batches):
        begin_task("op1")
        for batch in batches:
            found = {b for data in _normalised(batch.column(0)) for b in _cut(data, size)}
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(found), pa.binary())})

    blocks = docs.select("text").mapInArrow(run, "block binary").distinct()
    return blocks.sortWithinPartitions("block").select(
        F.monotonically_increasing_id().alias("name"),
        F.substring(F.unhex(F.sha2("block", 256)), 1, digest_bytes).alias("digest"),
        "block",
    )


def _cut_texts(docs: DataFrame, size: int, digest_bytes: int) -> DataFrame:
    """``docs`` with ``text_sha256`` and the digests of its blocks in place of the text."""

    def run(batches):
        begin_task("op1")
        for batch in batches:
            sums, cuts = [], []
            for data in _normalised(batch.column(0)):
                blocks = _cut(data, size)
                sums.append(hashlib.sha256(data).hexdigest())
                cuts.append([hashlib.sha256(b).digest()[:digest_bytes] for b in blocks])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array(sums, pa.string()),
                    pa.array(cuts, pa.list_(pa.binary())),
                ],
                [*batch.schema.names[1:], "text_sha256", "blocks"],
            )

    rest = docs.drop("text")
    schema = T.StructType(
        [
            *rest.schema.fields,
            T.StructField("text_sha256", T.StringType()),
            T.StructField("blocks", T.ArrayType(T.BinaryType())),
        ]
    )
    return docs.select("text", *rest.columns).mapInArrow(run, schema)


def _by_digest(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``(rid, pos, name, n)``: the name of each block of each text."""
    places = texts.select(
        "rid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "digest")
    )
    return store(places.join(names, "digest").select("rid", "pos", "name", "n"), "names")


def _by_content(docs: DataFrame, size: int) -> DataFrame:
    """The same with the blocks themselves as the key, for digests that contents share."""

    def run(batches):
        begin_task("op1")
        for batch in batches:
            texts = _normalised(batch.column(1))
            for rid, data in zip(batch.column(0).to_pylist(), texts, strict=True):
                blocks = _cut(data, size)
                yield pa.RecordBatch.from_pydict(
                    {
                        "rid": pa.array([rid] * len(blocks), pa.int64()),
                        "n": pa.array([len(blocks)] * len(blocks), pa.int32()),
                        "pos": pa.array(range(len(blocks)), pa.int32()),
                        "block": pa.array(blocks, pa.binary()),
                    }
                )

    places = docs.select("rid", "text").mapInArrow(run, "rid long, n int, pos int, block binary")
    names = store(_distinct_blocks(docs, size, 1).select("name", "block"), "block-names")
    return store(places.join(names, "block").select("rid", "pos", "name", "n"), "names")


def identities(
    docs: DataFrame,
    size: int = BLOCK_BYTES,
    digest_bytes: int = 32,
) -> DataFrame:
    """``docs`` with ``text_sha256``, ``level`` and ``name`` in place of the text.

    ``docs`` has ``rid`` (unique) and ``text``. Rows have the same level and name exactly
    when their normalised texts are equal. ``digest_bytes`` is how much of a block's
    SHA-256 is tried as its key before the content itself.
    """
    texts = store(_cut_texts(docs, size, digest_bytes), "cut-texts")
    names = _distinct_blocks(docs, size, digest_bytes).select("name", "digest")
    names = store(names, "block-names")
    if names.groupBy("digest").count().where("count > 1").isEmpty():
        parts = _by_digest(texts, names)
    else:
        docs = store(docs, "texts")  # so that rows keep their numbers
        texts = store(_cut_texts(docs, size, digest_bytes), "cut-texts")
        parts = _by_content(docs, size)
    longest = texts.agg(F.max(F.size("blocks"))).first()[0] or 1
    done = [parts.where("n = 1").select("rid", F.lit(0).alias("level"), "name")]
    parts = parts.where("n > 1")
    for level in range(1, (longest - 1).bit_length() + 1):
        odd = F.col("pos") % 2 == 1
        pairs = parts.groupBy("rid", "n", F.shiftright("pos", 1).alias("half")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("l"),
            # A text's last name may have no partner; no name is negative.
            F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("r"),
        )
        pairs = store(pairs, "pairs")
        names = (
            pairs.select("l", "r")
            .distinct()
            .sortWithinPartitions("l", "r")
            .select("l", "r", F.monotonically_increasing_id().alias("name"))
        )
        parts = pairs.join(store(names, "pair-names"), ["l", "r"]).select(
            "rid",
            F.col("half").alias("pos"),
            "name",
            F.shiftright(F.col("n") + 1, 1).alias("n"),
        )
        parts = store(parts, "names")
        done.append(parts.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        parts = parts.where("n > 1")
    named = done[0]
    for more in done[1:]:
        named = named.union(more)
    return store(texts.drop("blocks").join(named, "rid"), "identities")


def exact_copies(
    docs: DataFrame,
    carry: tuple[str, ...] = (),
    size: int = BLOCK_BYTES,
    digest_bytes: int = 32,
) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: its group of equal texts and whether it stays.

    Texts are equal when identical after lowering A-Z. Returns ``rid`` (row number),
    ``doc_id``, the columns named in ``carry``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. Of equal texts
    the largest doc_id stays.

    * A null text counts as empty; empty texts are equal to each other.
    * A null doc_id is smaller than any other; a group of only such keeps one, keep_id null.
    * Of rows with the same doc_id and text one stays, the last read.
    * Very long texts take one more round for each doubling. An empty table gives none.
    * Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *carry, "text")
    named = identities(rows, size, digest_bytes)
    groups = named.groupBy("level", "name").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct("doc_id", "rid")).alias("keep"),
    )
    return named.join(store(groups, "groups"), ["level", "name"]).select(
        "rid",
        "doc_id",
        *carry,
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text)`` that stay, with all their columns.

    One row of each group of equal texts stays, as ``exact_copies`` says, nulls and empty
    texts included; of rows with the same doc_id and text, one. Other columns pass through,
    whatever their names; an empty table gives no rows.
    """
    key = free_name(docs, "copy_key")
    keyed = docs.withColumn(key, row_key())
    kept = exact_copies(keyed.select("doc_id", "text", key), (key,)).where("kept").select(key)
    return keyed.join(store(kept, "kept"), key, "left_semi").dropDuplicates([key]).drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents")).drop("rid")


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
