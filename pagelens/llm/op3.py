"""MinHash near-duplicates from bottom-k sketches of one hash function.

A document's set of word shingles is hashed by one function, and its k smallest values are
its sketch. Documents whose sketches share enough values are found through inverted lists,
one for each retained value. How many values a linked pair must share follows from the
hypergeometric law, at a miss rate of one in a thousand million; a document is then
entered only under its rarest values, so few that a linked pair cannot avoid meeting, and
passages that many documents share stay out of the lists.

Equal sets are one node. In a first step a list's members meet one of them, drawn by a
hash, so a large group is joined by some of its pairs. Members of a list that are still
apart then meet all others of it: pair by pair in short lists, in blocks of bounded size
in long ones. The sketch of a pair's union estimates similarity and rejects what cannot
reach the limit; what passes is compared on full sets. Only such links join components.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.shared import (
    begin_task, connected_components, forest, free_name, row_key, store, table,
)
from pagelens.llm.tokens import Memo

WORDS = 5
#: A pair is linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
SKETCH = 64
#: The chance that a linked pair shares fewer values than asked for.
MISS = 1e-9
#: Members of a list that are compared pair by pair; longer ones are compared in blocks.
SHORT = 24
BLOCK = 1024

# Fixed odd factors that tell the words of a shingle apart by their place.
FACTORS = np.array(
    [
        0x9E3779B97F4A7C15,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0xD6E8FEB86659FD93,
        0xFF51AFD7ED558CCD,
    ],
    dtype=np.uint64,
)
_WORD_HASHES = Memo(xxhash.xxh3_64_intdigest)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles of a text; one if it has few words.

    The hash stands for the shingle: two different ones of a pair of documents agree with
    a chance of about 1 in 10^19, times their number squared.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    hashed = np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))
    number = max(1, len(words) - WORDS + 1)
    mixed = np.full(number, min(len(words), WORDS), np.uint64)
    for place in range(min(WORDS, len(words))):
        mixed += hashed[place : place + number] * FACTORS[place]
    for factor in FACTORS[3:]:
        mixed ^= mixed >> np.uint64(33)
        mixed *= factor
    mixed ^= mixed >> np.uint64(29)
    return np.unique((mixed >> np.uint64(1)).view(np.int64))


def _quantile(union: int, drawn: int) -> int:
    """The most values that all but MISS of draws from a linked pair's union have in common."""
    common = -(-PERCENT * union // 100)
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    chance = 0.0
    for x in range(max(0, drawn - union + common), drawn + 1):
        if x > common or drawn - x > union - common:
            continue
        chance += math.exp(log(common, x) + log(union - common, drawn - x) - log(union, drawn))
        if chance > MISS:
            return x
    return drawn


@lru_cache(maxsize=100_000)
def _needed(size: int, k: int) -> int:
    largest = size * 100 // PERCENT
    unions = {size, largest, *(size + (largest - size) * i // 8 for i in range(8))}
    return max(1, min(_quantile(u, min(k, u)) for u in unions))


def needed(size: int, k: int = SKETCH) -> int:
    """Sketch values that a set of ``size`` shares with any set it is linked with.

    Falls as sets grow beyond the sketch, so larger sizes are rounded up, and the largest
    taken as without bound.
    """
    if size > 2 * k:
        size = -(-size // k) * k
    return _needed(min(size, 1 << 16), k)


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        begin_task("op3")
        for batch in batches:
            sizes, keys, needs, sketches = [], [], [], []
            for text in batch.column(3).to_pylist():
                own = shingles(text)
                sizes.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                needs.append(needed(len(own), k) if len(own) else 0)
                sketches.append(own[:k])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(needs, pa.int32()),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                ["rid", "doc_id", "row_key", "n_shingles", "set_key", "need", "sketch"],
            )

    return docs.select("rid", "doc_id", "row_key", "text").mapInArrow(
        run,
        f"rid long, doc_id {kind}, row_key string, n_shingles long, set_key binary, need int, "
        "sketch array<long>",
    )


def _lists(nodes: DataFrame) -> DataFrame:
    """``(value, node)``: the rarest sketch values of each node that others have too."""
    values = nodes.select(
        "node", "need", F.size("sketch").alias("n"), F.explode("sketch").alias("value")
    )
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    shared = values.join(store(counts, "value-counts"), "value")
    own = shared.groupBy("node").agg(
        F.first("need").alias("need"),
        F.first("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("count", "value"))).alias("values"),
    )
    # Values of no other node come first in the order and take places of the prefix.
    take = F.col("n") - F.col("need") + 1 - (F.col("n") - F.size("values"))
    entries = own.select(
        "node",
        F.explode(F.slice("values", F.lit(1), F.greatest(take, F.lit(0)))).alias("entry"),
    ).select("entry.value", "node")
    return store(entries, "entries")


def _passing(pairs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Pairs whose union sketch does not rule a link out."""
    a = nodes.select(F.col("node").alias("a"), F.col("need").alias("p"), F.col("sketch").alias("x"))
    b = nodes.select(F.col("node").alias("b"), F.col("need").alias("q"), F.col("sketch").alias("y"))
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("x", "y"), union))
    return store(
        pairs.join(a, "a").join(b, "b").where(both >= F.greatest("p", "q")).select("a", "b"),
        "passing",
    )


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _unpack(packed: bytes) -> np.ndarray:
    return shingles(zstandard.decompress(packed).decode("utf-8", "surrogatepass"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are linked, by their full sets."""

    def run(batches):
        begin_task("op3")
        for batch in batches:
            sets = Memo(_unpack, 200)  # a list's centre comes many times
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            found = [(a, b) for a, b, x, y in rows if _linked(sets[x], sets[y])]
            yield pa.RecordBatch.from_pydict(
                {
                    "a": pa.array([a for a, _ in found], pa.int64()),
                    "b": pa.array([b for _, b in found], pa.int64()),
                }
            )

    a = texts.select(F.col("node").alias("a"), F.col("packed").alias("x"))
    b = texts.select(F.col("node").alias("b"), F.col("packed").alias("y"))
    full = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y")
    return store(full.mapInArrow(run, "a long, b long"), "links")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs, by products of incidence matrices."""
    x, y = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), np.float32)
    rows = np.repeat(np.arange(len(left)), [len(s) for s in left])
    columns = np.repeat(np.arange(len(right)), [len(s) for s in right])
    at_x, at_y = np.searchsorted(shared, x), np.searchsorted(shared, y)
    if len(shared):
        in_x = shared[np.minimum(at_x, len(shared) - 1)] == x
        in_y = shared[np.minimum(at_y, len(shared) - 1)] == y
        rows, at_x, columns, at_y = rows[in_x], at_x[in_x], columns[in_y], at_y[in_y]
    for low in range(0, len(shared), 4096):
        a = np.zeros((len(left), 4096), np.float32)
        b = np.zeros((len(right), 4096), np.float32)
        own = (at_x >= low) & (at_x < low + 4096)
        a[rows[own], at_x[own] - low] = 1
        own = (at_y >= low) & (at_y < low + 4096)
        b[columns[own], at_y[own] - low] = 1
        out += a @ b.T
    return out


def _block_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members of long lists that lie in different components.

    ``members(value, node, component, minor, count, minors)``. Each member outside a list's
    largest component meets all members, in blocks of ``BLOCK`` on either side. A block
    gives the links that join its nodes, not its pairs.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    left = members.where("minor").select(
        "value", own("minors").alias("i"), F.explode(upto("count")).alias("j"),
        F.lit(True).alias("left"), "node", "component",
    )
    right = members.select(
        "value", F.explode(upto("minors")).alias("i"), own("count").alias("j"),
        F.lit(False).alias("left"), "node", "component",
    )
    rows = left.union(right).join(texts, "node")

    def run(key, frame):
        sides = []
        for side in (True, False):
            part = frame.filter(pa.compute.equal(frame["left"], side))
            sets = [_unpack(p) for p in part["packed"].to_pylist()]
            sides.append((part["node"].to_pylist(), part["component"].to_numpy(), sets))
        (a, p, x), (b, q, y) = sides
        found = []
        if a and b:
            common = _overlaps(x, y)
            sizes = np.add.outer([len(s) for s in x], [len(s) for s in y])
            hit = (100 * common >= PERCENT * (sizes - common)) & (p[:, None] != q[None, :])
            found = forest((a[i], b[j]) for i, j in np.argwhere(hit).tolist())
        return pa.table(
            {
                "a": pa.array([a for a, _ in found], pa.int64()),
                "b": pa.array([b for _, b in found], pa.int64()),
            }
        )

    grouped = rows.groupBy("value", "i", "j").applyInArrow(run, "a long, b long")
    return store(grouped, "block-links")


def _links(nodes: DataFrame, docs: DataFrame, k: int, short: int) -> DataFrame:
    """``(a, b)``: links that join each component of ``nodes``."""
    entries = _lists(nodes)
    lists = entries.groupBy("value").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(F.struct(F.xxhash64("value", "node").alias("draw"), "node")).alias("centre"),
        F.bit_xor(F.xxhash64("node")).alias("one"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two"),
    )
    # Lists with the same members, by 128 bits of them, are one.
    lists = lists.where("count > 1").groupBy("count", "one", "two")
    lists = lists.agg(F.min(F.struct("value", "centre.node")).alias("list"))
    lists = lists.select("list.value", "count", F.col("list.node").alias("centre"))
    entries = store(entries.join(store(lists, "lists"), "value"), "listed")

    listed = nodes.join(entries.select("node").distinct(), "node", "left_semi")
    keys = store(listed.select("row_key", "node"), "listed-keys")

    def pack(batches):
        squeeze = zstandard.ZstdCompressor()
        for batch in batches:
            packed = [
                squeeze.compress((t or "").encode("utf-8", "surrogatepass"))
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary())], ["node", "packed"]
            )

    # The same plan at every size: all texts meet the keys of the few that are wanted.
    found = docs.select("row_key", "text").join(keys.hint("merge"), "row_key")
    found = found.select("node", "text")
    packed = found.mapInArrow(pack, "node long, packed binary")
    texts = store(packed.dropDuplicates(["node"]), "packed-texts")

    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = entries.where("node != centre").select(*ends("node", "centre")).distinct()
    first = store(first, "first-pairs")
    links = _verified(_passing(first, nodes, k), texts)

    joined = connected_components(links)
    members = store(
        entries.join(joined, "node", "left").select(
            "value", "node", "count", F.coalesce("component", "node").alias("component")
        ),
        "members",
    )
    sizes = members.groupBy("value", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("value").agg(
        F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all")
    )
    largest = largest.where("most.n < all").select(
        "value", F.col("most.component").alias("main"), (F.col("all") - F.col("most.n")).alias("minors")
    )
    apart = members.join(store(largest, "largest"), "value").select(
        "value", "node", "component", (F.col("component") != F.col("main")).alias("minor"),
        "count", "minors",
    )
    apart = store(apart, "apart")

    few = apart.where(F.col("count") <= short)
    other = few.select("value", F.col("node").alias("other"), F.col("component").alias("beyond"))
    pairs = (
        few.where("minor").join(other, "value").where("component != beyond")
        .select(*ends("node", "other")).distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    links = links.union(_verified(_passing(store(pairs, "pairs"), nodes, k), texts))
    return links.union(_block_links(apart.where(F.col("count") > short), texts))


def near_copies(docs: DataFrame, k: int = SKETCH, short: int = SHORT) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: the component of near-duplicates it is in.

    Returns ``rid``, ``doc_id``, ``row_key`` (a digest of doc_id and text), ``n_shingles``,
    ``component_id`` (the smallest doc_id reachable by links) and ``kept``.

    * A null or empty text, or one of white space, has no shingles, is linked with nothing
      and is kept. Fewer than five words are one shingle.
    * Equal sets are linked; of repeated rows, one stays.
    * A null doc_id comes after all others and never names a component that has another.
    * Very long texts are read whole. An empty table gives no rows.
    * Other columns are ignored, whatever their names.
    """
    rows = docs.select("doc_id", "text", row_key().alias("row_key"))
    sketches = _sketches(rows.withColumn("rid", F.monotonically_increasing_id()), k)
    sketches = store(sketches, "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    some = sketches.where("n_shingles > 0")
    classes = store(some.groupBy("set_key").agg(F.min(order).alias("low")), "classes")
    nodes = some.join(classes.select(F.col("low.rid").alias("rid")), "rid", "left_semi").select(
        F.col("rid").alias("node"), "row_key", "need", "sketch"
    )
    nodes = store(nodes, "nodes")
    joined = connected_components(_links(nodes, rows, k, short))
    classes = classes.join(joined, F.col("low.rid") == F.col("node"), "left").select(
        "set_key", "low", F.coalesce("component", "low.rid").alias("component")
    )
    classes = store(classes, "joined-classes")
    names = classes.groupBy("component").agg(F.min("low").alias("first"))
    named = store(classes.join(store(names, "names"), "component").select("set_key", "first"), "named")
    out = sketches.select("rid", "doc_id", "row_key", "n_shingles", "set_key")
    return out.join(named, "set_key", "left").select(
        "rid",
        "doc_id",
        "row_key",
        "n_shingles",
        F.when(F.col("first").isNull(), F.col("doc_id"))
        .otherwise(F.col("first.doc_id"))
        .alias("component_id"),
        F.coalesce(F.col("rid") == F.col("first.rid"), F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text)`` that stay, with all their columns.

    One row of each component stays, as ``near_copies`` says, and all texts without words;
    of rows with the same doc_id and text, one. Other columns pass through, whatever their
    names; an empty table gives no rows.
    """
    key = free_name(docs, "row_key")
    kept = near_copies(docs).where("kept").select(F.col("row_key").alias(key)).distinct()
    keyed = docs.withColumn(key, row_key())
    return keyed.join(store(kept, "kept"), key, "left_semi").dropDuplicates([key]).drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i
        FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id,
       min(r.b) = d.doc_id AS kept
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
