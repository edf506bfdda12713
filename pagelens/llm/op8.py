"""Embedding near-duplicates from binary codes of random rotations.

Unit vectors are turned by a random rotation and kept as the signs of their coordinates,
with a correction factor that makes the inner product of a code with another vector an
unbiased estimate of the vectors' own. Around the estimate lies a confidence bound. Pairs
whose bound stays below the limit are rejected; the rest are recomputed exactly, in double
precision, and only that decides.

Which pairs are looked at follows from more such signs: vectors that agree in all signs of
one of many bands meet. Vectors at the limit do so in some band but for about five pairs in
ten million, closer ones almost surely; vectors at random almost never. Equal vectors are
one node. Members of a band that many share meet in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.shared import connected_components, forest, store, table

LIMIT = 0.98
BANDS, BAND_BITS = 40, 18
#: Standard deviations of the estimate within which a pair is recomputed.
CONFIDENCE = 6.0
BLOCK = 512
#: Pairs whose arrays are in memory at a time.
CHUNK_PAIRS = 1 << 16
SEED = 11


@lru_cache(maxsize=8)
def directions(size: int) -> np.ndarray:
    """Random rotations of ``size`` dimensions, stacked, as columns."""
    rng = np.random.default_rng([SEED, size])
    number = max(BANDS * BAND_BITS, size)
    turns = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-number // size))]
    return np.hstack(turns)


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band codes, signs under the first rotation and their correction factors."""
    size = vectors.shape[1]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ directions(size)
    bits = (turned[:, : BANDS * BAND_BITS] >= 0).reshape(len(vectors), BANDS, BAND_BITS)
    bands = bits @ (1 << np.arange(BAND_BITS))
    own = turned[:, :size]
    return bands.astype(np.int32), own >= 0, np.abs(own).sum(axis=1) / np.sqrt(size)


def undecided(signs: np.ndarray, factors: np.ndarray, turned: np.ndarray, limit: float):
    """Row by row: can the coded vector's inner product with the other reach ``limit``?"""
    size = signs.shape[1]
    estimate = np.where(signs, turned, -turned).sum(axis=1) / np.sqrt(size) / factors
    off = np.sqrt(np.maximum(0, 1 - factors**2)) / factors
    # The part of the other vector across the coded one is at most sqrt(1 - limit^2) long.
    bound = off * np.sqrt(1 - limit * limit) * min(1.0, CONFIDENCE / np.sqrt(max(1, size - 1)))
    return estimate + bound >= limit


def _rows(embeddings: DataFrame) -> DataFrame:
    """``(rid, vec_id, set_key, vector)``; key and vector are null if nothing can link."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, vectors = [], []
            labels, values = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for label, value in zip(labels, values, strict=True):
                key = data = None
                if label is not None and value and None not in value:
                    vector = np.array(value, np.float64) + 0.0  # -0 becomes 0
                    length = np.linalg.norm(vector)
                    if np.isfinite(vector).all() and length > 0:
                        if not 1e-100 < length < 1e100:  # so that squares stay in range
                            vector = vector / np.abs(vector).max()
                        data = vector.tobytes()
                        named = label.encode("utf-8", "surrogatepass")
                        named = len(named).to_bytes(4, "little") + named
                        key = hashlib.blake2b(named + data, digest_size=16).digest()
                keys.append(key)
                vectors.append(data)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())],
                ["rid", "vec_id", "label", "set_key", "vector"],
            )

    rows = embeddings.select(
        F.monotonically_increasing_id().alias("rid"),
        "vec_id",
        F.col("label").cast("string").alias("label"),
        "embedding",
    )
    return rows.mapInArrow(
        run, f"rid long, vec_id {kind}, label string, set_key binary, vector binary"
    )


def _coded(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            bands: list = [None] * batch.num_rows
            vectors = batch.column(2).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                matrix = np.frombuffer(b"".join(vectors[i] for i in own), np.float64)
                for i, row in zip(own, codes(matrix.reshape(len(own), -1))[0], strict=True):
                    bands[i] = row
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bands, pa.list_(pa.int32()))],
                [*batch.schema.names, "bands"],
            )

    return nodes.select("node", "label", "vector", "weight").mapInArrow(
        run, "node long, label string, vector binary, weight long, bands array<int>"
    )


def _compare(rows: dict[str, list], limit: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Link counts by node and the linked pairs among rows of whole buckets.

    A pair that meets in several bands counts in the first of them.
    """
    starts = [0]
    same = zip(rows["group"], rows["group"][1:], strict=False)
    starts += [i for i, (x, y) in enumerate(same, 1) if x != y]
    left, right = [], []
    for low, high in zip(starts, [*starts[1:], len(rows["group"])], strict=True):
        _, _, i, j = rows["group"][low]
        own = np.array(rows["own"][low:high])
        if i == j:
            x, y = np.triu_indices(high - low, 1)
        else:
            x, y = (a.ravel() for a in np.meshgrid(*map(np.flatnonzero, (own == i, own == j))))
        left.append(x + low)
        right.append(y + low)
    x, y = np.concatenate(left), np.concatenate(right)
    sizes = np.array([len(v) for v in rows["vector"]])
    x, y = x[sizes[x] == sizes[y]], y[sizes[x] == sizes[y]]
    bands, band = np.array(rows["bands"]), np.array([g[1] for g in rows["group"]])
    counts: dict[int, int] = {}
    links = []
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        place = np.zeros(len(sizes), np.int64)
        place[own] = np.arange(len(own))
        matrix = np.frombuffer(b"".join(rows["vector"][k] for k in own), np.float64)
        matrix = matrix.reshape(len(own), -1)
        unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        turned = unit @ directions(size // 8)[:, : size // 8]
        signs, factors = turned >= 0, np.abs(turned).sum(axis=1) / np.sqrt(size // 8)
        of = sizes[x] == size
        for low in range(0, int(of.sum()), CHUNK_PAIRS):
            a, b = x[of][low : low + CHUNK_PAIRS], y[of][low : low + CHUNK_PAIRS]
            p, q = place[a], place[b]
            maybe = undecided(signs[p], factors[p], turned[q], limit)
            a, b, p, q = a[maybe], b[maybe], p[maybe], q[maybe]
            dots = (matrix[p] * matrix[q]).sum(axis=1)
            norms = np.linalg.norm(matrix[p], axis=1) * np.linalg.norm(matrix[q], axis=1)
            hit = dots / norms >= limit
            a, b = a[hit], b[hit]
            if len(a):
                first = (bands[a] == bands[b]).argmax(axis=1) == band[a]
                for k, m in zip(a[first].tolist(), b[first].tolist(), strict=True):
                    for one, other in ((k, m), (m, k)):
                        node = rows["node"][one]
                        counts[node] = counts.get(node, 0) + rows["weight"][other]
                    links.append((rows["node"][k], rows["node"][m]))
    return counts, links


def _linked(nodes: DataFrame, limit: float) -> DataFrame:
    """``(a, b, n)``: partial link counts of node a where b is null, else joining links."""
    coded = store(_coded(nodes), "codes")
    entries = coded.select("node", "label", F.posexplode("bands").alias("band", "code"))
    entries = entries.select("node", "band", F.xxhash64("label", "band", "code").alias("bucket"))
    shared = entries.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("count"))
    shared = store(shared.where("count > 1"), "buckets")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    members = entries.join(shared, ["bucket", "band"]).select(
        "bucket", "band", "node", F.pmod(F.xxhash64("node", "band"), blocks).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"),
    )
    members = members.select(
        "bucket", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own", "node",
    )
    rows = store(members, "members").join(coded.drop("label"), "node")
    names = ["bucket", "band", "i", "j", "own", "node", "vector", "weight", "bands"]

    def run(batches):
        waiting: list = []

        def found(done: list):
            columns = list(zip(*done, strict=True))
            rows = dict(zip(names[4:], map(list, columns[4:]), strict=True))
            rows["group"] = list(zip(*columns[:4], strict=True))
            counts, links = _compare(rows, limit)
            links = forest(links)
            return pa.RecordBatch.from_pydict(
                {
                    "a": pa.array([*counts, *(a for a, _ in links)], pa.int64()),
                    "b": pa.array([*[None] * len(counts), *(b for _, b in links)], pa.int64()),
                    "n": pa.array([*counts.values(), *[0] * len(links)], pa.int64()),
                }
            )

        for batch in batches:
            for low in range(0, batch.num_rows, 4 * BLOCK):
                part = batch.slice(low, 4 * BLOCK)
                waiting += zip(*(c.to_pylist() for c in part.columns), strict=True)
                # The last bucket may go on in the next part.
                last = waiting[-1][:4]
                end = len(waiting)
                while end and waiting[end - 1][:4] == last:
                    end -= 1
                if end:
                    yield found(waiting[:end])
                    waiting = waiting[end:]
        if waiting:
            yield found(waiting)

    keys = ["bucket", "band", "i", "j"]
    sorted_rows = rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, "node")
    return store(sorted_rows.mapInArrow(run, "a long, b long, n long"), "vector-links")


def near_vectors(embeddings: DataFrame, limit: float = LIMIT) -> DataFrame:
    """One row per row of ``embeddings(vec_id, embedding, label)``: its links and component.

    Vectors of one label and one length are linked when their cosine, in double
    precision, is at least ``limit``. Returns ``vec_id``, ``n_links``, ``component_id``
    (the smallest vec_id reachable) and ``kept``.

    * A null label, and a vector that is null, empty or zero, or has a null or non-finite
      component, links with nothing; such a row is kept.
    * Equal vectors are linked; of repeated rows, one stays.
    * A null vec_id comes after all others. An empty table gives no rows.
    * Other columns are ignored, whatever their names.
    """
    rows = store(_rows(embeddings), "vectors")
    order = F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "rid")
    some = rows.where("set_key IS NOT NULL")
    classes = some.groupBy("set_key").agg(
        F.min(order).alias("low"), F.count(F.lit(1)).alias("weight")
    )
    classes = store(classes, "classes")
    firsts = classes.select(F.col("low.rid").alias("rid"), "weight")
    nodes = some.join(firsts, "rid").select(F.col("rid").alias("node"), "label", "vector", "weight")
    links = _linked(nodes, limit)
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    joined = connected_components(links.where("b IS NOT NULL").select("a", "b"))
    classes = (
        classes.withColumn("node", F.col("low.rid"))
        .join(counts, "node", "left")
        .join(joined, "node", "left")
        .select(
            "set_key",
            "low",
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    classes = store(classes, "joined-classes")
    names = classes.groupBy("component").agg(F.min("low").alias("first"))
    named = classes.join(names, "component").select("set_key", "n_links", "first")
    return rows.join(store(named, "named"), "set_key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("first").isNull(), F.col("vec_id"))
        .otherwise(F.col("first.vec_id"))
        .alias("component_id"),
        F.coalesce(F.col("rid") == F.col("first.rid"), F.lit(True)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
  ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT r.a AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.b) AS component_id,
       min(r.b) = r.a AS kept
FROM reach r LEFT JOIN n ON n.a = r.a GROUP BY r.a
"""
