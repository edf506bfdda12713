"""Hard negatives from zone maps over candidate blocks in Hilbert order.

Vectors become integers. Rows are stored by label and, within a label, along a Hilbert
curve through the dimensions that vary most, so rows that follow each other lie close
together. A Parquet row holds a block of them, with the least and greatest value of each
dimension: its zone map. Interval arithmetic on a zone map bounds the inner products of an
anchor with all rows of a block, and only blocks whose bounds meet one of the anchor's
score windows are read for it.

A search has two rounds. The first reads, for each anchor, the blocks with the highest
bounds. The scores found there raise the lower ends of the anchor's windows, so that the
second round reads the blocks that can still hold one of the first ranks. Positives are one
search, with one window that holds every score; negatives are another, with a window for
each positive.

Anchors are packed in groups in the same order, and a unit of work is a group and a block:
both are of bounded size, whatever a label or a place on the curve holds.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.llm.shared import store, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score, in percent of its positive's.
LOW, HIGH = 30, 90
#: Rows of a candidate block, anchors of a group, and zone maps that meet a group at a time.
BLOCK, GROUP, SHELF = 1024, 256, 512
#: Dimensions of the Hilbert curve, and bits of each.
DIMENSIONS, BITS = 16, 4
#: No score reaches these.
MOST = np.iinfo(np.int64).max
LEAST = -MOST


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of ``cells`` (rows of ``bits``-bit coordinates), as bytes.

    Rows of bytes in big-endian order, so that they sort as the curve runs.
    """
    x = cells.T.astype(np.int64)
    size = len(x)
    # Level by level, undo the reflections and turns of the curve's quadrants.
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(size):
            inside = (x[i] >> level) & 1 == 1
            swap = np.where(inside, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(inside, below, swap)
            x[i] ^= swap
    # What is left is a Gray code over all dimensions.
    for i in range(1, size):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    spread = [(x >> level) & 1 for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(spread).T.astype(np.uint8), axis=1)


def _whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), held within the range whose scores, times 100, fit 64 bits."""
    limit = min(isqrt(int(MOST) // (100 * max(1, vectors.shape[1]))), 2**31 - 1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * vectors), -limit, limit).astype(np.int32)


def _rows(embeddings: DataFrame, anchor: str, scale: int) -> DataFrame:
    """``(rid, id, label, anchor, size, vector)`` of the rows that take part."""

    def run(batches):
        for batch in batches:
            vectors = batch.column(4)
            sizes = vectors.value_lengths().fill_null(-1).to_numpy().astype(np.int64)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
            usable = (sizes >= 0) & batch.column(2).is_valid().to_numpy(False)
            bad = np.append(0, np.cumsum(~np.isfinite(flat)))
            usable &= bad[starts + np.maximum(sizes, 0)] == bad[starts]
            for size in np.unique(sizes[usable]).tolist():
                own = np.flatnonzero(usable & (sizes == size))
                matrix = flat[starts[own][:, None] + np.arange(size)].reshape(len(own), size)
                packed = [row.tobytes() for row in _whole(matrix, scale)]
                taken = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [
                        *taken.columns[:4],
                        pa.array(np.full(len(own), size), pa.int32()),
                        pa.array(packed, pa.binary()),
                    ],
                    ["rid", "id", "label", "anchor", "size", "vector"],
                )

    rows = embeddings.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("vec_id").cast("long").alias("id"),
        F.col("label").cast("string").alias("label"),
        F.coalesce(F.expr(anchor), F.lit(False)).alias("anchor"),
        "embedding",
    )
    return rows.mapInArrow(
        run, "rid long, id long, label string, anchor boolean, size int, vector binary"
    )


def _matrix(packed: pa.Array, size: int, kind=np.int32) -> np.ndarray:
    data = b"".join(packed.to_pylist())
    return np.frombuffer(data, kind).reshape(len(packed), size)


def _by_size(batch: pa.RecordBatch):
    """``(rows, matrix)`` for each length of vector in a batch with ``size`` and ``vector``."""
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        yield own, _matrix(batch.column("vector").take(pa.array(own)), size)


def _varying(rows: DataFrame) -> list[tuple[int, float, float]]:
    """The dimensions that vary most, with mean and deviation."""

    def run(batches):
        for batch in batches:
            for _, matrix in _by_size(batch):
                matrix = matrix.astype(np.float64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "dimension": pa.array(range(matrix.shape[1]), pa.int32()),
                        "n": pa.array([len(matrix)] * matrix.shape[1], pa.int64()),
                        "s": pa.array(matrix.sum(axis=0)),
                        "ss": pa.array((matrix * matrix).sum(axis=0)),
                    }
                )

    parts = rows.select("size", "vector").mapInArrow(
        run, "dimension int, n long, s double, ss double"
    )
    sums = parts.groupBy("dimension").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    found = sums.select("dimension", mean.alias("mean"), spread.alias("spread"))
    top = found.orderBy(F.desc("spread"), "dimension").limit(DIMENSIONS).collect()
    return [(r["dimension"], r["mean"], r["spread"]) for r in top]


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``, where on the Hilbert curve they lie."""
    varying = _varying(rows)

    def run(batches):
        for batch in batches:
            places: list = [b""] * batch.num_rows
            for own, matrix in _by_size(batch):
                cells = np.zeros((len(own), max(1, len(varying))), np.int64)
                for i, (dimension, mean, spread) in enumerate(varying):
                    if dimension < matrix.shape[1]:
                        # Cells of equal width over two deviations to each side.
                        scaled = (matrix[:, dimension] - mean) / (4 * spread or 1.0) + 0.5
                        cells[:, i] = np.clip(scaled * (1 << BITS), 0, (1 << BITS) - 1)
                for i, place in zip(own.tolist(), hilbert(cells, BITS), strict=True):
                    places[i] = place.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places, pa.binary())], [*batch.schema.names, "place"]
            )

    schema = rows.schema.simpleString()[len("struct<") : -1]
    return rows.mapInArrow(run, f"{schema}, place binary")


def _packed(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Blocks of at most ``most`` rows of one size, in order of label and curve.

    ``(<name>, size, first, last, rids, ids, labels, vectors, low, high)``: ``first`` and
    ``last`` are labels, ``low`` and ``high`` the zone map. A null id stands behind all.
    """

    def block(own: list[pa.RecordBatch]):
        held = pa.Table.from_batches(own).combine_chunks()
        size = held["size"][0].as_py()
        matrix = _matrix(held["vector"].combine_chunks(), size)
        ids = held["id"].fill_null(MOST).to_numpy()
        # Rows of a block stand in the order in which equal scores rank.
        order = np.lexsort((held["rid"].to_numpy(), ids))
        labels = held["label"].to_pylist()
        return pa.RecordBatch.from_pydict(
            {
                "size": pa.array([size], pa.int32()),
                "first": [min(labels)],
                "last": [max(labels)],
                "rids": [held["rid"].to_numpy()[order].tobytes()],
                "ids": [ids[order].tobytes()],
                "labels": pa.array([[labels[i] for i in order]], pa.list_(pa.string())),
                "vectors": [matrix[order].tobytes()],
                "low": [matrix.min(axis=0).tobytes()],
                "high": [matrix.max(axis=0).tobytes()],
            }
        )

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        count, size = 0, None
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            low = 0
            while low < batch.num_rows:
                if waiting and (count == most or sizes[low] != size):
                    yield block(waiting)
                    waiting, count = [], 0
                size = sizes[low]
                other = np.flatnonzero(sizes[low:] != size)
                end = low + (int(other[0]) if len(other) else batch.num_rows - low)
                end = min(end, low + most - count)
                waiting.append(batch.slice(low, end - low))
                count += end - low
                low = end
        if waiting:
            yield block(waiting)

    keys = ["size", "label", "place", "rid"]
    # The row number is in the key, so rows at one place can be dealt apart.
    rows = rows.select("rid", "id", "label", "size", "vector", "place")
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    found = rows.mapInArrow(
        run,
        "size int, first string, last string, rids binary, ids binary, labels array<string>, "
        "vectors binary, low binary, high binary",
    )
    return store(found.select(F.monotonically_increasing_id().alias(name), "*"), name)


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right.T`` in whole numbers."""
    most = [int(np.abs(x.astype(np.int64)).max(initial=0)) for x in (left, right)]
    exact = most[0] * most[1] * max(1, left.shape[1]) < 1 << 53
    kind = np.float64 if exact else np.int64
    return (left.astype(kind) @ right.astype(kind).T).astype(np.int64)


def bounds(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each vector with any in each zone."""
    plus, minus = np.maximum(vectors, 0), np.minimum(vectors, 0)
    least = _product(plus, low) + _product(minus, high)
    return least, _product(plus, high) + _product(minus, low)


def _chosen(groups: DataFrame, blocks: DataFrame, same: bool) -> DataFrame:
    """``(group, block, least, most, seed)``: blocks that an anchor of the group may need.

    ``least`` and ``most`` are the bounds by anchor; where a block cannot matter to an
    anchor, ``most`` is below ``least``. ``seed`` marks blocks to be read first.
    """
    zones = blocks.select("block", "size", "first", "last", "low", "high")
    shelves = max(1, -(-zones.count() // SHELF))
    shelf = F.pmod(F.xxhash64("block"), F.lit(shelves)).cast("int")
    zones = zones.groupBy(shelf.alias("shelf")).agg(
        F.collect_list(F.struct("block", "size", "first", "last", "low", "high")).alias("zones")
    )
    units = groups.select(
        "group", "size", "labels", "vectors", "from", "to",
        F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))).alias("shelf"),
    )
    # Groups of anchors against all zone maps, both in bounded parts.
    units = units.join(store(zones, "zones"), "shelf")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                size = row["size"]
                zones = [z for z in row["zones"] if z["size"] == size]
                if not zones:
                    continue
                count = len(row["labels"])
                anchors = np.frombuffer(row["vectors"], np.int32).reshape(count, size)
                low, high = (
                    np.frombuffer(b"".join(z[c] for z in zones), np.int32).reshape(len(zones), size)
                    for c in ("low", "high")
                )
                least, most = bounds(anchors, low, high)
                start, end = (
                    np.frombuffer(row[c], np.int64).reshape(count, 1, -1) for c in ("from", "to")
                )
                meets = (most[:, :, None] >= start) & (least[:, :, None] <= end)
                labels = np.array(row["labels"], object)[:, None]
                first, last = (np.array([z[c] for z in zones], object) for c in ("first", "last"))
                if same:
                    fits = (first <= labels) & (labels <= last)
                else:
                    fits = (first != labels) | (last != labels)
                needed = meets.any(axis=2) & fits.astype(bool)
                most = np.where(needed, most, LEAST)
                some = np.flatnonzero(needed.any(axis=0))
                if not len(some):
                    continue
                seeds = set(most.argmax(axis=1)[needed.any(axis=1)].tolist())
                yield pa.RecordBatch.from_pydict(
                    {
                        "group": pa.array([row["group"]] * len(some), pa.int64()),
                        "block": pa.array([zones[i]["block"] for i in some], pa.int64()),
                        "least": [least[:, i].tobytes() for i in some],
                        "most": [most[:, i].tobytes() for i in some],
                        "seed": [i in seeds for i in some.tolist()],
                    }
                )

    return store(
        units.mapInArrow(run, "group long, block long, least binary, most binary, seed boolean"),
        "chosen",
    )


def _read(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, same: bool, top: int) -> DataFrame:
    """``(group, slot, window, score, id, rid)``: the first ``top`` of each window so far."""
    names = ["rids", "labels", "vectors"]
    left = groups.select("group", "size", "from", "to", *names)
    right = blocks.select("block", "ids", *[F.col(c).alias(f"b_{c}") for c in names])
    units = pairs.select("group", "block", "most").join(left, "group").join(right, "block")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                size, count, n = row["size"], len(row["labels"]), len(row["b_labels"])
                anchors = np.frombuffer(row["vectors"], np.int32).reshape(count, size)
                others = np.frombuffer(row["b_vectors"], np.int32).reshape(n, size)
                rids, own = (np.frombuffer(row[c], np.int64) for c in ("b_rids", "rids"))
                ids = np.frombuffer(row["ids"], np.int64)
                scores = _product(anchors, others)
                labels = np.array(row["labels"], object)[:, None]
                alike = (labels == np.array(row["b_labels"], object)[None, :]).astype(bool)
                fits = alike & (own[:, None] != rids) if same else ~alike
                fits &= (np.frombuffer(row["most"], np.int64) > LEAST)[:, None]
                scores = np.where(fits, scores, LEAST)
                # Highest first; equal ones stay in order of their ids.
                order = np.argsort(-scores, axis=1, kind="stable")
                ranked = np.take_along_axis(scores, order, axis=1)
                start, end = (
                    np.frombuffer(row[c], np.int64).reshape(count, -1) for c in ("from", "to")
                )
                for window in range(start.shape[1]):
                    above = (ranked > end[:, window, None]).sum(axis=1)
                    at = above[:, None] + np.arange(min(top, n))
                    inside = at < n
                    at = np.minimum(at, n - 1)
                    found = np.take_along_axis(ranked, at, axis=1)
                    inside &= (found >= start[:, window, None]) & (found > LEAST)
                    slot, place = np.nonzero(inside)
                    if not len(slot):
                        continue
                    chosen = order[slot, at[slot, place]]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "group": pa.array([row["group"]] * len(slot), pa.int64()),
                            "slot": pa.array(slot, pa.int32()),
                            "window": pa.array([window] * len(slot), pa.int32()),
                            "score": pa.array(found[slot, place], pa.int64()),
                            "id": pa.array(ids[chosen], pa.int64()),
                            "rid": pa.array(rids[chosen], pa.int64()),
                        }
                    )

    found = units.mapInArrow(
        run, "group long, slot int, window int, score long, id long, rid long"
    )
    order = Window.partitionBy("group", "slot", "window").orderBy(F.desc("score"), "id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _windows(groups: DataFrame, ends: DataFrame, number: int) -> DataFrame:
    """``groups`` with windows set by ``ends(group, slot, window, from, to)``.

    A null end stays as it is; windows that are not named hold nothing if there were none.
    """
    ends = ends.groupBy("group").agg(
        F.collect_list(F.struct("slot", "window", "from", "to")).alias("ends")
    )
    rest = [c for c in groups.columns if c not in ("from", "to")]
    found = groups.join(store(ends, "ends"), "group", "left")

    def run(batches):
        for batch in batches:
            windows: dict[str, list] = {"from": [], "to": []}
            columns = (batch.column(c).to_pylist() for c in ("labels", "from", "to", "ends"))
            for labels, start, end, own in zip(*columns, strict=True):
                shape = (len(labels), number)
                for name, held, nothing in (("from", start, MOST), ("to", end, LEAST)):
                    if held is None:
                        values = np.full(shape, nothing)
                    else:
                        values = np.frombuffer(held, np.int64).reshape(shape).copy()
                    for x in own or ():
                        if x[name] is not None:
                            values[x["slot"], x["window"]] = x[name]
                    windows[name].append(values.tobytes())
            kept = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(v, pa.binary()) for v in windows.values())], [*rest, *windows]
            )

    schema = groups.select(*rest).schema.simpleString()[len("struct<") : -1]
    return store(
        found.select(*rest, "from", "to", "ends").mapInArrow(
            run, f"{schema}, from binary, to binary"
        ),
        "groups",
    )


def _still(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose bounds meet a window as it is now."""

    def run(batches):
        for batch in batches:
            most_of, kept = [], []
            columns = (batch.column(c).to_pylist() for c in ("least", "most", "from", "to"))
            for i, row in enumerate(zip(*columns, strict=True)):
                least, most, start, end = (np.frombuffer(x, np.int64) for x in row)
                start, end = start.reshape(len(most), -1), end.reshape(len(most), -1)
                meets = (most[:, None] >= start) & (least[:, None] <= end)
                most = np.where(meets.any(axis=1), most, LEAST)
                if (most > LEAST).any():
                    kept.append(i)
                    most_of.append(most.tobytes())
            taken = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns[:2], pa.array(most_of, pa.binary())], ["group", "block", "most"]
            )

    found = pairs.select("group", "block", "least", "most").join(
        groups.select("group", "from", "to"), "group"
    )
    return store(found.mapInArrow(run, "group long, block long, most binary"), "still")


def _search(groups: DataFrame, blocks: DataFrame, same: bool, top: int, number: int):
    """The first ``top`` rows of each window, and the pairs of group and block read for it."""
    pairs = _chosen(groups, blocks, same)
    first = _read(pairs.where("seed"), groups, blocks, same, top)
    ends = first.where(F.col("rank") == top).select(
        "group", "slot", "window", F.col("score").alias("from"),
        F.lit(None).cast("long").alias("to"),
    )
    groups = _windows(groups, ends, number)
    pairs = _still(pairs, groups)
    return store(_read(pairs, groups, blocks, same, top), "found"), pairs


def mine(
    embeddings: DataFrame,
    anchor: str,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    block: int = BLOCK,
    group: int = GROUP,
) -> tuple[DataFrame, DataFrame]:
    """Hard negatives of the rows of ``embeddings(vec_id, embedding, label)`` that ``anchor`` holds for.

    A component x counts as floor(``scale`` * x), a score is an inner product. Higher scores
    come first, ties by vec_id. An anchor's positives are its first ``positives`` other rows
    of the same label. For each, its negatives are the first ``negatives`` rows of another
    label with low * positive score <= 100 * score <= high * positive score.

    Returns ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``
    and the pairs ``(group, block)`` of anchors and candidates that the negatives' second
    round read. ``anchor`` is a SQL condition; null means no.

    * Rows with a null label, a null vector, or a null or non-finite component take no part.
    * Vectors of different lengths have no score. Empty vectors have score 0 with each other.
    * Components are held within +-sqrt(2^63 / (100 * length)), so that scores fit a long:
      for 64 dimensions, x within +-148,000.
    * A null vec_id ranks last and is returned as null. Of repeated rows each ranks, and
      each is an anchor of its own; a row is never its own positive.
    * A positive whose score is below 0 has no negatives. Empty tables give no rows. Other
      columns are ignored, whatever their names.
    """
    rows = store(_rows(embeddings, anchor, scale), "vectors")
    rows = store(_placed(rows), "placed")
    blocks = _packed(rows, block, "block")
    groups = _packed(rows.where("anchor"), group, "group").drop("low", "high")

    every = groups.select("group", F.posexplode("labels").alias("slot", "label")).select(
        "group", "slot", F.lit(0).alias("window"),
        F.lit(int(LEAST) + 1).alias("from"), F.lit(int(MOST)).alias("to"),
    )
    nothing = F.lit(None).cast("binary")
    groups = groups.withColumns({"from": nothing, "to": nothing})
    near, _ = _search(_windows(groups, every, 1), blocks, True, positives, 1)

    # Spark's division of longs truncates; the percentages are rounded inwards.
    near = near.where("score >= 0").select(
        "group", "slot", (F.col("rank") - 1).alias("window"),
        F.call_function("div", F.col("score") * low + 99, F.lit(100)).alias("from"),
        F.call_function("div", F.col("score") * high, F.lit(100)).alias("to"),
        F.col("score").alias("positive_score"), F.col("id").alias("positive_id"),
    )
    near = store(near, "positives")
    far, read = _search(_windows(groups, near, positives), blocks, False, negatives, positives)
    names = groups.select("group", "ids").mapInArrow(_names, "group long, slot int, anchor long")
    known = lambda c: F.when(F.col(c) != int(MOST), F.col(c))
    found = far.join(near, ["group", "slot", "window"]).join(names, ["group", "slot"]).select(
        known("anchor").alias("anchor_id"),
        known("positive_id").alias("positive_id"),
        "rank",
        known("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
    return found, read


def _names(batches):
    for batch in batches:
        for number, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = np.frombuffer(packed, np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "group": pa.array([number] * len(ids), pa.int64()),
                    "slot": pa.array(range(len(ids)), pa.int32()),
                    "anchor": pa.array(ids),
                }
            )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), "vec_id % 100 = 0")[0]


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS alike,
         CASE WHEN len(a.e) > 0 THEN list_inner_product(a.e, b.e) ELSE 0 END::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.rid <> b.rid AND len(a.e) = len(b.e)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) AS place
  FROM s WHERE alike
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id,
         p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.place
                            ORDER BY s.score DESC, s.vec_id, s.rid) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.alike AND p.place <= 5
  WHERE 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 10
"""
