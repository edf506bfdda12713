"""Packing texts into fixed windows by non-negative least squares.

Texts are cut into whole windows and one remainder. Remainders are counted by length,
rounded up to a small quantum. All sets of up to three lengths that fill a window are
enumerated, and non-negative least squares finds how often to use each so that together
they use up the histogram. The counts are rounded down; what is left over is packed
greedily, best fit first, in groups of bounded size.

The solution depends on the histogram alone, whose size does not grow with the input. A
remainder finds its sequence from its rank among those of its length, which comes from
counts per scan task; no length, however frequent, is gathered in one task.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.llm.shared import begin_task, store, table
from pagelens.llm.tokens import default_path, packed_ids_of_many

WINDOW = 2048
#: Remainders are grouped by length in steps of so many tokens; at most three steps pad.
QUANTUM = 8
#: Pieces of a group that is packed greedily in one task.
GROUP = 2000
END_ID = 1
#: Characters of texts that are encoded together.
TOGETHER = 8 << 20

PIECE = (
    "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, "
    "bin int, task int, place long"
)


def _together(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``TOGETHER`` characters."""
    low = size = 0
    for high, text in enumerate(texts, 1):
        size += len(text)
        if size >= TOGETHER or high == len(texts):
            yield low, high
            low, size = high, 0


def _pieces(docs: DataFrame, path: str, end_id: int, window: int, quantum: int) -> DataFrame:
    """Windows and remainders of each text; ``place`` counts a task's remainders of a bin."""
    end = end_id.to_bytes(4, "little")
    schema = PIECE.format(id=docs.schema["doc_id"].dataType.simpleString())

    def run(batches):
        begin_task("op9")
        encode = packed_ids_of_many(path)
        task = TaskContext.get().partitionId()
        seen = [0] * (window // quantum + 2)
        for batch in batches:
            texts, docs_of = [t or "" for t in batch.column(1).to_pylist()], batch.column(0)
            for low, high in _together(texts):
                out = {name: [] for name in ("row", "start", "ids", "tokens", "bin", "place")}
                for row, data in enumerate(encode(texts[low:high]), low):
                    data += end
                    for at in range(0, len(data), 4 * window):
                        ids = data[at : at + 4 * window]
                        size = len(ids) // 4
                        kind = 0 if size == window else -(-size // quantum)
                        out["row"].append(row)
                        out["start"].append(at // 4)
                        out["ids"].append(ids)
                        out["tokens"].append(len(data) // 4)
                        out["bin"].append(kind)
                        out["place"].append(seen[kind])
                        seen[kind] += 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": docs_of.take(pa.array(out["row"], pa.int64())),
                        "start": pa.array(out["start"], pa.int64()),
                        "length": pa.array([len(x) // 4 for x in out["ids"]], pa.int64()),
                        "ids_crc32": pa.array(map(zlib.crc32, out["ids"]), pa.int64()),
                        "doc_tokens": pa.array(out["tokens"], pa.int64()),
                        "ids": pa.array(out["ids"], pa.binary()),
                        "bin": pa.array(out["bin"], pa.int32()),
                        "task": pa.array([task] * len(out["row"]), pa.int32()),
                        "place": pa.array(out["place"], pa.int64()),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def combinations(steps: int) -> np.ndarray:
    """Up to three lengths that sum to ``steps``, each row ascending; 0 means none."""
    rows = [(0, 0, steps)]
    rows += [(0, a, steps - a) for a in range(1, steps // 2 + 1)]
    rows += [
        (a, b, steps - a - b)
        for a in range(1, steps // 3 + 1)
        for b in range(a, (steps - a) // 2 + 1)
    ]
    return np.array(rows)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Non-negative x that minimises ||A x - histogram||, by accelerated projected gradient.

    Column c of A counts the lengths of combination c. Index 0 of the histogram is unused.
    """
    size, total = len(histogram), histogram.sum()
    if not total:
        return np.zeros(len(combos))
    real = combos > 0

    def times(x):
        return np.bincount(combos.ravel(), (real * x[:, None]).ravel(), size)

    def transposed(r):
        return (r[combos] * real).sum(axis=1)

    goal = histogram / total
    v = np.ones(len(combos))
    for _ in range(30):
        v = transposed(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(combos))
    momentum = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - transposed(times(y) - goal) / norm)
        after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        y = new + (momentum - 1) / after * (new - x)
        x, momentum = new, after
    return x * total


def allot(histogram: np.ndarray) -> tuple[dict[int, tuple], int]:
    """Whole numbers of each combination, as ranges of ranks.

    Returns, for each bin, sorted arrays (first rank, first sequence, times in a sequence,
    slot) and the number of sequences. Ranks from the last entry on are left over.
    """
    combos = combinations(len(histogram) - 1)
    counts = solve_counts(combos, histogram)
    left, sequences = histogram.astype(np.int64), 0
    ranges: dict[int, list] = {b: [] for b in range(len(histogram))}
    for c in np.argsort(-counts, kind="stable"):
        bins, times = np.unique(combos[c][combos[c] > 0], return_counts=True)
        number = min(int(counts[c] + 1e-6), *(left[bins] // times).tolist())
        if number <= 0:
            continue
        for slot, (b, m) in enumerate(zip(bins.tolist(), times.tolist(), strict=True)):
            ranges[b].append((int(histogram[b] - left[b]), sequences, m, slot * 3))
            left[b] -= number * m
        sequences += number
    for b, found in ranges.items():
        found.append((int(histogram[b] - left[b]), -1, 1, 0))
    return {b: tuple(map(np.array, zip(*x, strict=True))) for b, x in ranges.items()}, sequences


def best_fit(lengths: list[int], window: int) -> list[int]:
    """A sequence number for each length: longest first, into the fullest that has room."""
    numbers = [0] * len(lengths)
    room: list[tuple[int, int]] = []
    opened = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            space, number = room.pop(at)
        else:
            space, number, opened = window, opened, opened + 1
        numbers[i] = number
        insort(room, (space - lengths[i], number))
    return numbers


def pack(
    docs: DataFrame,
    path: str | None = None,
    end_id: int = END_ID,
    window: int = WINDOW,
    quantum: int = QUANTUM,
) -> DataFrame:
    """Pieces of the texts of ``docs(doc_id, text)`` and their places in sequences.

    A text's ids, then ``end_id``, are cut into windows and a remainder. One row per
    piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and ``ids`` (little-endian 32-bit numbers). Offsets in a
    sequence have no gaps; a sequence is at most ``window`` long.

    * A null text counts as empty; an empty text is one piece with ``end_id`` alone.
    * A null or repeated doc_id is a text like any other; equal rows are packed each.
    * A very long text gives whole windows, each a sequence of its own, and a remainder.
    * An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    path = path or default_path("word_bpe_49k.json")
    steps = window // quantum
    pieces = store(_pieces(docs, path, end_id, window, quantum), "pieces")
    counts = store(pieces.groupBy("bin", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = np.zeros(steps + 1)
    whole = 0
    for row in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # one row a bin
        if row.bin:
            histogram[row.bin] = row.n
        else:
            whole = row.n
    ranges, planned = allot(histogram)
    over = {b: int(histogram[b] - x[0][-1]) for b, x in ranges.items()}
    groups = max(1, -(-sum(over.values()) // GROUP))

    before = Window.partitionBy("bin").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "bin", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, start long, length long, task int, place long, bin int, "

    def place(batches):
        for batch in batches:
            bins, ranks = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            sequence, slot = np.empty(len(bins), np.int64), np.zeros(len(bins), np.int32)
            for b in np.unique(bins).tolist():
                own = np.flatnonzero(bins == b)
                rank = ranks[own]
                if b == 0:
                    sequence[own] = planned + rank
                    continue
                first, start, times, slots = ranges[b]
                at = np.searchsorted(first, rank, side="right") - 1
                step = rank - first[at]
                sequence[own] = np.where(start[at] < 0, -1 - step % groups, start[at] + step // times[at])
                slot[own] = slots[at] + step % times[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array(sequence), pa.array(slot)],
                [*batch.schema.names[:6], "sequence_id", "slot"],
            )

    ranked = pieces.join(offsets, ["bin", "task"]).select(
        "doc_id", "start", "length", "task", "place", "bin",
        (F.col("ahead") + F.col("place")).alias("rank"),
    )
    placed = store(ranked.mapInArrow(place, columns + "sequence_id long, slot int"), "placed")

    def greedy(key, frame):
        frame = frame.sort_by([("task", "ascending"), ("bin", "ascending"), ("place", "ascending")])
        numbers = best_fit(frame["length"].to_pylist(), window)
        base = planned + whole + (-1 - key[0].as_py()) * (GROUP + len(over))
        at = frame.schema.get_field_index("sequence_id")
        frame = frame.set_column(at, "sequence_id", pa.array([base + x for x in numbers], pa.int64()))
        return frame.set_column(
            frame.schema.get_field_index("slot"), "slot", pa.array(range(len(frame)), pa.int32())
        )

    rest = placed.where("sequence_id < 0").groupBy("sequence_id")
    rest = rest.applyInArrow(greedy, columns + "sequence_id long, slot int")
    earlier = (
        Window.partitionBy("sequence_id")
        .orderBy("slot", "task", "bin", "place")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    found = placed.where("sequence_id >= 0").union(rest).select(
        "task", "bin", "place", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"),
    )
    return pieces.join(store(found, "sequences"), ["task", "bin", "place"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
