"""Quality scores: ridge regression on random Fourier features of document statistics.

A text becomes a short list of statistics. Random cosines of them approximate a Gaussian
kernel, so ridge regression on the cosines is kernel regression whose normal equations
have a fixed size: tasks add up their part, the driver adds the parts and solves. Labelled
rows kept apart from the fit then calibrate the scores by isotonic regression.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.shared import begin_task, fold, store, table

FOLDS, HELD_OUT = 3, 1
#: The most labelled rows that are used, about; a hash of the text chooses them.
FIT_ROWS = 200_000
#: One labelled row in so many calibrates and is not in the fit.
CALIBRATION_SHARE = 5
FEATURES = 300
RIDGE = 1e-4
SEED = 7
#: Steps of the raw score that calibration tells apart.
STEPS = 2000

#: Characters that are counted together, by their bytes.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,",
    "exclaim": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*@^~=+<>_\\/{}[]`",
    "quote": b"\"'()-:;",
    "line": b"\n",
    "beyond": bytes(range(128, 256)),
}
_MEMBERS = np.zeros((256, len(CLASSES)))
for _i, _chars in enumerate(CLASSES.values()):
    _MEMBERS[list(_chars), _i] = 1.0
NUMBER = len(CLASSES) + 9


def statistics(text: str) -> list[float]:
    """Sizes, repetition, word lengths and shares of character classes; zeros if empty."""
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return [0.0] * NUMBER
    kinds = Counter(words)
    n, size = len(words), len(data)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = histogram @ _MEMBERS / size
    used = histogram[histogram > 0] / size
    letters = shares[0] + shares[1] + shares[9]
    return [
        math.log1p(size),
        math.log1p(n),
        size / n if size / n < 40 else 40.0,
        len(kinds) / n,
        math.log1p(len(kinds)) / math.log1p(n),
        math.sqrt(sum(map(eq, words, words[1:])) / n),
        math.sqrt(max(kinds.values()) / n),
        shares[0] / letters if letters else 0.0,
        float(-(used * np.log(used)).sum()),
        *np.sqrt(shares).tolist(),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, draw, stats)``; ``draw`` is a number by which a sample can be taken."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        begin_task("op7")
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))],
                ["doc_id", "draw", "stats"],
            )

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("draw"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, draw long, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, NUMBER)


@dataclass
class Model:
    """Centre and scale of the statistics, random directions, weights, calibration."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        flat = (stats - self.centre) / self.scale
        # A statistic far outside the sample says no more than one at its edge.
        waves = np.cos(np.clip(flat, -8, 8) @ self.directions + self.phases)
        return np.hstack([waves * math.sqrt(2 / FEATURES), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.cosines(stats) @ self.weights, -0.5, 1.5)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def isotonic(counts: np.ndarray, sums: np.ndarray, centres: np.ndarray):
    """Pool adjacent violators: centres and means of the blocks, both ascending."""
    blocks: list[list[float]] = []
    for n, s, c in zip(counts.tolist(), sums.tolist(), centres.tolist(), strict=True):
        blocks.append([n, s, c * n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, s, c = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], (n, s, c), strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def _sums(rows: DataFrame, make, width: int) -> np.ndarray:
    """The sum over tasks of ``make(stats, labels)``, a vector of ``width`` numbers.

    The rows are a bounded sample and lie in a bounded number of tasks.
    """

    def run(batches):
        begin_task("op7")
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += make(_matrix(batch.column(0)), batch.column(1).to_numpy().astype(float))
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("stats", "quality").mapInArrow(run, "sums binary").collect()
    return np.sum([np.frombuffer(p.sums) for p in parts], axis=0) if parts else np.zeros(width)


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn ``labels.quality`` from at most about ``fit_rows`` rows of ``stats``.

    Labels that are null, or neither 0 nor 1, teach nothing. Without labels every score is
    one half. Several labels of one document count each.
    """
    known = labels.select("doc_id", "quality").where("quality IN (0, 1)")
    rows = store(stats.join(known, "doc_id").select("stats", "quality", "draw"), "labelled")
    number = rows.count()
    if number > fit_rows:
        limit = int(fit_rows / number * (1 << 30))
        rows = rows.where(F.pmod(F.col("draw"), F.lit(1 << 30)) < limit)
    rows = store(rows.repartition(16, "draw"), "sample")
    calibrating = F.pmod(F.xxhash64("draw"), F.lit(CALIBRATION_SHARE)) == 0
    rng = np.random.default_rng(SEED)

    moments = _sums(
        rows, lambda x, y: np.concatenate([[len(y)], x.sum(0), (x * x).sum(0)]), 2 * NUMBER + 1
    )
    n = max(1.0, moments[0])
    centre = moments[1 : NUMBER + 1] / n
    spread = np.sqrt(np.maximum(0, moments[NUMBER + 1 :] / n - centre**2))
    width = FEATURES + 1
    model = Model(
        centre,
        np.where(spread > 1e-9, spread, 1.0),
        rng.standard_normal((NUMBER, FEATURES)) / math.sqrt(NUMBER),
        rng.uniform(0, 2 * math.pi, FEATURES),
        np.zeros(width),
        np.array([0.0]),
        np.array([0.5]),
    )
    if not moments[0]:
        return model

    def equations(x, y):
        z = model.cosines(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _sums(rows.where(~calibrating), equations, width * width + width)
    gram = sums[: width * width].reshape(width, width)
    ridge = RIDGE * n * np.eye(width)
    model.weights = np.linalg.solve(gram + ridge, sums[width * width :])

    def steps(x, y):
        at = np.minimum((model.raw(x) + 0.5) * (STEPS / 2), STEPS - 1).astype(int)
        return np.concatenate([np.bincount(at, None, STEPS), np.bincount(at, y, STEPS)])

    sums = _sums(rows.where(calibrating), steps, 2 * STEPS)
    if not sums[:STEPS].any():  # too few rows to keep some apart
        sums = _sums(rows, steps, 2 * STEPS)
    some = np.flatnonzero(sums[:STEPS])
    model.knots, model.levels = isotonic(
        sums[:STEPS][some], sums[STEPS:][some], (some + 0.5) * (2 / STEPS) - 0.5
    )
    return model


def classify(stats: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``stats``."""
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches):
        begin_task("op7")
        for batch in batches:
            scores = model.score(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "score": pa.array(scores),
                    "predicted": pa.array((scores >= 0.5).astype(np.int32)),
                }
            )

    return stats.select("doc_id", "stats").mapInArrow(
        run, f"doc_id {kind}, score double, predicted int"
    )


def keep_good(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all columns; no shuffle."""
    at = docs.columns.index("text")

    def run(batches):
        begin_task("op7")
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column(at).to_pylist()]
            scores = model.score(np.array(rows).reshape(-1, NUMBER))
            yield batch.filter(pa.array(scores >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model fitted to the labelled documents outside the held-out fold."""
    # Statistics are cheap beside a shuffle of all texts to find the labelled ones.
    rows = docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    return fit(document_statistics(rows), labels)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs(doc_id, text)``.

    Learns from ``labels(doc_id, quality)`` of documents outside the held-out fold.

    * A null text counts as empty; empty texts have zero statistics and are scored.
    * A null doc_id is scored and learns no label. Repeated rows get equal scores.
    * Very long texts are read whole. An empty table gives no rows.
    * Other columns are ignored, whatever their names.
    """
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    stats = store(document_statistics(docs), "statistics")
    model = fit(stats.where(~held_out), labels)
    return classify(stats, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
