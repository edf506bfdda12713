"""Language-model scores from a weighted backoff automaton.

Word n-grams of the training documents are counted and smoothed: after a history, a word
has its count there and a constant number of imagined words (``PRIOR``) that are spread as
after the shorter history. The n-grams become the states and arcs of an automaton. An arc
carries the log-probability of a word after its state and leads to the longest history that
the model holds; a failure arc carries the share of the imagined words and leads to the
shorter history, down to the root, which knows single words. A text is read once from left
to right: the traversal carries a state, follows failure arcs until there is an arc for the
next word, and adds up what the arcs carry. The texts of a chunk are read side by side.

The model holds every n-gram of the training documents, so it grows with them, and no task
holds it whole. Documents are coded in chunks. Each chunk sends its distinct n-grams, as
sorted runs of hashes with their training counts, to ranges of the hash space; a range adds
the counts up and answers each run with the sums, in the run's order. So a chunk learns all
that the corpus says about its own n-grams, builds the part of the automaton that its texts
can reach, and walks them through it. An n-gram is in a chunk's run once, so that a very
frequent one is no more than any other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.shared import fold, store, table
from pagelens.llm.tokens import Memo

FOLDS, HELD_OUT = 5, 1
#: Imagined words after a history of one word, and of two. Of five pairs tried on ``sf0.1``
#: the one under which texts held out were likeliest.
PRIOR = (300.0, 10.0)
#: What a single word's count is lowered by; it is for words never seen.
WORD_DISCOUNT = 0.5
#: The end of a text as a word, and its beginning; no word holds a space.
END, BEGIN = b" ", b"  "
#: Tokens of a chunk, about; no text is cut.
TOGETHER = 500_000
#: Bytes of text whose n-grams make up a range.
RANGE_BYTES = 8 << 20
#: Parts of the hash space that are counted one behind the other, so that only a part of the
#: runs is on disk at a time.
SLICES = 2
#: Spark's setting by which a query's shuffle files go when it ends.
CLEANING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits by which the n-gram before the last word is turned, for pairs and triples.
TURNS = (23, 10)


def hash_of(word: bytes) -> int:
    """A signed 64-bit hash, which stands for the word in tables."""
    value = xxhash.xxh3_64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def words_of(text: str | None) -> list[bytes]:
    """Tokens of a text, A-Z lowered, and its end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on as planes of equal bytes, without empty upper planes."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    width = 8
    while width > 1 and not planes[width - 1].any():
        width -= 1
    return zstandard.compress(bytes([width]) + planes[:width].tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : raw[0]] = planes.T
    return wide.reshape(-1).view("<u8")


def packed_run(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_run(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def _parts(batch: pa.RecordBatch, column: int):
    """``(from, texts)`` of a batch's parts of about ``TOGETHER`` tokens."""
    low, held, size = 0, [], 0
    for i, text in enumerate(batch.column(column).to_pylist()):
        held.append(text)
        size += len(text or "") // 5 + 2
        if size >= TOGETHER:
            yield low, held
            low, held, size = i + 1, [], 0
    if held:
        yield low, held


def chunks_of(docs: DataFrame, train: Column) -> DataFrame:
    """``docs(doc_id, text)`` in chunks: each text as places in the chunk's list of words.

    ``(chunk, ids, train, sizes, words, places, tokens)``; the first word is ``BEGIN``, and
    ``tokens`` counts those of training texts.
    """
    rows = docs.select(
        F.spark_partition_id().cast("long").alias("part"),
        "doc_id",
        F.coalesce(train, F.lit(False)).alias("train"),
        "text",
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hashes, number = Memo(hash_of), 0
        for batch in batches:
            for low, texts in _parts(batch, 3):
                own = batch.slice(low, len(texts))
                local = {BEGIN: 0}
                places, sizes = [], []
                for text in texts:
                    words = words_of(text)
                    places += [local.setdefault(w, len(local)) for w in words]
                    sizes.append(len(words))
                learnt = np.asarray(own.column(2).to_pylist(), bool)
                offsets = pa.array([0, len(texts)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([own.column(0)[0].as_py() << 32 | number], pa.int64()),
                        pa.ListArray.from_arrays(offsets, own.column(1)),
                        pa.array([packed(learnt)]),
                        pa.array([packed(np.array(sizes))]),
                        pa.array([np.array([hashes[w] for w in local], np.int64).tobytes()]),
                        pa.array([packed(np.array(places))]),
                        pa.array([int(np.array(sizes)[learnt].sum())], pa.int64()),
                    ],
                    ["chunk", "ids", "train", "sizes", "words", "places", "tokens"],
                )
                number += 1

    return rows.mapInArrow(
        run,
        f"chunk long, ids array<{kind}>, train binary, sizes binary, words binary, places binary, "
        "tokens long",
    )


class Grams:
    """The distinct n-grams of a chunk, and the one before and the one after each.

    Words are numbered as in the chunk. Pair i is the words ``first[i]`` and ``second[i]``;
    triple i is pair ``before[i]``, then the word ``last[i]``, and ends in pair ``after[i]``.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, places: np.ndarray, train: np.ndarray):
        self.sizes, self.places = sizes, places
        texts, n = len(sizes), len(words)
        # Every text behind a beginning, word 0.
        starts = np.cumsum(sizes + 1) - sizes - 1
        flat = np.zeros(len(places) + texts, np.int64)
        inside = np.ones(len(flat), bool)
        inside[starts] = False
        flat[inside] = places
        weight = np.repeat(train, sizes + 1).astype(np.float64)
        ends = np.flatnonzero(inside)
        pairs, pair = np.unique(flat[ends - 1] * n + flat[ends], return_inverse=True)
        self.first, self.second = pairs // n, pairs % n
        pair_at = np.zeros(len(flat), np.int64)
        pair_at[ends] = pair
        far = ends[inside[ends - 1]]
        triples, at, triple = np.unique(pair_at[far - 1] * n + flat[far], return_index=True, return_inverse=True)
        self.before, self.last = triples // n, triples % n
        self.after = pair_at[far[at]]
        # Of each token, the pair and the triple that it ends; the first of a text ends no triple.
        self.pair, self.triple = pair, np.full(len(places), len(triples))
        self.later = inside[ends - 1]
        self.triple[self.later] = triple
        self.counts = np.concatenate(
            [
                np.bincount(flat, weight, n),
                np.bincount(pair, weight[ends], len(pairs)),
                np.bincount(triple, weight[far], len(triples)),
            ]
        ).astype(np.uint64)
        self.ends = np.cumsum([n, len(pairs), len(triples)])
        keys = [words.view(np.uint64)]
        for (head, tail), turn in zip(
            ((self.first, self.second), (self.before, self.after)), TURNS, strict=True
        ):
            start, turn = keys[-1][head], np.uint64(turn)
            keys.append((start << turn | start >> (np.uint64(64) - turn)) ^ keys[-1][tail])
        # The last two bits say how long the n-gram is; the beginning is none.
        lengths = np.repeat(np.arange(1, 4, dtype=np.uint64), [len(k) for k in keys])
        lengths[0] = 0
        every = np.concatenate(keys) >> np.uint64(2) << np.uint64(2) | lengths
        self.order = np.argsort(every, kind="stable")
        self.keys = every[self.order]

    @classmethod
    def read(cls, row: dict) -> Grams:
        numbers = (unpacked(row[name]).astype(np.int64) for name in ("sizes", "places", "train"))
        return cls(np.frombuffer(row["words"], np.int64), *numbers)

    def bounds(self, ranges: int) -> np.ndarray:
        """Where the sorted keys of each of the ranges begin, and the end."""
        places = (self.keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        return np.searchsorted(places, np.arange(ranges + 1, dtype=np.uint64))


def _runs(chunks: DataFrame, ranges: int, low: int, high: int) -> DataFrame:
    """``(chunk, part, keys, counts)``: each chunk's n-grams by ranges of their keys, those
    from ``low`` to below ``high``."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams.read(row)
                counts, bounds = grams.counts[grams.order], grams.bounds(ranges)
                own = [(p, bounds[p], bounds[p + 1]) for p in range(low, high)]
                own = [(p, a, b) for p, a, b in own if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["chunk"]] * len(own), pa.int64()),
                        pa.array([p for p, _, _ in own], pa.int64()),
                        pa.array([packed_run(grams.keys[a:b]) for _, a, b in own], pa.binary()),
                        pa.array([packed(counts[a:b]) for _, a, b in own], pa.binary()),
                    ],
                    ["chunk", "part", "keys", "counts"],
                )

    whole = chunks.select("chunk", "train", "sizes", "words", "places")
    return whole.mapInArrow(run, "chunk long, part long, keys binary, counts binary")


def _answers(runs: DataFrame) -> DataFrame:
    """``(chunk, part, counts, words)``: each run's counts over all chunks, in its order; and
    in a range's first row the number of its distinct training words."""

    def add(group: pa.Table) -> pa.Table:
        keys = [unpacked_run(k) for k in group["keys"].to_pylist()]
        counts = np.concatenate([unpacked(c) for c in group["counts"].to_pylist()])
        ends = np.cumsum([len(k) for k in keys])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, counts.astype(np.float64), len(distinct)).astype(np.uint64)
        words = np.zeros(group.num_rows, np.int64)
        words[0] = ((distinct & np.uint64(3) == 1) & (total > 0)).sum()
        sums = np.split(total[place], ends[:-1])
        return pa.table(
            {
                "chunk": group["chunk"],
                "part": group["part"],
                "counts": pa.array([packed(s) for s in sums], pa.binary()),
                "words": pa.array(words),
            }
        )

    return runs.groupBy("part").applyInArrow(add, "chunk long, part long, counts binary, words long")


def _counted(chunks: DataFrame, ranges: int) -> DataFrame:
    """The answers to all chunks' runs, slice by slice; a slice's shuffle files go behind it."""
    conf = chunks.sparkSession.conf
    before = conf.get(CLEANING, None)
    conf.set(CLEANING, "true")
    try:
        cuts = [ranges * i // SLICES for i in range(SLICES + 1)]
        slices = [
            store(_answers(_runs(chunks, ranges, low, high)), "answers")
            for low, high in zip(cuts, cuts[1:])
            if high > low
        ]
    finally:
        if before is None:
            conf.unset(CLEANING)
        else:
            conf.set(CLEANING, before)
    return reduce(DataFrame.union, slices)


@dataclass
class Corpus:
    """Training tokens and distinct words."""

    tokens: int
    distinct: int

    def word_chance(self, counts):
        """Probability of a word seen so often, alone."""
        n = max(1, self.tokens)
        unseen = WORD_DISCOUNT * self.distinct / n / (self.distinct + 1) or 1.0
        return (counts > 0) * (counts - WORD_DISCOUNT) / n + unseen

    def base_chance(self, counts):
        return (counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))


class Automaton:
    """The states and arcs that the texts of a chunk can reach.

    State 0 is the root, then come a state for each word and one for each pair that the
    model holds. ``arcs`` finds the arc of a state and a word; a state without one for the
    word has a failure arc to ``shorter``. The root has an arc for every word.
    """

    def __init__(
        self, grams: Grams, counts: np.ndarray, corpus: Corpus, prior: tuple[float, float] = PRIOR
    ):
        own = np.empty(len(counts))
        own[grams.order] = counts
        words, pairs, triples = np.split(own, grams.ends[:-1])
        n, (one, two) = len(words), prior
        self.known = words > 0
        self.base = np.log10(corpus.base_chance(words))
        chance = corpus.word_chance(words)
        after_one = (pairs + one * chance[grams.second]) / (words[grams.first] + one)
        after_two = (triples + two * after_one[grams.after]) / (pairs[grams.before] + two)
        lost = [[0.0], np.log10(one / (words + one)), np.log10(two / (pairs + two))]
        self.lost = np.concatenate(lost)
        self.shorter = np.concatenate([np.zeros(n + 1, np.int64), grams.second + 1])
        self.root = np.log10(chance)
        self.from_root = np.where(self.known, np.arange(n) + 1, 0)
        self.begin = self.from_root[0]
        p, t = np.flatnonzero(pairs), np.flatnonzero(triples)
        self.width, self.grams = n, grams
        # The last arc stands for none.
        self.weight = np.append(np.log10(np.concatenate([after_one[p], after_two[t]])), 0.0)
        self.target = np.append(np.concatenate([p, grams.after[t]]) + n + 1, 0)
        # The arc that spells a pair, and the one that spells a triple, or -1.
        self.pair_arc, self.triple_arc = np.full(len(pairs), -1), np.full(len(triples) + 1, -1)
        self.pair_arc[p], self.triple_arc[t] = np.arange(len(p)), np.arange(len(t)) + len(p)

    @cached_property
    def arcs(self) -> dict[int, int]:
        """Arcs by state and word, for ``walk``."""
        grams, n = self.grams, self.width
        p, t = np.flatnonzero(self.pair_arc >= 0), np.flatnonzero(self.triple_arc >= 0)
        keys = np.concatenate(
            [(grams.first[p] + 1) * n + grams.second[p], (grams.before[t] + n + 1) * n + grams.last[t]]
        )
        return dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def walk(self, words: list[int], state: int | None = None) -> tuple[float, int]:
        """Log10 probability of the words behind ``state``, and the state they lead to."""
        arcs, weight, target, width = self.arcs.get, self.weight, self.target, self.width
        lost, shorter = self.lost, self.shorter
        state = self.begin if state is None else state
        total = 0.0
        for word in words:
            while state:
                arc = arcs(state * width + word)
                if arc is not None:
                    total += weight[arc]
                    state = target[arc]
                    break
                total += lost[state]
                state = shorter[state]
            else:
                total += self.root[word]
                state = self.from_root[word]
        return total, state


    def walk_texts(self) -> np.ndarray:
        """What ``walk`` finds for each text of the chunk, all of them side by side.

        A token's arc spells a pair or a triple that the chunk has numbered, so no search is
        needed. The state behind a token is the longest history that the model holds, by
        whichever arcs it was reached: an n-gram that is held holds the shorter one it ends in.
        """
        grams, n = self.grams, self.width
        words, sizes = grams.places, grams.sizes
        by_pair, by_triple = self.pair_arc[grams.pair], self.triple_arc[grams.triple]
        state = np.empty(len(words), np.int64)
        state[1:] = np.where(by_pair >= 0, self.target[by_pair], self.from_root[words])[:-1]
        state[~grams.later] = self.begin
        # A token follows two failure arcs at most, then an arc or what the root knows.
        passed = np.zeros((len(words), 3))
        arc = np.full(len(words), -1)
        for step, (low, own) in enumerate(((n, by_triple), (0, by_pair))):
            here = (arc < 0) & (state > low)
            arc[here] = own[here]
            fails = here & (arc < 0)
            passed[fails, step] = self.lost[state[fails]]
            state[fails] = self.shorter[state[fails]]
        passed[:, 2] = np.where(arc >= 0, self.weight[arc], self.root[words])
        # Adds up from left to right.
        return np.bincount(np.repeat(np.arange(len(sizes)), 3 * sizes), passed.ravel(), len(sizes))


def score(docs: DataFrame, train: Column, prior: tuple[float, float] = PRIOR) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of ``docs(doc_id, text)``.

    The model is that of the rows where ``train`` is true. To score other texts, add them to
    the training table with ``train`` false.

    * A null text counts as empty; an empty text is its end alone. A null ``train`` is false.
    * With nothing learned, every token is unknown and has probability 1.
    * A very long text is read whole, in one pass. Repeated rows get equal scores.
    * A null doc_id is kept. An empty table gives no rows. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = store(chunks_of(docs, train), "chunks")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    ranges = 1 + size // RANGE_BYTES
    answers = _counted(chunks, ranges)
    tokens = chunks.agg(F.sum("tokens").alias("n")).first().n or 0
    distinct = answers.agg(F.sum("words").alias("n")).first().n or 0
    corpus = Corpus(tokens, distinct)

    def walk(chunk: pa.Table, found: pa.Table) -> pa.Table:
        row = chunk.select(["train", "sizes", "words", "places"]).to_pylist()[0]
        grams = Grams.read(row)
        sums = sorted(zip(found["part"].to_pylist(), found["counts"].to_pylist(), strict=True))
        counts = np.concatenate([unpacked(c) for _, c in sums])
        own = Automaton(grams, counts, corpus, prior)
        ends = np.cumsum(grams.sizes)
        starts = ends - grams.sizes
        return pa.table(
            {
                "doc_id": chunk["ids"].combine_chunks().flatten(),
                "n_tokens": pa.array(grams.sizes),
                # Every text has an end, so no part is empty.
                "n_known": pa.array(np.add.reduceat(own.known[grams.places].astype(np.int64), starts)),
                "train_tokens": pa.array(np.full(len(starts), tokens)),
                "base_score": pa.array(np.add.reduceat(own.base[grams.places], starts)),
                "score": pa.array(own.walk_texts(), pa.float64()),
            }
        )

    both = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInArrow(
        walk,
        f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    scored = score(docs, ~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )
