"""Language identification by cross-parsing.

For each language a suffix automaton of sample text is built. A text is cut from left to
right into the longest phrases that occur in the sample; the language whose sample needs
the fewest phrases for the length wins. An automaton is turned into a table in which a
step that fails starts the next phrase, so a text is read once, without going back.

Many texts are read side by side: step t advances all of them by their t-th letter, in
all languages, with a handful of array operations. Long texts are read in strips of a
fixed length side by side, so a very long one does not hold up the rest; each strip adds
at most one phrase.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.shared import begin_task, fold, kept_between_tasks, table

#: Bounds of the labelled sample: letters a language, texts a language. A run of other
#: characters counts as one letter.
SAMPLE_LETTERS = 20_000
SAMPLE_TEXTS = 64
#: Letters of a piece of a text that is too long to be taken whole.
PIECE = 100
#: Letters with a column in the table, the most frequent of the sample. Arcs of its other
#: letters are a sorted list. Letters that no sample holds share a symbol.
ALPHABET = 250
STRIP = 2048
#: Strips that are read side by side.
LANES = 4096
#: Texts that are read side by side.
TOGETHER = 2000
UNKNOWN = "und"
FOLDS = 5


class Reader:
    """Phrase counts of texts against sample texts, ``samples[i]`` for language i."""

    def __init__(self, samples: tuple[str, ...]):
        seen = Counter(c for text in samples for c in text.lower() if c.isalpha())
        ranked = sorted(seen, key=lambda c: (-seen[c], c))
        own = {c: i + 2 for i, c in enumerate(ranked)}
        # 0: not a letter, 1: a letter that no sample holds.
        self.kinds = len(ranked) + 2
        self.symbols = np.zeros(0x110000, np.min_scalar_type(self.kinds - 1))
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                self.symbols[point] = own.get(c.lower()[:1], 1)
        self.width = min(len(ranked), ALPHABET) + 2
        rare: dict[int, int] = {}
        tables, before = [], 0
        for text in samples:
            tables.append(self._table(self.encode(text), before, rare))
            before += len(tables[-1]) // self.width
        self.rare = np.array(sorted(rare), np.int64)
        self.rare_steps = np.array([rare[k] for k in self.rare.tolist()], np.int64)
        self.base = np.cumsum([0, *(len(t) for t in tables[:-1])])[:, None]
        self.table = np.concatenate(tables)
        self.first = self.base // self.width
        self.fresh = np.array([len(t) // self.width - 1 for t in tables])[:, None]

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text; any run of other characters is one 0."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbols[points]
        keep = symbols > 0
        keep[1:] |= symbols[:-1] > 0
        return symbols[keep]

    def _table(self, text: np.ndarray, before: int, rare: dict[int, int]) -> np.ndarray:
        """Twice the next state, plus 1 where a phrase starts, for each state and symbol.

        Arcs of symbols without a column go to ``rare``, by the state's place behind
        ``before`` others and the symbol.
        """
        links, lengths, arcs = [-1], [0], [{}]
        last = 0
        for c in text.tolist():
            new = len(arcs)
            arcs.append({})
            lengths.append(lengths[last] + 1)
            links.append(0)
            p = last
            while p >= 0 and c not in arcs[p]:
                arcs[p][c] = new
                p = links[p]
            if p >= 0:
                q = arcs[p][c]
                if lengths[q] == lengths[p] + 1:
                    links[new] = q
                else:
                    copy = len(arcs)
                    arcs.append(dict(arcs[q]))
                    lengths.append(lengths[p] + 1)
                    links.append(links[q])
                    while p >= 0 and arcs[p].get(c) == q:
                        arcs[p][c] = copy
                        p = links[p]
                    links[q] = links[new] = copy
            last = new
        # From the last state every symbol starts a phrase; a symbol that is nowhere in
        # the sample is a phrase by itself and leads there.
        fresh = len(arcs)
        start = np.full(self.width, 2 * fresh + 1, np.int32)
        for c, to in arcs[0].items():
            if c < self.width:
                start[c] = 2 * to + 1
        out = np.tile(start, (fresh + 1, 1))
        for state, own in enumerate(arcs):
            for c, to in own.items():
                if c < self.width:
                    out[state, c] = 2 * to
                else:
                    rare[(before + state) * self.kinds + c] = 2 * to
        return out.ravel()

    def _rare_step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The same for symbols without a column; a failing step starts from the root."""
        step = np.broadcast_to(2 * self.fresh + 1, states.shape).copy()
        for at, starts in ((np.zeros_like(states), 1), (states, 0)):
            keys = (self.first + at) * self.kinds + symbols
            place = np.minimum(np.searchsorted(self.rare, keys), len(self.rare) - 1)
            known = self.rare[place] == keys
            step[known] = self.rare_steps[place[known]] + starts
        return step

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text in each language, a row a text."""
        strips = [(i, t[at : at + STRIP]) for i, t in enumerate(texts) for at in range(0, len(t), STRIP)]
        strips.sort(key=lambda s: -len(s[1]))
        out = np.zeros((len(texts), len(self.base)), np.int64)
        for low in range(0, len(strips), LANES):
            some = strips[low : low + LANES]
            np.add.at(out, [s[0] for s in some], self._counts([s[1] for s in some]).T)
        return out

    def _counts(self, strips: list[np.ndarray]) -> np.ndarray:
        """Phrases of strips, the longest first, a column a strip."""
        lengths = np.array([len(s) for s in strips])
        grid = np.zeros((lengths[0], len(strips)), self.symbols.dtype)
        for lane, symbols in enumerate(strips):
            grid[: len(symbols), lane] = symbols
        states = np.repeat(self.fresh, len(strips), axis=1)
        counts = np.zeros(states.shape, np.int32)
        for t in range(lengths[0]):
            live = np.searchsorted(-lengths, -t)  # strips longer than t
            now = grid[t, :live].astype(np.int64)
            step = self.table[self.base + states[:, :live] * self.width + np.minimum(now, self.width - 1)]
            if len(self.rare):
                lanes = np.flatnonzero(now >= self.width)
                if len(lanes):
                    step[:, lanes] = self._rare_step(states[:, lanes], now[lanes])
            states[:, :live] = step >> 1
            counts[:, :live] += step & 1
        return counts


@kept_between_tasks
@lru_cache(maxsize=2)
def reader(samples: tuple[str, ...]) -> Reader:
    return Reader(samples)


def letters_of(text: str) -> str:
    """The text with any run of characters that are no letters as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text).split())


def spread(text: str, size: int) -> str:
    """The text if it has at most ``size`` letters, or so many from all over it, in pieces."""
    if len(text) <= size:
        return text
    pieces = max(1, size // (PIECE + 1))
    own = max(1, (size + 1) // pieces - 1)  # a space between
    # From the first letter to the last, at equal distances.
    room = len(text) - own
    starts = [room * i // (pieces - 1) for i in range(pieces)] if pieces > 1 else [room // 2]
    return " ".join(text[at : at + own] for at in starts)[:size]


def equal_parts(texts: list[str], size: int) -> str:
    """A sample of ``size`` letters: an equal part of each text; short ones leave theirs over."""
    left, parts = size, {}
    by_length = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    for n, i in enumerate(by_length):
        parts[i] = spread(texts[i], max(1, left // (len(texts) - n) - 1))
        left -= len(parts[i]) + 1
    return " ".join(parts[i] for i in range(len(texts)))


def learn(
    labelled: DataFrame, letters: int = SAMPLE_LETTERS, texts: int = SAMPLE_TEXTS
) -> dict[str, str]:
    """Sample text of each language of ``labelled(text, lang)``.

    The sample is bounded: about ``texts`` distinct texts a language, chosen by a hash, all
    of them if the language has no more; together ``letters``, an equal part of each text,
    from its beginning to its end. Copies of a text count once. Rows without a language or
    without a letter teach nothing.
    """
    digest = F.xxhash64("text")
    rows = labelled.select("lang", "text").where("lang IS NOT NULL AND text RLIKE r'\\p{L}'")
    distinct = rows.select("lang", digest.alias("digest")).distinct()
    counts = {r.lang: r.n for r in distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, texts / n)).otherwise(share)
    drawn = rows.where(F.shiftrightunsigned(digest, 11) < share * float(1 << 53))

    def run(batches):
        begin_task("op10")
        seen = set()
        for batch in batches:
            new = []
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                new.append(row not in seen)
                seen.add(row)
            batch = batch.filter(pa.array(new, pa.bool_()))
            found = [spread(letters_of(t), letters) for t in batch.column(2).to_pylist()]
            yield batch.set_column(2, "text", pa.array(found, pa.string()))

    # Copies go in the tasks, then those of different tasks.
    taken = drawn.select("lang", digest.alias("draw"), "text")
    taken = taken.mapInArrow(run, taken.schema).dropDuplicates(["lang", "draw"])
    found: dict[str, list[str]] = {}
    for row in sorted(taken.collect()):  # about ``texts`` rows of ``letters`` a language
        if row.text:
            found.setdefault(row.lang, []).append(row.text)
    return {lang: equal_parts(own, letters) for lang, own in found.items()}


def answers(texts: list[str | None], samples: dict[str, str]) -> tuple[list[str], list[float]]:
    """The language and the score of each text."""
    langs = sorted(samples)
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not langs:
        return names, scores
    own = reader(tuple(samples[x] for x in langs))
    coded = [own.encode(t or "") for t in texts]
    counts = own.phrases(coded)
    order = np.argsort(counts, axis=1, kind="stable")
    for i, symbols in enumerate(coded):
        if symbols.any():
            two = counts[i, order[i, :2]].tolist()
            names[i] = langs[order[i, 0]]
            scores[i] = two[1] / (two[0] + two[1]) if len(two) > 1 else 1.0
    return names, scores


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for each row of ``docs(doc_id, text)``.

    ``score`` is the runner-up's share of the two fewest phrase counts: one half is a
    tie, near 1 is certain, and it is 1 with a single language.

    * A null text, or one without a letter, is ``und`` with score 0, as is any text when
      nothing was learned. An empty table gives no rows.
    * Ties go to the language that sorts first. Repeated rows get equal answers.
    * A null doc_id is kept. Other columns are ignored, whatever their names.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        begin_task("op10")
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(low, TOGETHER)
                names, scores = answers(part.column(1).to_pylist(), samples)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column(0),
                        "lang_pred": pa.array(names, pa.string()),
                        "score": pa.array(scores, pa.float64()),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double"
    )


def keep_identified(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """The rows of ``docs`` in a learned language, with all columns. Nothing is shuffled."""
    at = docs.columns.index("text")

    def run(batches):
        begin_task("op10")
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(low, TOGETHER)
                names, _ = answers(part.column(at).to_pylist(), samples)
                yield part.filter(pa.array([name != UNKNOWN for name in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), FOLDS) == 0
    found = identify(docs, learn(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
