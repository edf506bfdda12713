"""Byte-level BPE: encoding by a queue of merge ranks, decoding by the vocabulary.

A pre-token starts as a doubly linked list of byte symbols. A priority queue holds the
ranks of adjacent pairs with a merge, leftmost first among equals. The best entry is
taken; if its symbols have changed since, it is stale and skipped, else the pair becomes
one symbol and its new neighbours are queued. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterable
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pagelens.llm.shared import CHUNK, table
from pagelens.llm.tokens import BYTE_CHARACTERS, PLAIN, Memo, default_path

# Fixed value: how byte-level BPE of this vocabulary cuts a text before merging.
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


class Codec:
    """Encoder and decoder of a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        vocabulary = stored["model"]["vocab"]
        self.alphabet = [vocabulary[BYTE_CHARACTERS[b]] for b in range(256)]
        byte_of = {c: b for b, c in BYTE_CHARACTERS.items()}
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        known = {**vocabulary, **self.special}
        self.strings = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            plain = all(c in byte_of for c in token)
            self.strings[i] = bytes(byte_of[c] for c in token) if plain else token.encode()
        # By its left id, a merge's right id and rank; by rank, the id that it makes.
        nothing: dict[int, int] = {}
        self.ranks = [nothing] * len(self.strings)
        self.made = []
        # One object for each id, however often it is in a memo.
        numbers = list(range(len(self.strings)))
        for rank, (a, b) in enumerate(stored["model"]["merges"]):
            left = vocabulary[a]
            if self.ranks[left] is nothing:
                self.ranks[left] = {}
            self.ranks[left][vocabulary[b]] = rank
            self.made.append(numbers[vocabulary[a + b]])
        longest = sorted(self.special, key=len, reverse=True)
        found = "|".join(map(regex.escape, longest))
        self.cut = regex.compile(f"({found})") if found else None
        self.decimals = [b"%d" % i for i in numbers]
        self.words = Memo(self.merge)
        self.chunks = Memo(self._chunk)
        self.spelt = Memo(self._spelt)

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        alphabet, ranks, made = self.alphabet, self.ranks, self.made
        symbols = [alphabet[b] for b in word.encode("utf-8", "surrogatepass")]
        size = len(symbols)
        if size < 2:
            return tuple(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        # An entry is a rank and, among equal ranks, a place from the left.
        queue = []
        for i in range(size - 1):
            rank = ranks[symbols[i]].get(symbols[i + 1])
            if rank is not None:
                queue.append(rank * size + i)
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            rank, i = divmod(pop(queue), size)
            own, right = symbols[i], after[i]
            if own is None or right >= size or ranks[own].get(symbols[right]) != rank:
                continue  # stale: the pair here is another by now
            symbols[i], symbols[right] = own, _ = made[rank], None
            follows = after[i] = after[right]
            if follows < size:
                before[follows] = i
                rank = ranks[own].get(symbols[follows])
                if rank is not None:
                    push(queue, rank * size + i)
            left = before[i]
            if left >= 0:
                rank = ranks[symbols[left]].get(own)
                if rank is not None:
                    push(queue, rank * size + left)
        return tuple([s for s in symbols if s is not None])

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        plain = PLAIN.fullmatch(chunk)
        if plain:
            word, mark = plain.groups()
            return self.words[word] + self.words[mark] if mark else self.words[word]
        ids: list[int] = []
        parts = self.cut.split(chunk) if self.cut else [chunk]
        for place, part in enumerate(parts):
            if place % 2:
                ids.append(self.special[part])
            else:
                for word in PRE_TOKEN.findall(part):
                    ids += self.words[word]
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of special tokens in it become those tokens."""
        ids: list[int] = []
        for found in map(self.chunks.__getitem__, CHUNK.findall(text)):
            ids += found
        return ids

    def _spelt(self, chunk: str) -> tuple[int, bytes, bytes]:
        ids = self._chunk(chunk)
        return len(ids), b",".join([self.decimals[i] for i in ids]), self.joined(ids)

    def spell(self, text: str) -> tuple[int, bytes, bytes]:
        """Number of a text's ids, the ids in decimals joined by commas, and their bytes.

        All three of a text are those of its chunks, one after the other.
        """
        found = list(map(self.spelt.__getitem__, CHUNK.findall(text)))
        if not found:
            return 0, b"", b""
        counts, decimals, strings = zip(*found, strict=True)
        return sum(counts), b",".join(decimals), b"".join(strings)

    def joined(self, ids: Iterable[int]) -> bytes:
        """The ids' vocabulary strings, one after the other."""
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 are replaced."""
        return self.joined(ids).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def transcode(
    docs: DataFrame, derive: Callable, schema: str, path: str | None = None
) -> DataFrame:
    """``doc_id`` of each row of ``docs(doc_id, text)`` and what ``derive`` makes of its text.

    ``derive(codec, texts)`` gets some texts and returns columns by name, as ``schema``
    names them. Ids that nobody asks for never leave the task.

    * A null text counts as empty and has no ids. An empty table gives no rows.
    * Very long texts are encoded whole; so is a very long word, in time n log n.
    * A null or repeated doc_id is a row like any other. Other columns are ignored.
    """
    path = path or default_path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = codec(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), **derive(own, texts)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` for each row of ``docs(doc_id, text)``, as ``transcode`` has them."""
    ids = lambda own, texts: pa.array(map(own.encode, texts), pa.list_(pa.int32()))
    return transcode(docs, lambda own, texts: {"ids": ids(own, texts)}, "ids array<int>", path)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded(doc_id, ids)`` with ``text``, the ids' text; null ids count as none."""
    path = path or default_path("byte_bpe_50k.json")
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = codec(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [own.decode(i or []) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {kind}, ids array<int>, text string"
    )


def digests(own: Codec, texts: list[str]) -> dict[str, pa.Array]:
    """Number of ids, and SHA-256 of the ids and of the text decoded from them."""
    counts, ids, decoded = [], [], []
    for text in texts:
        count, decimals, data = own.spell(text)
        counts.append(count)
        ids.append(hashlib.sha256(decimals).hexdigest())
        whole = data.decode("utf-8", "replace").encode()
        decoded.append(hashlib.sha256(whole).hexdigest())
    return {
        "n_tokens": pa.array(counts, pa.int64()),
        "ids_sha256": pa.array(ids, pa.string()),
        "decoded_sha256": pa.array(decoded, pa.string()),
    }


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return transcode(table(spark, sf_dir, "documents"), digests, schema)
