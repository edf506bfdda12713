"""Encoding by public tokenizers, with a bounded memo of the chunks met.

No pre-tokenizer here lets a token reach from a visible character into the white space
behind it, so a text's ids are its chunks' ids, one after the other. Chunks repeat far
more than texts do: a task encodes each chunk it meets once, until the memo is full and
starts anew.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from functools import cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa

from pagelens.llm.shared import CHUNK, kept_between_tasks

#: Entries of a generation of a memo; two are about 100 MB.
MEMO_ENTRIES = 200_000
#: The same of words without punctuation, behind a memo of chunks.
BODY_ENTRIES = 20_000


@kept_between_tasks
@cache
def library(path: str):
    """The tokenizer at ``path``: ``.json`` for tokenizers, ``.model`` for sentencepiece."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def default_path(name: str) -> str:
    return public_tokenizers.path(name)


def ids_of(path: str, text: str) -> list[int]:
    """Ids of one text as the library gives them, without added tokens."""
    if path.endswith(".model"):
        return library(path).encode(text, num_threads=1)
    return library(path).encode(text, add_special_tokens=False).ids


class Memo(dict):
    """A dict that fills itself by ``make(key)``, in two generations of ``limit`` entries.

    A full generation becomes the old one, and the one before it is dropped. What is met
    again moves on, so that frequent keys stay.
    """

    def __init__(self, make: Callable, limit: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.limit = make, limit
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: One Latin word, with at most a space before it and plain punctuation behind it. All
#: pre-tokenizers here make two pre-tokens of it, and composing characters changes nothing.
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!#-%*-/:;=?@\[-_{}~]*)")


def _byte_characters() -> dict[int, str]:
    """Byte-level tokenizers write bytes as characters: printable ones as themselves."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARACTERS = _byte_characters()


@kept_between_tasks
@cache
def _chunk_encoder(path: str) -> Callable[[str], bytes]:
    """Ids of a chunk as little-endian 32-bit numbers."""
    tokenizer = library(path)
    model = tokenizer.model
    packed = [i.to_bytes(4, "little") for i in range(max(tokenizer.get_vocab().values()) + 1)]
    lowers = tokenizer.normalizer is not None

    def word(text: str) -> bytes:
        # ASCII letters stand for themselves.
        if not (text.isascii() and text.isalpha()):
            text = text.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        return b"".join([packed[t.id] for t in model.tokenize(text)])

    words = Memo(word, BODY_ENTRIES)

    def make(chunk: str) -> bytes:
        plain = PLAIN.fullmatch(chunk)
        if not plain:
            ids = tokenizer.encode(chunk, add_special_tokens=False).ids
            return b"".join([packed[i] for i in ids])
        body, tail = plain.groups()
        if lowers:
            body = body.strip(" ").lower()
        return words[body] + words[tail] if tail else words[body]

    return make


@kept_between_tasks
@cache
def _chunk_memo(path: str) -> Memo:
    return Memo(_chunk_encoder(path))


#: Control characters that Python counts as white space and Unicode does not.
SEPARATORS = re.compile("[\x1c-\x1f]")


def packed_ids(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian 32-bit numbers (``.json`` only)."""
    memo = _chunk_memo(path)
    lowers = library(path).normalizer is not None
    added = [t.content for t in library(path).get_added_tokens_decoder().values()]

    def encode(text: str) -> bytes:
        if lowers and not SEPARATORS.search(text):
            # White space is dropped and case ignored, so fewer kinds of chunks will do.
            # Beyond Latin-1, lowering a text is not the same as lowering its characters;
            # added tokens are found before case is dropped.
            if text.isascii() or max(text) < "\u0100":
                low = text.lower()
                text = text if any(t in low for t in added) else low
            return b"".join(map(memo.__getitem__, text.split()))
        return b"".join(map(memo.__getitem__, CHUNK.findall(text)))

    return encode


#: White space of ASCII as a space, all other bytes as they are.
SPACED = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def word_codes(texts: list[bytes], table: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of texts, each with a space behind it, as codes; and the texts they are in.

    ``table`` says what each byte becomes; words are what stands between spaces then.
    """
    data = np.frombuffer(b" ".join(texts).translate(table) + b" ", np.uint8)
    inside = data != 32
    starts, ends = inside.copy(), ~inside
    starts[1:] &= ~inside[:-1]
    ends[0], ends[1:] = False, ends[1:] & inside[:-1]
    # Of the spaces, the one behind a word stays.
    packed = data[inside | ends]
    starts = np.flatnonzero(starts)
    offsets = np.append(0, np.cumsum(np.flatnonzero(ends) + 1 - starts))
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]
    )
    borders = np.cumsum([len(t) + 1 for t in texts])
    return words.dictionary_encode(), np.searchsorted(borders, starts, side="right")


@kept_between_tasks
@cache
def _word_memo(path: str) -> Memo:
    """By a word in UTF-8 and the space behind it."""
    make = _chunk_encoder(path)
    return Memo(lambda word: make(word[:-1].decode()))


def packed_ids_of_many(path: str) -> Callable[[list[str]], list[bytes]]:
    """``packed_ids`` for many texts at once: each word they share is looked up once."""
    one, memo = packed_ids(path), _word_memo(path)
    if library(path).normalizer is None:
        return lambda texts: list(map(one, texts))
    added = [t.content for t in library(path).get_added_tokens_decoder().values()]

    def lowered(text: str) -> bytes | None:
        """The text with case dropped and plain spaces; None if that would change its ids."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return None
        low = text.lower()
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return None
            low = low.replace("\x85", " ").replace("\xa0", " ")
        return None if any(t in low for t in added) else low.encode()

    def encode(texts: list[str]) -> list[bytes]:
        low = list(map(lowered, texts))
        words, owner = word_codes([t or b"" for t in low], SPACED)
        known = list(map(memo.__getitem__, words.dictionary.to_pylist()))
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = np.array([len(x) // 4 for x in known], np.int64)
        codes = words.indices.to_numpy()
        own = sizes[codes]
        ends = np.cumsum(own)
        # Each word's ids, one after the other.
        first = (np.cumsum(sizes) - sizes)[codes] - (ends - own)
        stream = flat[np.repeat(first, own) + np.arange(len(first) and ends[-1])].tobytes()
        borders = np.append(0, ends)[np.searchsorted(owner, np.arange(len(texts) + 1))] * 4
        found = [stream[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]
        return [x if t is not None else one(y) for x, t, y in zip(found, low, texts, strict=True)]

    return encode


@kept_between_tasks
@cache
def _count_memo(path: str) -> Memo:
    make = _chunk_encoder(path)
    return Memo(lambda chunk: len(make(chunk)) // 4)


def token_counts(path: str) -> Callable[[Iterable[str]], list[int]]:
    """A function from texts to their token counts."""
    if path.endswith(".model"):
        # A piece may begin with the white space before it in any number; whole texts only.
        encode = partial(library(path).encode, num_threads=1)
        return lambda texts: [len(ids) for ids in encode(list(texts))]
    memo = _count_memo(path)
    return lambda texts: [sum(map(memo.__getitem__, CHUNK.findall(t))) for t in texts]
