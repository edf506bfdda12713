"""A blocked Bloom filter, built by Spark and held whole by every task.

A key's hash picks one block of 256 bits and eight bits in it, so a test reads one block.
The filter is as large as its keys ask for, up to a bound; beyond it more keys share the
bits, so more strangers pass, but no key is ever missed.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits a key asks for; with eight of them set, about 1 stranger in 1,000 passes.
KEY_BITS = 16
BLOCK_BYTES = 32
#: The largest filter, in bytes.
MOST_BYTES = 64 << 20
WORDS = 4
#: Any odd number with mixed bits; it turns the bits that picked the block into others.
MIXER = np.uint64(0x9E3779B97F4A7C15)
#: Another one, for ``hashes_of_array``.
STIRRER = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that ``hashes_of_array`` takes at once.
STEP = 1 << 16


def hashes_of(keys: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of binary values without nulls: value ``i`` is ``offsets[i:i + 2]``."""
    if not len(values):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset :][: len(values) + 1]
    return offsets, np.frombuffer(data or b"", np.uint8)


def hashes_of_array(values: pa.Array, seeds: np.ndarray) -> np.ndarray:
    """Hashes of binary values without nulls, each with its seed (or one for all).

    Each byte and its place in the value give a number, and these are added up, so that
    no value is looked at by itself.
    """
    offsets, data = flat(values)
    sums = np.zeros(len(values), np.uint64)
    for low in range(offsets[0], offsets[-1], STEP):
        high = min(low + STEP, offsets[-1])
        first = np.searchsorted(offsets, low, side="right") - 1
        last = np.searchsorted(offsets, high, side="left")
        starts = offsets[first:last]
        cuts = np.maximum(starts, low)
        sizes = np.diff(np.append(cuts, high))
        # Places from 1, so that a zero byte counts too.
        x = (np.arange(low + 1, high + 1) - np.repeat(starts, sizes)).astype(np.uint64)
        x <<= np.uint64(8)
        x |= data[low:high]
        x *= MIXER
        x ^= x >> np.uint64(32)
        x *= STIRRER
        x ^= x >> np.uint64(29)
        some = np.flatnonzero(sizes)
        sums[first + some] += np.add.reduceat(x, cuts[some] - low)
    sums += seeds
    sums ^= sums >> np.uint64(32)
    sums *= STIRRER
    return sums ^ (sums >> np.uint64(29))


def hashes_of_parts(name: str, parts: pa.Array) -> np.ndarray:
    """Hashes of the keys ``(name, part)``."""
    return hashes_of_array(parts, hashes_of([name.encode("utf-8", "surrogatepass")]))


def _hashes_of_columns(batch: pa.RecordBatch) -> np.ndarray:
    if batch.num_columns == 1:
        return hashes_of(batch.column(0).to_pylist())
    name = batch.column(0).dictionary_encode()
    known = [x.encode("utf-8", "surrogatepass") for x in name.dictionary.to_pylist()]
    return hashes_of_array(batch.column(1), hashes_of(known)[name.indices.to_numpy()])


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and its bits in the block's words."""
    block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    mixed = hashes * MIXER
    bits = np.zeros((len(hashes), WORDS), np.uint64)
    for i in range(2 * WORDS):
        place = (mixed >> np.uint64(63 - 6 * i - 5)) & np.uint64(63)
        bits[:, i // 2] |= np.uint64(1) << place
    return block.astype(np.int64), bits


class Blocked:
    """The filter: ``words`` has a row for each block."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def may_hold(self, keys: Iterable[bytes]) -> np.ndarray:
        """Whether each key may be one of the filter's; never false for those that are."""
        return self.may_hold_hashes(hashes_of(keys))

    def may_hold_hashes(self, hashes: np.ndarray) -> np.ndarray:
        """The same by the keys' hashes."""
        block, bits = _places(hashes, len(self.words))
        return ((self.words[block] & bits) == bits).all(axis=1)


def build(keys: DataFrame, number: int, most: int = MOST_BYTES) -> Blocked:
    """The filter of ``number`` keys: a binary column, or a string and a binary one.

    Keys of one column are known by ``hashes_of``, those of two by ``hashes_of_parts``.
    """
    blocks = max(1, min(-(-number * KEY_BITS // (8 * BLOCK_BYTES)), most // BLOCK_BYTES))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            block, bits = _places(_hashes_of_columns(batch), blocks)
            order = np.argsort(block, kind="stable")
            block, bits = block[order], bits[order]
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            words = np.bitwise_or.reduceat(bits, starts, axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[starts]), *(pa.array(words[:, i].copy()) for i in range(WORDS))],
                ["block", *(f"w{i}" for i in range(WORDS))],
            )

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(WORDS))
    parts = keys.mapInArrow(run, schema).groupBy("block")
    # One row a block, so at most ``most`` bytes and the blocks' numbers.
    found = parts.agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]).toArrow()
    words = np.zeros((blocks, WORDS), np.uint64)
    at = found["block"].to_numpy()
    for i in range(WORDS):
        words[at, i] = found[f"w{i}"].to_numpy().view(np.uint64)
    return Blocked(words)
