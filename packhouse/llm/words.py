"""Words, word hashes and bounded slices of Arrow batches, shared by the operators of this package.

A word is a longest run without space, tab, line feed, vertical tab, form feed or carriage return. `bytes.split()`
cuts at exactly these six, and UTF-8 has none of them inside a longer character.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 400_000
MIX_1 = np.uint64(0x9E3779B97F4A7C15)
MIX_2 = np.uint64(0xBF58476D1CE4E5B9)
MIX_3 = np.uint64(0x94D049BB133111EB)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has about `size` bytes in column `text`, or one longer row.

    What a task holds at a time is bounded by this, whatever the number of rows in a batch.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at, ends = 0, np.cumsum(lengths, dtype=np.int64)
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(int(np.searchsorted(ends, before + size, side="right")), at + 1)
            yield batch.slice(at, stop - at)
            at = stop


def texts_of(batch: pa.RecordBatch, text: int = 1) -> list[bytes]:
    """UTF-8 of a text column; null as empty."""
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits (the splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_2
    x = (x ^ (x >> np.uint64(27))) * MIX_3
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2^64, kept for the next call."""
    global _powers
    if len(_powers[0]) <= n:
        steps = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
        for s in steps:
            s[0] = 1
        _powers = np.cumprod(steps[0]), np.cumprod(steps[1])
    return _powers


class RangeHash:
    """Hashes of any ranges of a sequence of 64-bit numbers, from one pass of prefix sums modulo 2^64."""

    def __init__(self, sequence: np.ndarray) -> None:
        n = len(sequence)
        powers, self.inverse = _base_powers(n)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(sequence * powers[:n], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64) * MIX_1)


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * MIX_1)


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of each word of each text, one text after the other, and the number of each text's words."""
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    white = _WHITE[flat]
    inside = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        inside = np.concatenate([[0], inside])
    start, end = inside[::2], inside[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    return RangeHash(_BYTES[flat])(start, end), counts


def hashes(items, n: int) -> np.ndarray:
    """XXH64, seed 42, of n byte strings."""
    return np.fromiter(map(xxhash.xxh64_intdigest, items, repeat(42)), np.uint64, n)
