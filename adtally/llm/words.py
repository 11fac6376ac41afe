"""Words of Arrow text columns as positions in their bytes, and hashes of words and word runs.

A word is ``[^\\x20\\x09-\\x0D]+``. The separators are single bytes in UTF-8, so words are found
in the bytes without decoding them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 512 << 10

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _BYTE_BASE)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of them at least."""
    known = _powers.get(int(base))
    if known is None or len(known[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        known = tuple(
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)])) for b in (base, inverse)
        )
        if size == CHUNK_BYTES + 1:  # tables for one very long text are not kept
            _powers[int(base)] = known
    return known


def _prefix(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    powers, inverse = _power_tables(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    return sums, inverse


@dataclass
class Words:
    """Words of some rows: byte ranges in ``data``, and for each row its first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        sums, inverse = _prefix(_BYTES[self.data], _BYTE_BASE)
        lengths = (self.ends - self.starts).astype(np.uint64)
        return mixed((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + lengths)


class Runs:
    """Hashes of runs of words, from the words' hashes."""

    def __init__(self, hashes: np.ndarray):
        self.sums, self.inverse = _prefix(hashes, _WORD_BASE)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.inverse[start])


def words(texts: pa.Array) -> Words:
    """Words of a text column; a null text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = np.concatenate([[False], ~SEPARATOR[data], [False]])  # inside[i + 1] is of byte i
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before, here = inside[:-1].copy(), inside[1:].copy()
    before[edges] = False
    starts = np.flatnonzero(here & ~before)
    here[edges] = False
    ends = np.flatnonzero(inside[:-1] & ~here)
    row = np.searchsorted(offsets, starts, "right") - 1
    return Words(data, starts, ends, row, np.searchsorted(starts, offsets))


def chunks(batch: pa.RecordBatch, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``size`` bytes of text each."""
    column = batch.column(batch.schema.get_field_index("text"))
    part = np.cumsum(_sizes(column)) // size
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for start, end in zip(bounds, bounds[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def _sizes(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.diff(offsets)
