"""Words of whole texts as flat numpy arrays: one array of hashes for all texts of an Arrow batch.

A batch is cut into pieces of about PIECE bytes of text, so memory follows the piece (or the longest
text), not the batch. Hashes have 64 bits and are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)

_byte = np.arange(256)
#: Word bytes of `[^\x20\x09-\x0D]+`.
SPACED = ~((_byte == 32) | ((_byte >= 9) & (_byte <= 13)))
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, once A-Z are lower-cased.
ALNUM = (_byte >= 128) | ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | ((_byte >= 65) & (_byte <= 90))
#: Lines between \n.
LINES = _byte != 10


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _STEP
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1024), _STEP, np.uint64)]), dtype=np.uint64)
    return _powers


@dataclass
class Text:
    """data: the texts' bytes; offsets: where each text begins, and the end of the last."""

    data: np.ndarray
    offsets: np.ndarray

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many of the marked bytes each text has."""
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(marks, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self, kind: np.ndarray = SPACED, lower: bool = False) -> "Words":
        return Words(self, kind, lower)


class Words:
    """hashes, starts and ends (byte places) of all words; bounds: the first word of each text, and the count."""

    def __init__(self, text: Text, kind: np.ndarray, lower: bool):
        inside = kind[text.data]
        before = np.concatenate([np.zeros(1, bool), inside[:-1]]) if len(inside) else inside.copy()
        first = text.offsets[:-1]
        before[first[first < len(inside)]] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.concatenate([inside[1:], np.zeros(1, bool)]) if len(inside) else inside.copy()
        last = text.offsets[1:] - 1
        after[last[last >= 0]] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.inside, self.text = inside, text
        self.bounds = np.searchsorted(self.starts, text.offsets)
        lengths = self.ends - self.starts
        if len(lengths):
            at = np.cumsum(lengths) - lengths
            place = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(at, lengths).astype(np.int32)
            powers = _power(int(lengths.max()) + 1)
            bytes_ = (_BYTE_LOWER if lower else _BYTE)[text.data[inside]]
            self.hashes = mix(np.add.reduceat(bytes_ * powers[place], at) + lengths.astype(np.uint64))
        else:
            self.hashes = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def word(self, i: int, lower: bool = False) -> bytes:
        w = self.text.data[self.starts[i] : self.ends[i]].tobytes()
        return w.lower() if lower else w


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive hashes."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        out *= _STEP
        out += hashes[j : j + n]
    return mix(out)


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, Text]]:
    """(first row, row after the last, text) of consecutive rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n, lo + 50_000)
        yield lo, hi, Text(data[offsets[lo] : offsets[hi]], (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64))
        lo = hi
