"""Words of whole texts as flat numpy arrays, one pass over the bytes of an Arrow column.

Both word classes are decided by single bytes of UTF-8: bytes from 0x80 up only occur inside non-ASCII characters.
A-Z count as a-z. A word is named by a 64-bit hash of its bytes; null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_bytes = np.arange(256)
#: [^\x20\x09-\x0D]+
NOT_SPACE = ~((_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALPHANUMERIC = (
    ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x41) & (_bytes <= 0x5A)) | ((_bytes >= 0x61) & (_bytes <= 0x7A))
    | (_bytes >= 0x80)
)

_CODES = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: codes of bytes for hashes that tell A-Z from a-z
EXACT = _CODES
_FOLDED = _CODES.copy()
_FOLDED[0x41:0x5B] = _CODES[0x61:0x7B]
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


# a cache, and no module variable: what a module variable holds would travel with every function that is sent to a task
@lru_cache(maxsize=4)
def _usual_powers(base: int) -> np.ndarray:
    return _powers(base, SLICE_BYTES + 1)


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    return _usual_powers(base)[:n] if n <= SLICE_BYTES + 1 else _powers(base, n)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most `limit` bytes of text each, or one row where a text is longer."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    row = 0
    while row < batch.num_rows:
        before = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(row, stop - row)
        row = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the n + 1 offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray  # n + 1 offsets into the words, by text

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts())


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = _FOLDED) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes give equal hashes wherever they stand."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes[data] * _power(_STEP, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_BACK, len(data) + 1)[starts])


def edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at row boundaries."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(column: pa.Array, kind: np.ndarray = NOT_SPACE) -> Words:
    data, offsets = flat(column)
    starts, ends = edges(kind[data], offsets)
    return Words(starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, offsets))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... lengths[0] of them, then the same for 1, 2, ..."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - firsts, lengths)
