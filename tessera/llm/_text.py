"""Vectorised text kernels over Arrow columns, run inside executors' workers.

Texts are handled as UTF-8 bytes in chunks of a few MB, so that memory follows
the chunk (or one very long text), never the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 4 << 20
BLOCK = 1 << 20

_P = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, BLOCK + (1 << 16))
        steps = np.full(size, np.uint64(base), np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have[:n]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] for each span, by prefix sums.

    Starts ascend. The hash doesn't depend on the place, so that long arrays are
    worked on in blocks.
    """
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        low = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, low + BLOCK)))
        a, b = start[i:j] - low, end[i:j] - low
        n = int(b.max())
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((values[low : low + n].astype(np.uint64) + np.uint64(1)) * _power("p", _P, n), out=prefix[1:])
        out[i:j] = mix((prefix[b] - prefix[a]) * _power("inv", _PINV, n + 1)[a] + (b - a).astype(np.uint64))
        i = j
    return out


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows whose texts have about `size` bytes, one row at least, and these texts.

    Texts are taken from the column range by range, so that memory follows the range.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield a, b, texts(column.slice(a, b - a))
        a = b


def chunks(items: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes each; one text at least."""
    first = total = 0
    for i, x in enumerate(items):
        if total and total + len(x) > size:
            yield first, i
            first, total = i, 0
        total += len(x) + 1
    if first < len(items):
        yield first, len(items)


class Words:
    """The white-space separated words of some texts.

    `buf` holds them joined by one space (one after the last, too); `start`
    and `end` are byte places in it; `first[d]:first[d + 1]` are the words of
    text d.
    """

    def __init__(self, items: list[bytes], lower: bool = False):
        raw = np.frombuffer(b" ".join(items) + b" ", np.uint8)
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        space = SPACE[raw]
        word = ~space
        after = np.zeros(len(raw), bool)
        after[1:] = word[:-1] & space[1:]
        ends_raw = np.flatnonzero(after)
        keep = word | after
        self.buf = raw[keep]
        sep = after[keep]
        self.buf = np.where(sep, np.uint8(32), self.buf)
        self.end = np.flatnonzero(sep)
        self.start = np.empty_like(self.end)
        if len(self.end):
            self.start[0] = 0
            self.start[1:] = self.end[:-1] + 1
        limits = np.cumsum(np.fromiter((len(x) + 1 for x in items), np.int64, len(items)))
        self.first = np.concatenate([[0], np.searchsorted(ends_raw, limits, "left")])
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end)

    def text(self, a: int, b: int) -> bytes:
        """Words a..b-1 joined by one space."""
        return self.buf[self.start[a] : self.end[b - 1]].tobytes() if b > a else b""


def gather(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of buf[start:start + length] of each span."""
    total = int(length.sum())
    if not total:
        return buf[:0]
    before = np.cumsum(length) - length
    return buf[np.repeat(start - before, length) + np.arange(total)]


def release() -> None:
    """Gives a worker's freed memory back, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it only keeps more
        pass


def batches(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
