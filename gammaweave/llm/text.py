"""Vectorised words over Arrow text columns.

Everything here works on the UTF-8 bytes of a whole Arrow batch at once, so the cost is a few
numpy passes over the bytes and none per word in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Bytes hashed in one numpy pass; more only when one word alone is longer.
_CHUNK = 1 << 20


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Words of ASCII letters and digits and of all bytes beyond ASCII; A-Z must be lower-cased before.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Words of letters only (bytes beyond ASCII count as letters).
LETTERS = _table(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)
#: Words between blanks.
NONBLANK = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def inverse(odd: np.uint64) -> np.uint64:
    """Of an odd number, modulo 2**64."""
    x = int(odd)
    for _ in range(6):
        x = x * (2 - int(odd) * x) % (1 << 64)
    return np.uint64(x)


class _Powers:
    """Powers of the hash's base and of its inverse, grown when needed."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            base = np.full(n, _MUL, np.uint64)
            back = np.full(n, inverse(_MUL), np.uint64)
            base[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(base), np.multiply.accumulate(back)
        return self.up, self.down


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(33))
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _MUL
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Words:
    """Words of a batch, in order: byte ranges in buf, the row of each, and the row's first word."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray  # one more than rows

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self), np.uint64)
        a = 0
        while a < len(self):
            lo = int(self.starts[a])
            b = max(a + 1, int(np.searchsorted(self.ends, lo + _CHUNK, "right")))
            n = int(self.ends[b - 1]) - lo
            up, down = _POWERS.get(n + 1)
            total = np.zeros(n + 1, np.uint64)
            x = self.buf[lo : lo + n].astype(np.uint64)
            x += np.uint64(1)
            x *= up[:n]
            np.cumsum(x, out=total[1:])
            s, e = self.starts[a:b] - lo, self.ends[a:b] - lo
            h = total[e]
            h -= total[s]
            h *= down[s]
            h += (e - s).astype(np.uint64) * _MIX
            out[a:b] = mix(h)
            a = b
        return out

    def text(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def buffers(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the rows' offsets in them; a null is an empty text."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    raw = raw.to_pybytes()[int(offsets[0]) : int(offsets[-1])] if raw is not None and len(column) else b""
    if lower:
        raw = raw.translate(_LOWER)
    return np.frombuffer(raw, np.uint8), offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def words(column: pa.Array, table: np.ndarray, lower: bool = True) -> Words:
    """The maximal runs of the table's bytes, in each row of an Arrow string column."""
    buf, offsets = buffers(column, lower)
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = table[buf]
    start = inside[:-1].copy()
    start[1:] &= ~inside[:-2]
    end = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offsets).astype(np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return Words(buf, starts, ends, row, first)


def pieces(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Slices of a batch whose texts have about so many bytes at most; a longer text is alone in one."""
    sizes = pc.binary_length(batch.column(column).cast(pa.large_string())).fill_null(0)
    total = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))])
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def lean(run: Callable) -> Callable:
    """The same function over batches, which at its end gives the memory it has freed back to the system. A worker that waits for its next task would keep it."""

    def done(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return done
