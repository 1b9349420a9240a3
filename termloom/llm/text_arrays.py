"""Words of whole Arrow batches as numpy arrays: no Python object per word.

A batch of texts is one UTF-8 buffer with offsets. Word borders come from a table over the 256
byte values, and a word is represented by a 64-bit fingerprint. Two different words share one with
probability 2^-64 or so; operators whose result must not depend on that compare the words.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPAN = 1 << 20  # bytes that share one run of powers
_MASK = (1 << 64) - 1

#: Bytes of words that end at ASCII white space.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words made of ASCII letters and digits and of everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash, elementwise."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def _powers(base: np.uint64, count: int) -> np.ndarray:
    run = np.full(count, base, np.uint64)
    run[0] = 1
    return np.multiply.accumulate(run)


@dataclass
class Words:
    """Words of some texts: byte borders, and for each text the range of its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of text i: words first[i] to first[i + 1]

    def hashes(self) -> np.ndarray:
        """A fingerprint of each word."""
        out = np.empty(len(self.starts), np.uint64)
        power, inverse = (
            _powers(base, min(_SPAN, len(self.data)) + 1)
            for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        )
        i, n = 0, len(out)
        while i < n:
            low = self.starts[i]
            j = int(np.searchsorted(self.ends, low + _SPAN, "right"))
            if j <= i:  # a word longer than the span
                digest = hashlib.blake2b(self.data[low : self.ends[i]].tobytes(), digest_size=8)
                out[i] = np.uint64(int.from_bytes(digest.digest(), "little"))
                i += 1
                continue
            high = self.ends[j - 1]
            part = self.data[low:high].astype(np.uint64)
            part += np.uint64(1)
            part *= power[: high - low]
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(part, out=total[1:])
            a, b = self.starts[i:j] - low, self.ends[i:j] - low
            out[i:j] = (total[b] - total[a]) * inverse[a]
            i = j
        return mix(out)

    def text(self, low: int, high: int) -> bytes:
        """Words ``low`` to ``high``, joined by one space."""
        return b" ".join(
            self.data[a:b].tobytes()
            for a, b in zip(self.starts[low:high], self.ends[low:high], strict=True)
        )


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool) -> Words:
    """Find the words of the texts; ``kind`` tells word bytes, ``lower`` folds A-Z."""
    if lower:
        data = LOWER[data]
    inside = kind[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begin[heads], stop[tails] = inside[heads], inside[tails]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets))


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of the ``size`` values that start at each position; shorter by size - 1."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total *= np.uint64(0xD1342543DE82EF95)
        total += values[j : j + n]
    return mix(total, size)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    shift = np.repeat(np.asarray(starts, np.int64) - np.cumsum(lengths) + lengths, lengths)
    return np.arange(total, dtype=np.int64) + shift


def text_of(batch, column: str = "text"):
    """The texts of a batch; ``row.name`` is a field of the struct ``row``, which then travels alone."""
    outer, _, inner = column.partition(".")
    return batch.column(outer).field(inner) if inner else batch.column(outer)


def pieces(batch, limit: int, column: str = "text"):
    """Cut a batch into runs of whole rows with about ``limit`` bytes of text, or one longer row."""
    sizes = np.diff(text_buffer(text_of(batch, column))[1])
    edges = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        before = edges[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(edges, before + limit, "right")))
        yield batch.slice(low, high - low)
        low = high
