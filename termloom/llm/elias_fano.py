"""Elias-Fano coded monotone sequences and a trie of n-grams over them, for numpy arrays of queries."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class EliasFano:
    """A non-decreasing sequence: low bits packed side by side, high bits in unary."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        self.low = _pack(values & np.uint64((1 << self.low_bits) - 1), self.low_bits)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        size = (int(high[-1]) if n else 0) + n + 1
        bits = np.zeros(-(-(size + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self._index()

    def _index(self):
        ones = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=ones[1:])
        self.ones = ones
        self.zeros = 64 * np.arange(len(ones)) - ones

    @classmethod
    def view(cls, n: int, low_bits: int, low: np.ndarray, words: np.ndarray) -> "EliasFano":
        """A sequence over arrays that lie elsewhere, such as in a mapped file."""
        out = cls.__new__(cls)
        out.n, out.low_bits, out.low, out.words = n, low_bits, low, words
        out._index()
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        high = _select(self.words, self.ones, at) - at
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | _unpack(self.low, self.low_bits, at)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the elements with each high part: the ones between two zeros."""
        most = int(self.zeros[-1])
        inner = np.minimum(high, most)
        begin = np.where(inner > 0, _select(~self.words, self.zeros, np.maximum(inner - 1, 0)) + 1, 0)
        word, shift = begin >> 6, (begin & 63).astype(np.uint64)
        ahead = self.words[np.minimum(word + 1, len(self.words) - 1)]
        view = (self.words[np.minimum(word, len(self.words) - 1)] >> shift) | np.where(
            shift > 0, ahead << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0)
        )
        size = np.bitwise_count((view ^ (view + _ONE)) >> _ONE).astype(np.int64)
        long = np.flatnonzero((size >= 63 - shift.astype(np.int64)) & (inner < most))
        if len(long):  # the run may go on in the next word
            size[long] = _select(~self.words, self.zeros, inner[long]) - begin[long]
        low = np.minimum(begin - inner, self.n)
        return low, np.minimum(low + size, self.n)

    def successor(self, values: np.ndarray, begin, end) -> tuple[np.ndarray, np.ndarray]:
        """First position in ``begin..end`` whose element is at least the value, or ``end``; and
        whether that element equals it."""
        values = values.astype(np.uint64)
        low, stop = self._bucket((values >> np.uint64(self.low_bits)).astype(np.int64))
        want = values & np.uint64((1 << self.low_bits) - 1)
        same = np.zeros(len(values), bool)
        open_ = np.flatnonzero(low < stop)
        left, right, want = low[open_], stop[open_], want[open_]
        while len(open_):  # binary search among the few elements of equal high part
            middle = (left + right) >> 1
            found = _unpack(self.low, self.low_bits, middle)
            same[open_] |= found == want
            less = found < want
            left, right = np.where(less, middle + 1, left), np.where(less, right, middle)
            low[open_] = left
            more = left < right
            open_, left, right, want = open_[more], left[more], right[more], want[more]
        place = np.clip(low, begin, end)
        return place, same & (place == low) & (low < end)

    def bytes(self) -> int:
        return self.low.nbytes + self.words.nbytes


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    if not bits or not len(values):
        return np.zeros(2, np.uint64)
    out = np.zeros((len(values) * bits >> 6) + 3, np.uint64)
    at = np.arange(len(values), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    # At most 64 values begin in a word, so their parts are added place by place.
    np.bitwise_or.at(out, word, values << shift)
    over = shift + np.uint64(bits) > 64
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def _unpack(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), np.uint64)
    place = at.astype(np.int64) * bits
    word, shift = place >> 6, (place & 63).astype(np.uint64)
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return ((words[word] >> shift) | high) & np.uint64((1 << bits) - 1)


def _in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit with this rank in each word, by halving."""
    at = np.zeros(len(word), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        part = word & np.uint64((1 << half) - 1)
        ones = np.bitwise_count(part).astype(np.int64)
        up = rank >= ones
        rank = np.where(up, rank - ones, rank)
        word = np.where(up, word >> np.uint64(half), part)
        at += half * up
    return at


def _select(words, ones, rank):
    word = np.searchsorted(ones, rank, "right") - 1
    return 64 * word + _in_word(words[word], rank - ones[word])


class Level:
    """n-grams of one order: contexts with a mark each, pointers to their children, children and values.

    Children are numbers relative to their context; adding the last value of the context before
    makes the whole level one monotone sequence, and a search starts from that value. A level is
    one run of bytes, which ``load`` maps: nothing is parsed or copied.
    """

    def __init__(self, contexts: np.ndarray, children: np.ndarray, values: np.ndarray, every: np.ndarray, marks: np.ndarray):
        """The n-grams in order with their values; ``every`` context in order, also those without an
        n-gram here, with their marks."""
        heads = np.ones(len(contexts), bool)
        heads[1:] = contexts[1:] != contexts[:-1]
        first = np.flatnonzero(heads)
        last = np.append(first[1:], len(contexts)) - 1
        base = np.zeros(len(first), np.uint64)
        if len(first) > 1:
            # Each context begins one above the greatest value of the one before.
            base[1:] = np.cumsum(children[last[:-1]] + _ONE)
        sizes = np.diff(np.append(first, len(contexts)))
        self.contexts = EliasFano(every)
        self.pointers = EliasFano(np.append(np.searchsorted(contexts, every), len(contexts)).astype(np.uint64))
        self.children = EliasFano(children + np.repeat(base, sizes))
        self.values, self.marks = values, marks.astype(np.uint8)

    def dump(self) -> bytes:
        """Sizes, then the sequences, the values and the marks, filled up to whole words."""
        head, body = [], []
        for part in (self.contexts, self.pointers, self.children):
            head += [part.n, part.low_bits, len(part.low), len(part.words)]
            body += [part.low, part.words]
        head += [self.values.itemsize, len(self.values), len(self.marks)]
        out = b"".join(np.ascontiguousarray(x).tobytes() for x in (np.array(head, np.int64), *body, self.values, self.marks))
        return out + bytes(-len(out) % 8)

    @classmethod
    def load(cls, data: np.ndarray) -> "Level":
        """The level over these bytes."""
        head = data[: 15 * 8].view(np.int64).tolist()
        at = 15 * 8

        def take(count, kind):
            nonlocal at
            low, at = at, at + count * np.dtype(kind).itemsize
            return data[low:at].view(kind)

        out = cls.__new__(cls)
        parts = []
        for i in range(0, 12, 4):
            n, low_bits, low, words = head[i : i + 4]
            parts.append(EliasFano.view(n, low_bits, take(low, np.uint64), take(words, np.uint64)))
        out.contexts, out.pointers, out.children = parts
        out.values = take(head[13], f"u{head[12]}")
        out.marks = take(head[14], np.uint8)
        return out

    def find(self, contexts: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each n-gram and mark of its context, 0 where the trie has none; contexts come in order."""
        out = np.zeros(len(contexts), self.values.dtype)
        marks = np.zeros(len(contexts), np.uint8)
        n = self.contexts.n
        if not n or not len(contexts):
            return out, marks
        heads = np.ones(len(contexts), bool)
        heads[1:] = contexts[1:] != contexts[:-1]
        number = np.cumsum(heads) - 1
        at, known = self.contexts.successor(contexts[heads], 0, n)
        at = np.where(known, at, 0)
        begin = self.pointers.get(at).astype(np.int64)
        end = self.pointers.get(at + 1).astype(np.int64)
        asked = np.flatnonzero(known[number])
        number = number[asked]
        marks[asked] = self.marks[at[number]]
        if not self.children.n:
            return out, marks
        base = np.where(begin > 0, self.children.get(np.maximum(begin - 1, 0)) + _ONE, np.uint64(0))
        value = children[asked] + base[number]
        place, same = self.children.successor(value, begin[number], end[number])
        out[asked[same]] = self.values[place[same]]
        return out, marks

    def bytes(self) -> int:
        return len(self.dump())
