"""An n-gram trie of three levels in Elias-Fano coding, and its file.

Level one holds the first words, level two the second words of each first word, level three the third words of each pair.
Words of a level ascend within the range of their context, and are stored plus the last value of the range
before, so that a whole level is monotone and one Elias-Fano sequence; a word is found by bisection in its
context's range, relative to the value before it.  Ranges are given by monotone pointers, Elias-Fano coded as well.  Beside
level two stand the quantised probabilities of the second word after the first and the weights that a pair leaves to
shorter contexts; beside level three the quantised probabilities of the third word after the pair.

A file is MAGIC, the number of arrays, (type, length) of each, then the arrays, each at a multiple of eight bytes.  Opened, its arrays are views
of the mapped file (of a buffer, where the file system can't map).
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.fs

MAGIC = b"QUIRETRI"
#: Codes of a level are 0 to MOST; ABSENT stands for none.
MOST, ABSENT = 254, 255
ONE = np.uint64(1)
#: Each byte's 1, each byte's highest bit.
LOWS, HIGHS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Of each byte the places of its set bits.
SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.uint64)


class Quantiser:
    """Probabilities of a level as codes of one byte: a probability x is ceil(-log10(x) / step), so no coded one is above its own."""

    def __init__(self, step: float):
        self.step = step
        self.values = np.append(10.0 ** (-np.arange(ABSENT) * step), 0.0)  # ABSENT is nought

    @classmethod
    def over(cls, x: np.ndarray) -> Quantiser:
        """The finest steps that reach the least of x."""
        return cls(max(1e-6, float(-np.log10(x.min())) / MOST) if len(x) else 1.0)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(np.ceil(-np.log10(x) / self.step - 1e-9), MOST).astype(np.uint8)


def select_in_words(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the set bit number rank (from 0) of each word: its byte by prefix sums of all eight bytes' bits, its place in the byte by a table."""
    rank = rank.astype(np.uint64)
    half = words - ((words >> ONE) & np.uint64(0x5555555555555555))
    half = (half & np.uint64(0x3333333333333333)) + ((half >> np.uint64(2)) & np.uint64(0x3333333333333333))
    prefix = ((half + (half >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * LOWS
    byte = np.bitwise_count(((rank * LOWS | HIGHS) - prefix) & HIGHS).astype(np.uint64) * np.uint64(8)  # those whose sum is rank at most
    before = ((prefix << np.uint64(8)) >> byte) & np.uint64(0xFF)
    return byte + SELECT[((words >> byte) & np.uint64(0xFF)).astype(np.int64), (rank - before).astype(np.int64)]


class EliasFano:
    """A monotone sequence: low bits packed side by side, high bits in unary with a directory of ones."""

    def __init__(self, size: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.size, self.bits, self.low, self.high, self.ones = size, bits, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (last // max(1, n)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            part, shift = values & np.uint64((1 << bits) - 1), at & np.uint64(63)
            word = (at >> np.uint64(6)).astype(np.int64)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros((int(place[-1]) if n else 0) // 64 + 1, np.uint64)
        np.bitwise_or.at(high, (place >> np.uint64(6)).astype(np.int64), ONE << (place & np.uint64(63)))
        return cls(n, bits, low, high, np.append(0, np.cumsum(np.bitwise_count(high), dtype=np.int64)).astype(np.uint32))

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        rank = i - self.ones[word]
        place = np.uint64(64) * word.astype(np.uint64) + select_in_words(self.high[word], rank)
        value = (place - i.astype(np.uint64)) << np.uint64(self.bits)
        if self.bits:
            at = i.astype(np.uint64) * np.uint64(self.bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            part = self.low[word] >> shift
            part |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
            value |= part & np.uint64((1 << self.bits) - 1)
        return value

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.size, self.bits], np.uint64), self.low, self.high, self.ones]

    @classmethod
    def from_arrays(cls, head: np.ndarray, *rest: np.ndarray) -> EliasFano:
        return cls(int(head[0]), int(head[1]), *rest)

    def find(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each word in the range [begin, end) of its context, or -1."""
        at = np.full(len(words), -1, np.int64)
        live = np.flatnonzero(begin < end)
        if not len(live):
            return at
        low, high = begin[live].copy(), end[live].copy()
        before = np.zeros(len(live), np.uint64)
        later = low > 0
        before[later] = self.get(low[later] - 1)
        sought = words[live].astype(np.uint64) + before
        while len(open_ := np.flatnonzero(high - low > 1)):  # one place is left to the comparison below
            mid = (low[open_] + high[open_]) >> 1
            over = self.get(mid) > sought[open_]
            high[open_[over]] = mid[over]
            low[open_[~over]] = mid[~over]
        hit = np.flatnonzero(self.get(low) == sought)
        at[live[hit]] = low[hit]
        return at


def relative(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Words of ranges that start at ``begin``, plus the last value of the range before."""
    last = np.append(begin[1:], len(words)) - 1
    base = np.cumsum(words[last].astype(np.uint64)) - words[last] if len(begin) else np.zeros(0, np.uint64)
    return words.astype(np.uint64) + np.repeat(base, np.diff(np.append(begin, len(words))))


class NGramTrie:
    """The three levels; ``chance2`` and ``left`` stand beside level two, ``chance3`` beside level three, as codes in ``steps``."""

    def __init__(self, first: EliasFano, to_second: EliasFano, second: EliasFano, to_third: EliasFano, third: EliasFano, steps: np.ndarray, chance2: np.ndarray, left: np.ndarray, chance3: np.ndarray):
        self.sequences = (first, to_second, second, to_third, third)
        self.steps, self.chance2, self.left, self.chance3 = steps, chance2, left, chance3

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray, chance2: np.ndarray, left: np.ndarray, pair: np.ndarray, third: np.ndarray, chance3: np.ndarray) -> NGramTrie:
        """From sorted pairs (first, second) with their probabilities, and third words sorted by the number of their pair."""
        kinds = [Quantiser.over(x) for x in (chance2, left, chance3)]
        begin1 = np.flatnonzero(np.append(True, first[1:] != first[:-1])[: len(first)])
        begin2 = np.searchsorted(pair, np.arange(len(first) + 1))
        own = np.flatnonzero(begin2[:-1] < begin2[1:])
        return cls(
            EliasFano.of(first[begin1]),
            EliasFano.of(np.append(begin1, len(first))),
            EliasFano.of(relative(second, begin1)),
            EliasFano.of(begin2),
            EliasFano.of(relative(third, begin2[:-1][own])),
            np.array([k.step for k in kinds]),
            *(k.codes(x) for k, x in zip(kinds, (chance2, left, chance3), strict=True)),
        )

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The place of each pair in level two, or -1; equal first words stand together."""
        roots, pointers, seconds = self.sequences[:3]
        begin = np.flatnonzero(np.append(True, first[1:] != first[:-1])[: len(first)])
        at = roots.find(first[begin], np.zeros(len(begin), np.int64), np.full(len(begin), roots.size, np.int64))
        size = np.diff(np.append(begin, len(first)))
        return seconds.find(second, *(np.repeat(x, size) for x in self._range(pointers, at)))

    def thirds(self, pair: np.ndarray, third: np.ndarray) -> np.ndarray:
        """The place of each third word in level three, given its pair's place, or -1."""
        return self.sequences[4].find(third, *self._range(self.sequences[3], pair))

    @staticmethod
    def _range(pointers: EliasFano, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        known = at >= 0
        begin[known] = pointers.get(at[known]).astype(np.int64)
        end[known] = pointers.get(at[known] + 1).astype(np.int64)
        return begin, end

    def write(self, fs: pa.fs.FileSystem, path: str) -> None:
        arrays = [a for s in self.sequences for a in s.arrays()] + [self.steps, self.chance2, self.left, self.chance3]
        head = MAGIC + struct.pack("<Q", len(arrays)) + b"".join(struct.pack("<8sQ", a.dtype.str.encode(), len(a)) for a in arrays)
        with fs.open_output_stream(path) as out:
            out.write(head)
            for a in arrays:
                out.write(a.tobytes() + bytes(-a.nbytes % 8))

    @classmethod
    def open(cls, fs: pa.fs.FileSystem, path: str) -> NGramTrie:
        data = pa.memory_map(path).read_buffer() if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path).read_buffer()
        if data[:8].to_pybytes() != MAGIC:
            raise ValueError(f"not a trie: {path}")
        (count,) = struct.unpack("<Q", data[8:16])
        at, arrays = 16 + 16 * count, []
        for k in range(count):
            kind, size = struct.unpack("<8sQ", data[16 + 16 * k : 32 + 16 * k])
            dtype = np.dtype(kind.rstrip(b"\0").decode())
            arrays.append(np.frombuffer(data, dtype, size, at))
            at += -(-size * dtype.itemsize // 8) * 8
        return cls(*(EliasFano.from_arrays(*arrays[4 * k : 4 * k + 4]) for k in range(5)), *arrays[20:])
