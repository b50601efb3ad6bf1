"""A minimal perfect hash over 128-bit keys, built and probed by numpy.

Levels of bit fields: at each level every key left hashes to one cell, keys alone in their cell stay
there, and the others go on to the next, smaller level.  A key's number is the rank of its cell among
all set cells, so n keys get the numbers 0 to n-1 at about four bits a key.
"""

from __future__ import annotations

import struct

import numpy as np

GAMMA = 2.0
LEVELS = 64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _cell(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(_mix(hi + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) ^ lo) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, fields: list[np.ndarray]):
        self.fields = fields
        self.rank, total = [], 0
        for f in fields:
            # set cells before each group of 64
            sums = np.add.reduceat(f, np.arange(0, len(f), 64), dtype=np.int64)
            self.rank.append(total + np.cumsum(sums) - sums)
            total += int(sums.sum())
        self.size = total

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        """hi, lo: uint64 halves of distinct keys."""
        fields = []
        for level in range(LEVELS):
            if not len(hi):
                break
            size = max(64, int(len(hi) * GAMMA))
            at = _cell(hi, lo, level, size)
            alone = np.bincount(at, minlength=size) == 1
            fields.append(alone)
            left = ~alone[at]
            hi, lo = hi[left], lo[left]
        if len(hi):
            raise ValueError("keys are not distinct")
        return cls(fields)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Each key's number; a key that was not built in gets any number, or -1."""
        out = np.full(len(hi), -1, np.int64)
        todo = np.arange(len(hi))
        for level, (field, rank) in enumerate(zip(self.fields, self.rank, strict=True)):
            if not len(todo):
                break
            at = _cell(hi[todo], lo[todo], level, len(field))
            hit = field[at]
            own, cell = todo[hit], at[hit]
            group = cell >> 6
            start = group << 6
            # cells set before this one in its group of 64
            window = np.minimum(start[:, None] + np.arange(64), len(field) - 1)
            before = (field[window] & (window < cell[:, None])).sum(axis=1)
            out[own] = rank[group] + before
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.fields)) + b"".join(struct.pack("<Q", len(f)) + np.packbits(f, bitorder="little").tobytes() for f in self.fields)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        fields, at = [], 4
        for _ in range(struct.unpack_from("<I", data)[0]):
            n = struct.unpack_from("<Q", data, at)[0]
            fields.append(np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at + 8), count=n, bitorder="little").astype(bool))
            at += 8 + (n + 7) // 8
        return cls(fields)
