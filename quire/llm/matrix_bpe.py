"""Byte-pair merges for many pieces at once, as matrix rounds.

Pieces are bucketed by length and stand as rows of a padded matrix of symbol ids, beside a matrix of
the ranks of neighbouring pairs.  In a round every row merges its leftmost pair of the lowest rank:
the pair's cell becomes the merged id, the cell after it is squeezed out of the row, and only the two
pairs that touch the merged cell are looked up again, in a hash table with open addressing.  Rows
without a known pair leave the matrix.  A round therefore makes the matrix one column narrower.
"""

from __future__ import annotations

import base64
import heapq
import json

import numpy as np

from quire.llm.segment import spread

PAD = np.int32(-1)
NO_RANK = np.int32(2**31 - 1)
#: Longer pieces are merged with a heap, in L log L steps, where rounds would take L * L.
LONGEST_ROW = 256
#: Cells of one matrix.
MATRIX_CELLS = 2_000_000


class PairTable:
    """(left id, right id) to (rank, merged id), by open addressing over arrays of a power of two."""

    def __init__(self, left, right, rank, merged):
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NO_RANK, np.int32)
        self.merged = np.full(1 << bits, PAD, np.int32)
        key = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        slot, todo = self._slot(key), np.arange(len(key))
        self.probes = 1
        while len(todo):
            free = self.keys[slot[todo]] == -1
            at, first = np.unique(slot[todo[free]], return_index=True)
            winners = todo[free][first]
            self.keys[at], self.rank[at], self.merged[at] = key[winners], np.asarray(rank)[winners], np.asarray(merged)[winners]
            todo = np.setdiff1d(todo, winners, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask
            self.probes += bool(len(todo))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, or -1."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, slot, -1)
        todo = np.flatnonzero((held != key) & (held != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (held != -1)]
        return out


class MatrixBPE:
    """start: symbol id of each byte; last: of each byte at a piece's end."""

    def __init__(self, start: np.ndarray, last: np.ndarray, table: PairTable):
        self.start, self.last, self.table = start.astype(np.int32), last.astype(np.int32), table

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slot = self.table.find(left, right)
        out = self.table.rank[slot]
        out[(slot < 0) | (left < 0) | (right < 0)] = NO_RANK
        return out

    def encode_pieces(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: the bytes of all pieces, one after another; length: bytes of each, at least 1.  (ids in order, ids per piece)."""
        length = np.asarray(length, np.int64)
        ends = np.cumsum(length)
        symbols = self.start[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        begins = ends - length
        count = np.ones(len(length), np.int64)
        result = symbols.copy()  # the ids of a piece stand at the head of its place
        width = np.where(length <= 16, length, (length + 7) // 8 * 8)
        for w in np.unique(width[(length > 1) & (length <= LONGEST_ROW)]).tolist():
            rows = np.flatnonzero((width == w) & (length > 1))
            for i in range(0, len(rows), max(1, MATRIX_CELLS // w)):
                self._rounds(symbols, begins, length, rows[i : i + max(1, MATRIX_CELLS // w)], w, result, count)
        for r in np.flatnonzero(length > LONGEST_ROW).tolist():
            ids = self._heap(symbols[begins[r] : ends[r]].tolist())
            result[begins[r] : begins[r] + len(ids)] = ids
            count[r] = len(ids)
        return result[spread(begins, count)].astype(np.uint32), count

    def _rounds(self, symbols, begins, length, rows, width, result, count) -> None:
        column = np.arange(width)
        inside = column < length[rows, None]
        ids = np.where(inside, symbols[np.minimum(begins[rows, None] + column, len(symbols) - 1)], PAD)
        rank = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while len(rows):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            row = np.arange(len(rows))
            live = rank[row, at] != NO_RANK if rank.shape[1] else np.zeros(len(rows), bool)
            if not live.all():
                done = ~live
                out = ids[done]
                own = (out != PAD).sum(axis=1)
                result[spread(begins[rows[done]], own)] = out[out != PAD]
                count[rows[done]] = own
                ids, rank, rows, at = ids[live], rank[live], rows[live], at[live]
                if not len(rows):
                    return
                row = np.arange(len(rows))
            n, w = ids.shape
            ids[row, at] = self.table.merged[self.table.find(ids[row, at], ids[row, at + 1])]
            keep = np.ones((n, w), bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            keep = np.ones((n, w - 1), bool)
            keep[row, at] = False
            rank = rank[keep].reshape(n, w - 2)
            if w > 2:
                has = np.flatnonzero(at > 0)
                rank[has, at[has] - 1] = self.ranks(ids[has, at[has] - 1], ids[has, at[has]])
                has = np.flatnonzero(at < w - 2)
                rank[has, at[has]] = self.ranks(ids[has, at[has]], ids[has, at[has] + 1])

    def _heap(self, ids: list[int]) -> list[int]:
        """Pairs of the lowest rank first, the leftmost among equals; stale heap entries are skipped."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def look(a: int, b: int) -> tuple[int, int]:
            if (a, b) not in known:
                slot = int(self.table.find(np.array([a]), np.array([b]))[0])
                known[a, b] = (int(self.table.rank[slot]), int(self.table.merged[slot])) if slot >= 0 else (-1, -1)
            return known[a, b]

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := look(ids[i], ids[i + 1])[0]) >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = look(a, b)[1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := look(ids[x], ids[y])[0]) >= 0:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


def from_ranks(path: str) -> tuple[MatrixBPE, list[bytes]]:
    """A rank file: each line a base64 token and its rank, which is its id.  Also the bytes of each id."""
    with open(path, "rb") as f:
        rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    one = np.array([rank[bytes([b])] for b in range(256)])
    # Any split of a token into two tokens is a pair that gives it.
    pairs = [(rank[token[:k]], rank[token[k:]], r) for token, r in rank.items() for k in range(1, len(token)) if token[:k] in rank and token[k:] in rank]
    left, right, merged = map(np.array, zip(*pairs, strict=True))
    tokens = [b""] * (max(rank.values()) + 1)
    for token, r in rank.items():
        tokens[r] = token
    return MatrixBPE(one, one, PairTable(left, right, merged, merged)), tokens


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(rest.get(b, b)) for b in range(256)]


def from_merges(path: str) -> MatrixBPE:
    """A tokenizers file with a byte-level BPE model; its suffix of a word's last symbol is kept."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
    left, right, merged = (np.array([vocab[x] for x in y]) for y in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
    symbols = _byte_symbols()
    return MatrixBPE(np.array([vocab[s] for s in symbols]), np.array([vocab[s + suffix] for s in symbols]), PairTable(left, right, np.arange(len(pairs)), merged))
