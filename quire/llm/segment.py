"""Vectorised pre-tokenisation: many texts are cut into the pieces of a tokenizer's pattern at once.

A block of texts becomes one array of code points.  Every code point has a class (letter,
number, white space, other) and the pieces follow from class changes, so no regular expression
runs per word.  Each piece gets a 64-bit polynomial hash from prefix sums; a bounded cache maps
hashes to known pieces and their ids, and only pieces not seen before are encoded.  A hash only
proposes: a piece is known if its code points equal the known piece's.  Of two pieces with one
hash the later is encoded apart.

The array rules are exact for the code points in ``plain_codepoints()`` (ASCII and the Latin
blocks).  A text with any other code point is left to the caller's whole-text fallback.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

LETTER, NUMBER, SPACE, OTHER, EDGE = 0, 1, 2, 3, 4
#: Code points below this may be segmented by array rules.
PLAIN_END = 0x250
#: A block is closed at so many code points; a longer text is a block by itself.
BLOCK_CHARS = 600_000
#: Pieces that a worker keeps, and their code points; at more it starts again, so memory stays bounded.
CACHE_PIECES, CACHE_POINTS = 800_000, 12_000_000


def plain_codepoints() -> np.ndarray:
    """Mask over code points below PLAIN_END whose class and case are the same in all regex engines."""
    ok = np.zeros(PLAIN_END + 1, bool)
    ok[[9, 10, 13]] = True
    ok[32:127] = True
    ok[0xA1:PLAIN_END] = True
    ok[0x130] = False  # its lower case has two code points
    return ok


def _classes() -> np.ndarray:
    import regex

    out = np.full(PLAIN_END + 1, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = regex.compile(pattern)
        out[[c for c in range(PLAIN_END) if found.match(chr(c))]] = kind
    out[PLAIN_END] = EDGE
    return out


class Segmenter:
    """mode "gpt": contractions, words with one leading blank, white-space runs.  mode "clip": lower case, single digits, no white space."""

    def __init__(self, mode: str):
        self.mode = mode
        self.ok = plain_codepoints()
        self.classes = _classes()
        self.fold = np.arange(PLAIN_END + 1, dtype=np.uint32)
        if mode == "clip":
            for c in range(PLAIN_END):
                low = chr(c).lower()
                if len(low) == 1 and ord(low) < PLAIN_END:
                    self.fold[c] = ord(low)
                elif len(low) != 1 or low != chr(c):
                    self.ok[c] = False
        rng = np.random.default_rng(20240131)
        self.symbols = rng.integers(1, 1 << 63, PLAIN_END + 1, dtype=np.uint64)
        self.base = np.uint64(int(rng.integers(1 << 62, 1 << 63)) | 1)
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        def of(base: np.uint64) -> np.ndarray:
            x = np.full(n, base, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                return np.multiply.accumulate(x)

        self.power, self.inverse = of(self.base), of(np.uint64(pow(int(self.base), -1, 1 << 64)))

    def is_plain(self, text: str) -> bool:
        return bool(self.ok[np.minimum(codepoints(text), PLAIN_END)].all())

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """For plain texts: (code points, piece starts, piece ends, piece's text number).  Ends are exclusive."""
        joined = "￿".join(texts) + "￿"
        cp = np.minimum(codepoints(joined), PLAIN_END).astype(np.uint16 if self.mode == "gpt" else np.uint32)
        if self.mode == "clip":
            cp = self.fold[cp].astype(np.uint16)
        kind = self.classes[cp]
        n = len(cp)
        start = np.empty(n + 3, bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:n])
        start[n:] = True
        edge = np.flatnonzero(kind == EDGE)
        start[edge] = True
        start[edge + 1] = True
        if self.mode == "gpt":
            at = np.flatnonzero(start[1:n] & (kind[1:] != SPACE) & (kind[1:] != EDGE) & (kind[:-1] == SPACE)) + 1
            start[at - 1] = True
            start[at[cp[at - 1] == 32]] = False
        else:
            start[:n] |= kind == NUMBER
        quote = np.flatnonzero((cp == 39) & start[:n])
        if len(quote):
            after, later = cp[np.minimum(quote + 1, n - 1)], cp[np.minimum(quote + 2, n - 1)]
            one = np.isin(after, [ord(c) for c in "stmd"])
            two = ~one & (((after == ord("r")) | (after == ord("v"))) & (later == ord("e")) | (after == ord("l")) & (later == ord("l")))
            start[quote[one | two] + 1] = False
            start[quote[one] + 2] = True
            start[quote[two] + 3] = True
        begin = np.flatnonzero(start[:n])
        end = np.append(begin[1:], n)
        keep = kind[begin] != EDGE
        if self.mode == "clip":
            keep &= kind[begin] != SPACE
        begin, end = begin[keep], end[keep]
        return cp, begin, end, np.searchsorted(edge, begin)

    def hashes(self, cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each piece; equal code points have equal hashes wherever they stand."""
        n = len(cp)
        if n > len(self.power):
            self._powers(n + n // 4)
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.symbols[cp] * self.power[:n], out=total[1:])
            return (total[end] - total[begin]) * self.inverse[begin]


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Growing:
    """An array that grows in place."""

    def __init__(self, kind):
        self.room, self.n = np.empty(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.room):
            room = np.empty(max(n, len(self.room) * 3 // 2), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : n] = values
        self.n = n


class PieceCache:
    """Known pieces by their hash, with their code points and ids; at most CACHE_PIECES and CACHE_POINTS, plus those of one block."""

    def __init__(self, encode_pieces: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]):
        self.encode_pieces = encode_pieces
        self.clear()

    def clear(self) -> None:
        self.key, self.row = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.point_at, self.length, self.points = Growing(np.int64), Growing(np.int32), Growing(np.uint16)
        self.id_at, self.count, self.ids = Growing(np.int64), Growing(np.int32), Growing(np.uint32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The row of the known piece with each hash, or -1."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.row[at], -1)

    def encode(self, cp, begin, end, key) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, ids per piece)."""
        if not len(begin):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        length = end - begin
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        lead = np.append(True, ranked[1:] != ranked[:-1])
        number = np.empty(len(key), np.int64)
        number[order] = np.cumsum(lead) - 1
        at = order[lead]  # the first piece of each hash
        row = self.find(key[at])
        if (row < 0).any():
            if len(self.key) > CACHE_PIECES or self.points.n > CACHE_POINTS:
                self.clear()
                row[:] = -1
            new = at[row < 0]
            row[row < 0] = self.add(key[new], cp, begin[new], end[new])
        row = row[number]
        known = equal_pieces(cp, begin, length, self.points.room, self.point_at.room[row], self.length.room[row])
        count = self.count.room[row].astype(np.int64)
        if known.all():
            return self.ids.room[spread(self.id_at.room[row], count)], count
        ids, count[~known] = self.encode_pieces(*piece_bytes(cp, begin[~known], end[~known]))
        first = np.cumsum(count) - count
        out = np.empty(count.sum(), np.uint32)
        out[spread(first[known], count[known])] = self.ids.room[spread(self.id_at.room[row[known]], count[known])]
        out[spread(first[~known], count[~known])] = ids
        return out, count

    def add(self, key, cp, begin, end) -> np.ndarray:
        """Encodes and keeps pieces of new hashes, which are sorted; returns their rows."""
        ids, count = self.encode_pieces(*piece_bytes(cp, begin, end))
        rows = np.arange(self.length.n, self.length.n + len(key), dtype=np.int32)
        where = np.searchsorted(self.key, key)
        self.key, self.row = np.insert(self.key, where, key), np.insert(self.row, where, rows)
        length = end - begin
        self.point_at.extend(self.points.n + np.cumsum(length) - length)
        self.length.extend(length)
        self.points.extend(cp[spread(begin, length)])
        self.id_at.extend(self.ids.n + np.cumsum(count) - count)
        self.count.extend(count)
        self.ids.extend(ids)
        return rows


def equal_pieces(a, a_first, a_count, b, b_first, b_count) -> np.ndarray:
    """Whether each piece of a is that of b, code point by code point; no piece is empty."""
    same = a_count == b_count
    rows = np.flatnonzero(same)
    x, y, n = a_first[rows], b_first[rows], a_count[rows]
    for k in range(16):  # a column at a time, as most pieces are short
        if not len(rows):
            return same
        alike = a[x + k] == b[y + k]
        if not alike.all():
            same[rows[~alike]] = False
        go_on = np.flatnonzero(n > k + 1)
        rows, x, y, n = rows[go_on], x[go_on], y[go_on], n[go_on]
    if len(rows):
        differs = a[spread(x + 16, n - 16)] != b[spread(y + 16, n - 16)]
        same[rows] &= ~np.logical_or.reduceat(differs, np.cumsum(n - 16) - (n - 16))
    return same


def piece_bytes(cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the pieces, one after another, and bytes per piece."""
    length = end - begin
    points = cp[spread(begin, length)].astype(np.uint32)
    size = np.add.reduceat(1 + (points >= 0x80), np.cumsum(length) - length)
    return np.frombuffer(points.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8), size


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... count[0] numbers, then those of first[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


class BlockEncoder:
    """Texts to ids: plain texts block by block through the cache, the others one by one through ``whole``."""

    def __init__(self, mode: str, encode_pieces, whole: Callable[[str], list[int]]):
        self.segmenter = Segmenter(mode)
        self.cache = PieceCache(encode_pieces)
        self.whole = whole

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text, in order; a null text counts as empty."""
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text or "")
            size += len(block[-1])
            if size >= BLOCK_CHARS:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, texts: list[str]) -> Iterator[np.ndarray]:
        plain = [self.segmenter.is_plain(t) for t in texts]
        chosen = [t for t, p in zip(texts, plain, strict=True) if p]
        if chosen:
            cp, begin, end, owner = self.segmenter.pieces(chosen)
            ids, count = self.cache.encode(cp, begin, end, self.segmenter.hashes(cp, begin, end))
            bounds = np.searchsorted(owner, np.arange(len(chosen) + 1))
            total = np.append(0, np.cumsum(count))[bounds]
        k = 0
        for text, p in zip(texts, plain, strict=True):
            if p:
                yield ids[total[k] : total[k + 1]]
                k += 1
            else:
                yield np.asarray(self.whole(text), np.uint32)
