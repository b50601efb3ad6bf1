"""Periodic runs of words: maximal stretches that repeat one period, found behind a mask of repeated k-grams.

A run is a stretch of consecutive words with smallest period q, of at least max(min_words, min_periods * q) words, that
no neighbouring word extends keeping the period.

1. Masking.  In a run of L words every word stands in a k-gram that the document holds twice if L >= 2q + k - 1.  The
   least overlap of a run with itself shifted by its period, over all periods, gives the largest such k (``gram_words``).
   Words outside all k-grams that their document repeats therefore join no run.  k-grams are compared by 64-bit hashes
   of all documents of a block at once; a collision only leaves a word unmasked.
2. Main-Lorentz on the surviving segments, laid end to end with separators that equal nothing.  Centres halve the array
   level by level; a run is met at the one centre of the highest level inside it, with its period to the right
   or to the left of the centre, and reaches as far as the common extensions of both positions.  Extensions come from
   prefix hashes by bisection for all centres and periods of a level together; the runs kept are then measured
   again word by word, so a wrong run needs no trust in hashes (a run could only hide behind two stretches of equal 64-bit sums).

A document is one row; a block of documents is at most BLOCK_WORDS words, or one longer document.  Nothing is shuffled.
Null and empty texts have no words and no runs.  Repeated rows and ids are treated alike, each for itself; null ids stay
null.  Runs tie by start, then period.  Extra columns are left alone.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import Rows, id_and_text, pairs

MIN_WORDS, MIN_PERIODS = 6, 4
BLOCK_WORDS = 500_000
#: Pairs of positions that are compared at once.
PAIRS = 2_000_000


def gram_words(min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> int:
    """The k of the mask: 1 + the least of L - 2q over the shortest run L of each period q.

    L - 2q falls while L is min_words and doesn't fall afterwards, so the periods up to the first of min_periods * q >= min_words are enough."""
    periods = range(1, -(-min_words // min_periods) + 1)
    return 1 + min(max(min_words, min_periods * q) - 2 * q for q in periods)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def repeated_grams(words: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """For each position whether its word stands in a k-gram that its document holds at least twice."""
    n = len(words) - k + 1
    covered = np.zeros(len(words) + 1, np.int32)
    if n > 0:
        gram = scramble(doc[:n])
        for j in range(k):
            gram = scramble(gram ^ scramble(words[j : j + n]))
        gram = gram[inside := doc[:n] == doc[k - 1 :]]
        at = np.flatnonzero(inside)
        order = np.argsort(gram, kind="stable")
        same = gram[order[1:]] == gram[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[:-1] |= same
        twice[1:] |= same
        at = at[order[twice]]
        covered[at] += 1
        covered[at + k] -= 1
    return np.cumsum(covered[:-1]) > 0


class PrefixHashes:
    """Equality of stretches of one array, by polynomial prefix sums modulo 2^64; equal stretches always compare equal."""

    BASE = 0x2545F4914F6CDD1D

    def __init__(self, words: np.ndarray):
        powers = np.full(len(words) + 1, self.BASE, np.uint64)
        powers[0] = 1
        self.power = np.multiply.accumulate(powers)
        self.sum = np.append(np.uint64(0), np.cumsum(scramble(words) * self.power[: len(words)], dtype=np.uint64))

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``size`` words from a and from b > a are equal."""
        return (self.sum[a + size] - self.sum[a]) * self.power[b - a] == self.sum[b + size] - self.sum[b]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The longest common extension, of ``most`` words at most, from a and b on; with ``back``, of the words before a and b."""
        low, high = np.zeros_like(most), most.copy()
        for _ in range(int(most.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.equal(a - mid, b - mid, mid) if back else self.equal(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low


def extended(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """(start, end) of the stretch around ``at`` where words ``period`` apart are identical, compared word by word in growing steps."""

    def reach(a: int, step: int) -> int:
        done, size = 0, 64
        while True:
            part = [a + step * j for j in (done, done + size)]
            x, y = (words[slice(*part)], words[part[0] + period : part[1] + period]) if step > 0 else (words[max(0, part[1] + 1) : part[0] + 1][::-1], words[max(0, part[1] + 1) + period : part[0] + period + 1][::-1])
            n = min(len(x), len(y))
            other = np.flatnonzero(x[:n] != y[:n])
            if len(other):
                return done + int(other[0])
            if n < size:
                return done + n
            done, size = done + size, size * 2

    forth = reach(at, 1)
    back = reach(at - 1, -1) if at else 0
    return at - back, at + period + forth


def find_runs(words: np.ndarray, begin: np.ndarray, end: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """(start, length, period) of the runs of the segments [begin, end) of words, which must not touch in the sense that no run spans two."""
    size = end - begin
    keep = size >= min_words
    begin, size = begin[keep], size[keep]
    if not len(begin):
        return np.zeros((0, 3), np.int64)
    place = np.cumsum(size + 1) - size - 1  # of each segment in the joint array; a separator stands after each
    n = int(size.sum()) + len(size)
    source = np.repeat(begin - place, size + 1) + np.arange(n)
    joint = words[np.minimum(source, len(words) - 1)].astype(np.int64) + 1
    separators = place + size
    joint[separators] = -np.arange(1, len(size) + 1)
    hashes, segment = PrefixHashes(joint), np.repeat(np.arange(len(size)), size + 1)
    found: set[tuple[int, int, int]] = set()
    half = 1
    while half < n:
        centre = np.arange(half, n, 2 * half)
        centre = centre[segment[centre] == segment[centre - 1]]
        left, right = place[segment[centre]], separators[segment[centre]]
        # a run inside [centre - half, centre + half) has a period of at most 2 * half / min_periods
        most = np.minimum((right - left) // min_periods, 2 * half // min_periods)
        cells = np.cumsum(most)
        first = 0
        while first < len(centre):
            last = max(first + 1, int(np.searchsorted(cells, (cells[first - 1] if first else 0) + PAIRS, "right")))
            part = slice(first, last)
            _level(hashes, joint, half, centre[part], left[part], right[part], most[part], min_words, min_periods, found)
            first = last
        half *= 2
    shortest: dict[tuple[int, int], int] = {}
    for start, stop, period in found:
        shortest[start, stop] = min(period, shortest.get((start, stop), period))
    runs = sorted((int(source[start]), stop - start, period) for (start, stop), period in shortest.items())
    return np.array(runs, np.int64).reshape(-1, 3)


def _level(hashes: PrefixHashes, joint: np.ndarray, half: int, centre, left, right, most, min_words: int, min_periods: int, found: set) -> None:
    """Adds the runs inside [centre - half, centre + half) that hold the centre, by the period on either side of it.

    A run that reaches farther holds a centre of a higher level, and is met there."""
    c = np.repeat(centre, most)
    q = np.arange(len(c)) - np.repeat(np.cumsum(most) - most, most) + 1
    lo, hi = np.repeat(left, most), np.repeat(right, most)
    for side in (0, 1):  # the period after the centre: positions c and c + q; before it: c - q and c
        a = c if side == 0 else c - q
        fits = (a >= lo) & (a + q <= hi)
        x, p, low, high, mid = a[fits], q[fits], lo[fits], hi[fits], c[fits]
        # words q apart agree on length - q words around the pair, so on half of them on one side at least
        need = (np.maximum(min_words, min_periods * p) - p + 1) // 2
        forth, back = x + p + need <= high, x - need >= low
        likely = np.zeros(len(x), bool)
        likely[forth] = hashes.equal(x[forth], (x + p)[forth], need[forth])
        back &= ~likely
        likely[back] = hashes.equal((x - need)[back], (x + p - need)[back], need[back])
        x, p, mid = x[likely], p[likely], mid[likely]
        low, high = np.maximum(low[likely], mid - half - 1), np.minimum(high[likely], mid + half + 1)
        start = x - hashes.common(x, x + p, x - low, True)
        stop = x + p + hashes.common(x, x + p, high - x - p, False)
        own = (stop - start >= np.maximum(min_words, min_periods * p)) & (mid - half <= start) & (start < mid) & (mid < stop) & (stop <= mid + half)
        x, p, start, stop = x[own], p[own], start[own], stop[own]
        order = np.lexsort((p, stop, start))  # of the multiples of a period only the period itself
        x, p, start, stop = x[order], p[order], start[order], stop[order]
        first = np.flatnonzero(np.append(True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))[: len(x)])
        for at, period in zip(x[first].tolist(), p[first].tolist(), strict=True):
            s, e = extended(joint, at, period)
            if e - s >= max(min_words, min_periods * period):
                found.add((s, e, period))


def planted(doc_id: int, words: list) -> list:
    """The words with the repetition that the query plants in a tenth of the documents."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def document_runs(lists: list[list], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[np.ndarray]:
    """The runs of each list of words, as rows (start, length, period) by start, then period."""
    ids = defaultdict(count().__next__)
    size = np.array([len(x) for x in lists], np.int64)
    words = np.fromiter((ids[w] for x in lists for w in x), np.int64, int(size.sum()))
    doc = np.repeat(np.arange(len(lists)), size)
    kept = repeated_grams(words, doc, gram_words(min_words, min_periods))
    edge = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    begin = np.flatnonzero(kept & (edge | ~np.append(False, kept[:-1])[: len(kept)]))
    end = np.flatnonzero(kept & np.append(edge[1:] | ~kept[1:], True)[: len(kept)]) + 1
    runs = find_runs(words, begin, end, min_words, min_periods)
    first = np.cumsum(size) - size
    owner = doc[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    runs[:, 0] -= first[owner]
    cut = np.searchsorted(owner, np.arange(len(lists) + 1))
    return [runs[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words without those that a run contains after its first period."""
    if not len(runs):
        return words
    drop = np.zeros(len(words) + 1, np.int32)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


def best_run(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest length / period, exactly; ties to the smallest start, then period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def detect_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, plant=None) -> DataFrame:
    """Per row: doc_id long, runs array of (start, length, period), collapsed binary: the words left, joined by one space.

    ``plant`` (doc_id, words) -> words changes the words first; rows without an id are left as they are."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("runs", kind), ("collapsed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, keys, lists, held = Rows(schema), [], [], 0

        def flush():
            for key, words, runs in zip(keys, lists, document_runs(lists, min_words, min_periods), strict=True):
                text = b" ".join(collapsed(words, runs))
                rows = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()]
                yield from out.add((key, rows, text), len(text) + 100 * len(rows) + 64)

        for key, text in pairs(batches):
            words = text.encode("utf-8", "surrogatepass").split()  # of bytes: splits at ASCII white space only
            words = plant(key, words) if plant and key is not None else words
            keys.append(key)
            lists.append(words)
            held += len(words)
            if held >= BLOCK_WORDS or len(keys) >= 20_000:
                yield from flush()
                keys, lists, held = [], [], 0
        yield from flush()
        yield out.flush()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")


def digests(runs: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Of every document the planted and native runs: their number, the one of greatest exponent, digests of all and of what is left."""
    found = detect_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=planted)
    best = """reduce(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, r) ->
        case when b is null or cast(r.length as decimal(19)) * b.period > cast(b.length as decimal(19)) * r.period then r else b end)"""
    return found.selectExpr("doc_id", "cast(size(runs) as bigint) n_runs", f"{best} best", "runs", "collapsed").selectExpr(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        "(1000 * best.length) div best.period exponent_milli",
        "sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), ''), 256) runs_sha256",
        "sha2(collapsed, 256) collapsed_sha256",
    )
