"""Approximate nearest neighbours by inner product: probed lists, scanned adaptively by dimension.

1. Vectors get one more dimension that makes all norms equal, so the largest inner product is the
   least distance, and are rotated by a fixed random orthogonal matrix: any first d coordinates are
   then a fair sample of a distance.
2. Lists: spherical k-means on a bounded sample (FIT_ROWS).  How many lists a query probes is the least
   number that reaches TARGET_RECALL within that sample, by brute force; neighbours lie closer in the
   whole table than in a sample of it, so the share errs on the safe side.  Every row is indexed.
3. Lists are dealt into cells of about CELL_ROWS rows, large lists by parts of them, so a list that
   holds a third of all rows is many cells.  Queries of near lists go together, packed, once to each cell with a
   list that one of them probes, and are compared there with the lists that they probe.
   Of equal vectors the k + 1 smallest ids are candidates; ties keep all others out of any answer.
4. In a list, partial distances grow by column blocks; a candidate is abandoned as soon as its scaled
   partial distance fails the test (1 + EPSILON / sqrt(d)) against the query's bound, which starts as
   its (k + MARGIN)-th distance to the sample's rows in its lists.  While over a DENSE-th of a list is left, a block
   of columns is one product of matrices; then only what is left is followed.  Survivors are scored in double
   precision on the original vectors.

Vectors that are null, zero, hold nulls or non-finite numbers, or have another length than most, take
no part, nor do null ids.  Vectors of any finite size are compared scaled by one power of two; a score beyond the doubles' range is
what double arithmetic makes of it.  Of rows with one id the least vector counts.
Ties go to the smaller id.  Repeated rows count once.  Extra columns are left alone.  A table without usable
vectors gives no rows.

How many lists a recall takes depends on the vectors: clustered ones need few, but of vectors spread evenly over a
sphere of 64 dimensions most, whatever the index, so then the work grows with queries times rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import hash_sample, written
from quire.llm.segment import spread

FIT_ROWS, FIT_QUERIES = 8_192, 256
MOST_LISTS = 4_096
CELL_ROWS = 4_096
TARGET_RECALL = 0.95
BLOCK, EPSILON = 16, 2.1
#: A bound is that of the k + MARGIN-th: tests that go wrong still leave k.
MARGIN = 12
SCAN_QUERIES = 256
DENSE = 10


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id long, vector array<double>), one row an id."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    plain = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("vector")).filter("vec_id is not null and vector is not null")
    fine = plain.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    return fine.groupBy("vec_id").agg(F.min("vector").alias("vector"))


class Index:
    """What tasks need to know: the rotation, the lists' centres, and the sample for first bounds."""

    def __init__(self, sample: np.ndarray, largest: float, total: int, k: int, target: float, seed: int = 11, scale: float = 1.0):
        """largest: the greatest norm of what vectors times ``scale``, a power of two, are."""
        rng = np.random.default_rng(seed)
        self.k, self.scale, self.largest = k, scale, largest
        n, d = sample.shape
        self.rotation = np.linalg.qr(rng.standard_normal((d + 1, d + 1)))[0]
        self.sample = sample
        self.rotated = self.rotate(sample, False)
        lists = int(min(MOST_LISTS, max(1, np.sqrt(total)), max(1, n // 4)))
        self.centres = self._means(lists, rng)
        self.own = self._nearest(self.rotated, self.centres)
        self.probes = self._calibrate(target)

    def rotate(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x * self.scale
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.largest**2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, extra]) @ self.rotation

    def _means(self, lists: int, rng) -> np.ndarray:
        x = self.rotated
        centres = x[rng.choice(len(x), lists, replace=False)].copy()
        for _ in range(8):
            own = self._nearest(x, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            held = np.bincount(own, minlength=lists)
            centres[held > 0] = sums[held > 0] / held[held > 0, None]
        return centres

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(self.rotate(x, False), self.centres)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists of each query, nearest first; q is rotated."""
        return np.argsort((self.centres * self.centres).sum(axis=1) - 2 * q @ self.centres.T, axis=1, kind="stable")

    def _calibrate(self, target: float) -> int:
        q = self.rotate(self.sample[:FIT_QUERIES], True)
        near = (self.sample[:FIT_QUERIES] * self.scale) @ (self.sample * self.scale).T
        near[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(self.k, len(self.sample) - 1)
        if k < 1:
            return len(self.centres)
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        place = np.argsort(self.order(q), axis=1)  # the place of each list in a query's order
        needed = np.sort(np.take_along_axis(place, self.own[top], axis=1).ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1

    def bounds(self, ids: np.ndarray, q: np.ndarray, order: np.ndarray, sample_ids: np.ndarray) -> np.ndarray:
        """For each query an upper bound of its k-th least squared distance in the lists that it probes, MARGIN places beyond; infinite if the sample has too few there."""
        at = self.k + MARGIN - 1
        if len(self.sample) <= at:
            return np.full(len(q), np.inf)
        d = (q * q).sum(axis=1)[:, None] + (self.rotated * self.rotated).sum(axis=1) - 2 * q @ self.rotated.T
        d[(ids[:, None] == sample_ids) | (np.argsort(order, axis=1)[:, self.own] >= self.probes)] = np.inf
        return np.partition(d, at, axis=1)[:, at]


def scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) numbers that no test abandons, over column blocks of the rotated vectors (single precision).

    Vectors come scaled, with a greatest component from 1/2 to 1, so the slack is one of their size."""
    d = x.shape[1]
    slack = 1e-4 * (1 + np.where(np.isfinite(bound), bound, 0))

    def limits(done: int) -> np.ndarray:
        factor = (1 + EPSILON / np.sqrt(done)) ** 2 if done < d else 1.0
        return ((factor * bound + slack) * (done / d)).astype(np.float32)

    partial, alive, done = 0, True, 0
    while done < d:
        a, b = q[:, done : done + BLOCK], x[:, done : done + BLOCK]
        partial = partial + ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T)
        done = min(done + BLOCK, d)
        alive = (partial <= limits(done)[:, None]) & alive
        if np.count_nonzero(alive) * DENSE <= alive.size:
            break
    i, j = np.nonzero(alive)
    partial = partial[i, j]
    while done < d and len(i):
        stop = min(done + BLOCK, d)
        gap = q[i, done:stop] - x[j, done:stop]
        partial = partial + (gap * gap).sum(axis=1)
        done = stop
        near = partial <= limits(done)[i]
        i, j, partial = i[near], j[near], partial[near]
    return i, j


def _cells(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """list -> (its first cell, cells): small lists share a cell, a large one has parts of its own."""
    cells, now, room = {}, 0, CELL_ROWS
    for key, n in sorted(counts.items()):
        if n > CELL_ROWS:
            parts = -(-n // CELL_ROWS)
            cells[key] = (now + 1, parts)
            now, room = now + 1 + parts, CELL_ROWS
            continue
        if n > room:
            now, room = now + 1, CELL_ROWS
        cells[key] = (now, 1)
        room -= n
    return cells


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, target_recall: float = TARGET_RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """is_query: a condition on vec_id.  Per query its k nearest found: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    fine = written(usable(vectors, id_col, vector_col), "vectors")
    sizes = fine.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], result)
    d, total = sizes["d"], sizes["n"]
    fine = fine.filter(F.size("vector") == d)
    scale = 2.0 ** -min(1000, max(-1000, math.frexp(sizes["most"])[1]))  # exact, and no square overflows
    largest = math.sqrt(fine.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * scale * (x * scale)))).first()[0])
    sample = hash_sample(fine, "vec_id", FIT_ROWS).collect()
    sample_ids = np.array([r["vec_id"] for r in sample], np.int64)
    index = Index(np.array([r["vector"] for r in sample]), largest, total, k, target_recall, scale=scale)

    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), d)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(index.assign(x).astype(np.int32))], names=["vec_id", "vector", "list"])

    # Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest; tasks cut them before the shuffle.
    packed = written(fine.mapInArrow(assign, "vec_id long, vector binary, list int"), "packed")
    copies = Window.partitionBy("vector").orderBy("vec_id")
    candidates = written(packed.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy"), "lists")
    counts = {r["list"]: r["n"] for r in candidates.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MOST_LISTS rows
    cells = _cells(counts)
    held_by = np.array([counts.get(i, 0) for i in range(len(index.centres))])
    first_cell, parts_of = (np.array([cells.get(i, (0, 0))[n] for i in range(len(index.centres))]) for n in (0, 1))
    number = max(first + parts for first, parts in cells.values())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates to their cell, those of a batch and cell in one row."""
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lists = (batch.column(c).to_numpy() for c in (0, 2))
            cell = first_cell[lists] + ids % parts_of[lists]
            x = _unpacked(batch.column(1), kind, d)
            rows = []
            for c in np.unique(cell).tolist():
                own = np.flatnonzero(cell == c)
                rows.append((c, False, ids[own].tobytes(), x[own].tobytes(), lists[own].astype("<i4").tobytes(), None, None))
            yield _dealt(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to every cell with a list that they probe, those of a block and cell in one row."""
        for batch in batches:
            for at in range(0, batch.num_rows, SCAN_QUERIES):
                part = batch.slice(at, SCAN_QUERIES)
                ids, x = part.column(0).to_numpy(), _unpacked(part.column(1), kind, d)
                q = index.rotate(x.astype(np.float64), True)
                order = index.order(q)
                bound = index.bounds(ids, q, order, sample_ids)
                # as many lists as it takes to hold k others, if the index's number of probes doesn't
                enough = np.maximum(index.probes, 1 + (np.cumsum(held_by[order], axis=1) < k + 1).sum(axis=1))
                row, place = np.nonzero(np.arange(order.shape[1]) < enough[:, None])
                probed = order[row, place]
                parts = parts_of[probed]
                row, probed = np.repeat(row, parts), np.repeat(probed, parts)
                cell = first_cell[probed] + spread(np.zeros(len(parts), np.int64), parts)
                by_cell = np.lexsort((row, cell))
                row, probed, cell = row[by_cell], probed[by_cell], cell[by_cell]
                rows = []
                for a, b in _runs(cell):
                    own, number_of = np.unique(row[a:b], return_inverse=True)
                    rows.append((int(cell[a]), True, ids[own].tobytes(), x[own].tobytes(), probed[a:b].astype("<i4").tobytes(), number_of.astype("<i4").tobytes(), bound[own].tobytes()))
                yield _dealt(rows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per cell its candidates come first, then its queries in blocks."""
        held, parts, ready = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                cell, query, *packed = (c[i].as_py() for c in batch.columns)
                if cell != held:
                    held, parts, ready = cell, [], None
                ids, x, lists = np.frombuffer(packed[0], np.int64), np.frombuffer(packed[1], kind).reshape(-1, d).astype(np.float64), np.frombuffer(packed[2], "<i4")
                if not query:
                    parts.append((ids, x, lists))
                    continue
                if not parts:
                    continue
                if ready is None:
                    ids_, x_, own = (np.concatenate(p) for p in zip(*parts, strict=True))
                    order = np.argsort(own, kind="stable")
                    ready = ids_[order], x_[order], index.rotate(x_[order], False).astype(np.float32), own[order]
                yield _search_cell(index, k, ids, x, lists, np.frombuffer(packed[3], "<i4"), np.frombuffer(packed[4], np.float64), *ready)

    queries = packed.filter(is_query).repartitionByRange("list", "vec_id").sortWithinPartitions("list").select("vec_id", "vector")
    dealt = candidates.mapInArrow(deal, _DEALT_DDL).unionByName(queries.mapInArrow(send, _DEALT_DDL))
    found = dealt.repartitionById(number, "cell").sortWithinPartitions("cell", "query").mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_DEALT = pa.schema([("cell", pa.int32()), ("query", pa.bool_()), *((c, pa.binary()) for c in ("ids", "vectors", "lists", "rows", "bounds"))])
_DEALT_DDL = "cell int, query boolean, ids binary, vectors binary, lists binary, rows binary, bounds binary"


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DEALT, strict=True)], schema=_DEALT)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    return list(zip(edges.tolist(), np.append(edges[1:], len(values)).tolist(), strict=True)) if len(edges) else []


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def _unpacked(column: pa.Array, kind: str, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, d)


def _search_cell(index: Index, k: int, query_ids, original, flat, row, bound, ids, x, rotated, own) -> pa.RecordBatch:
    """The k nearest of each query among its lists (flat, of the queries numbered row) in one cell."""
    q = index.rotate(original, True).astype(np.float32)
    best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in q]
    for x_list in np.unique(flat):
        a, b = np.searchsorted(own, [x_list, x_list + 1])
        rows = row[flat == x_list]
        i, j = scan(q[rows], rotated[a:b], bound[rows])
        score = (x[j + a] * original[rows[i]]).sum(axis=1)
        for s, e in _runs(i):
            best[rows[i[s]]].append((score[s:e], ids[a + j[s:e]]))
    out = []
    for query_id, found in zip(query_ids.tolist(), best, strict=True):
        score, name = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0), np.empty(0, np.int64))
        others = name != query_id
        score, name = score[others], name[others]
        top = np.lexsort((name, -score))[:k]
        out.append((score[top], name[top]))
    size = [len(s) for s, _ in out]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, size)), pa.array(np.concatenate([n for _, n in out])), pa.array(np.concatenate([s for s, _ in out]))], names=["query_id", "vec_id", "score"])


def op3_vector_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
