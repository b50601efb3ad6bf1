"""Best-fit packing of documents into sequences, planned on a histogram of lengths.

1. Texts become ids; each document's ids are cut into pieces of at most ``capacity`` (only the first
   may be shorter).  Pieces are written once, with their rank among equal lengths of their task.
2. Counts by (task, length) give every task's first rank of a length; counts by length, at most
   ``capacity`` rows, go to the driver.
3. The plan packs counts, not documents: lengths in falling order, each into the fullest open
   sequences that it fits.  Equal sequences stay one pattern with a count, so the plan has a few
   patterns for each length, however many documents there are.
4. A piece takes its slot by its rank within its length.

Null texts count as empty; an empty text is one piece with the end id alone.  Texts of any length are cut, none is
dropped.  Repeated rows are packed as often as they occur; null ids stay null.  Extra columns are left alone.  An
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Rows, id_and_text, pairs, written
from quire.llm.library_tokens import library_encoder, vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"


class Plan:
    """Slots of each length: ranks from ``first`` on lie in sequences from ``sequence`` on, ``each`` to a sequence, the first at ``offset``."""

    def __init__(self, slots: dict[int, list[tuple[int, int, int, int]]], sequences: int):
        self.slots = {length: np.array(rows, np.int64) for length, rows in slots.items()}
        self.sequences = sequences

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, sequence, each, offset = self.slots[length].T
        at = np.searchsorted(first, rank, side="right") - 1
        among = rank - first[at]
        return sequence[at] + among // each[at], offset[at] + among % each[at] * length


def plan_best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, lengths falling.  A pattern is ((length, times), ...); equal open sequences are kept as one entry with a count."""
    open_by_room: dict[int, list[tuple[tuple, int]]] = defaultdict(list)

    def put(pattern: tuple, room: int, n: int, length: int, times: int) -> None:
        if n:
            open_by_room[room - length * times].append(((*pattern, (length, times)), n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        # The fullest open sequence with room takes as many as fit before the next is tried.
        for room in range(length, capacity + 1):
            if not left:
                break
            entries, open_by_room[room] = open_by_room[room], []
            for pattern, n in entries:
                times = room // length
                full = min(n, left // times)
                put(pattern, room, full, length, times)
                left -= full * times
                n -= full
                if n and left:
                    put(pattern, room, 1, length, left)
                    left, n = 0, n - 1
                if n:
                    open_by_room[room].append((pattern, n))
        times = capacity // length
        put((), capacity, left // times, length, times)
        if left % times:
            put((), capacity, 1, length, left % times)
    slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequences = 0
    for entries in open_by_room.values():
        for pattern, n in entries:
            offset = 0
            for length, times in pattern:
                slots[length].append((used[length], sequences, times, offset))
                used[length] += n * times
                offset += length * times
            sequences += n
    assert used == {k: v for k, v in counts.items() if v}
    return Plan(slots, sequences)


def cut_pieces(docs: DataFrame, tokenizer_path: str, mode: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("task_rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, keys, task = Rows(schema), deque(), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)

        def texts():
            for key, text in pairs(batches):
                keys.append(key)
                yield text

        for ids in library_encoder(tokenizer_path, mode).encode(texts()):
            key = keys.popleft()
            ids = np.append(ids, end_id).astype("<u4")
            ends = [*range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for piece, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                yield from out.add((key, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, seen[b - a]))
                seen[b - a] += 1
        yield out.flush()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, mode: str = "gpt", end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(cut_pieces(docs, tokenizer_path, mode, end_id, capacity, id_col, text_col), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = plan_best_fit(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("task_rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            values, first = np.unique(length[order], return_index=True)
            for value, rows in zip(values.tolist(), np.split(order, first[1:]), strict=True):
                sequence[rows], offset[rows] = plan.place(value, rank[rows])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))
