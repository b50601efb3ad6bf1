"""Token ids in sorted-string-table shards, written in ascending document order and read back.

File, in this order:
  data blocks   zstd(entries, restart offsets, their number); an entry is shared and own key length,
                value length (varints), own key bytes, value.  Every RESTART-th entry has its whole key.
  sparse index  for each block its last key, offset and size
  Bloom filter  about ten bits a key, seven probes
  footer        offsets and sizes of index and filter, entries, ids, crc32 of index and filter, magic
A key is the document id as eight big-endian bytes with the sign bit flipped, so that byte order is
numeric order; a null id is the empty key and comes first.  A value is one byte for the width of an
id (2 or 4), then the ids, little-endian.

Shards are ranges of (id, hash of the text), so rows of one id are no hot group.  A task encodes and writes its
range under a name of its own attempt and reports it in a manifest; a file of a lost attempt is in no manifest.
Null texts count as empty (the end id alone); repeated ids stay apart, ordered by the hashes of their texts.  Extra
columns are left alone.  An empty table gives no shard and no rows.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Rows, id_and_text, pairs, written
from quire.llm.library_tokens import library_encoder, vocabulary
from quire.storage import shared_folder

BLOCK_BYTES = 64 << 10
RESTART = 16
MAGIC = b"QUIRESST"
FOOTER = struct.Struct("<QQQQQQI8s")
BLOOM_BITS, BLOOM_PROBES = 10, 7
DOCS_PER_SHARD = 8_000
#: At most so many manifest rows reach the driver; beyond it shards grow instead.
MAX_SHARDS = 20_000


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def pack_ids(ids: np.ndarray) -> bytes:
    narrow = not len(ids) or ids.max() < 1 << 16
    return (b"\x02" if narrow else b"\x04") + ids.astype("<u2" if narrow else "<u4").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return n, at


def _bloom_slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """keys (uint64) by BLOOM_PROBES bit numbers, by double hashing."""

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    with np.errstate(over="ignore"):
        a, b = mix(keys), mix(keys + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(BLOOM_PROBES, dtype=np.uint64)) % np.uint64(bits)


def _key_number(key: bytes) -> int:
    return int.from_bytes(key, "big")


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


class Writer:
    def __init__(self, uri: str):
        import zstandard

        fs, path = filesystem(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.compress = fs.open_output_stream(path), zstandard.ZstdCompressor(level=1).compress
        self.at = self.entries = self.ids = 0
        self.index, self.keys = [], []
        self._clear()

    def _clear(self) -> None:
        self.block, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.count = key, self.count + 1
        self.keys.append(_key_number(key))
        self.entries += 1
        self.ids += (len(value) - 1) // value[0]
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _write(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _end_block(self) -> None:
        if self.count:
            self.block += struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            self.index.append((self.last, *self._write(self.compress(bytes(self.block)))))
            self._clear()

    def close(self) -> None:
        self._end_block()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QI", o, n) for k, o, n in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        field = np.zeros(bits, bool)
        field[_bloom_slots(np.array(self.keys, np.uint64), bits).ravel()] = True
        bloom = struct.pack("<Q", bits) + np.packbits(field, bitorder="little").tobytes()
        places = [*self._write(index), *self._write(bloom)]
        self.out.write(FOOTER.pack(*places, self.entries, self.ids, zlib.crc32(bloom, zlib.crc32(index)), MAGIC))
        self.out.close()


class Table:
    """A shard opened for reading: ``get`` by binary search, or iteration in key order."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = filesystem(uri)
        self.file, self.decompress = fs.open_input_file(path), zstandard.ZstdDecompressor().decompress
        index_at, index_n, bloom_at, bloom_n, self.entries, self.ids, crc, magic = FOOTER.unpack(self._read(self.file.size() - FOOTER.size, FOOTER.size))
        index, bloom = self._read(index_at, index_n), self._read(bloom_at, bloom_n)
        if magic != MAGIC or zlib.crc32(bloom, zlib.crc32(index)) != crc:
            raise ValueError(f"{uri} is no whole table")
        self.bits, self.field = struct.unpack_from("<Q", bloom)[0], np.frombuffer(bloom, np.uint8, offset=8)
        self.last, self.place, at = [], [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.last.append(index[at : at + n])
            self.place.append(struct.unpack_from("<QI", index, at + n))
            at += n + 12

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        data = self.decompress(self._read(*self.place[i]))
        n = struct.unpack_from("<I", data, len(data) - 4)[0]
        end = len(data) - 4 * n - 4
        return data[:end], list(struct.unpack_from(f"<{n}I", data, end))

    @staticmethod
    def _entries(data: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            yield key, data[at + own : at + own + size]
            at += own + size

    def may_hold(self, doc_id: int | None) -> bool:
        slot = _bloom_slots(np.array([_key_number(key_of(doc_id))], np.uint64), self.bits)[0].astype(np.int64)
        return bool((self.field[slot >> 3] >> (slot & 7) & 1).all())

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first entry of a document, or None."""
        key = key_of(doc_id)
        i = bisect.bisect_left(self.last, key)
        if not self.may_hold(doc_id) or i == len(self.last):
            return None
        data, restarts = self._block(i)
        at = bisect.bisect_left(restarts, key, key=lambda r: next(self._entries(data, r))[0])
        for k, value in self._entries(data, restarts[max(0, at - 1)]):
            if k >= key:
                return unpack_ids(value) if k == key else None
        return None

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.place)):
            for key, value in self._entries(self._block(i)[0], 0):
                yield id_of(key), unpack_ids(value)


def write_tables(docs: DataFrame, tokenizer_path: str, folder: str, mode: str = "clip", end_id: int = 2, docs_per_shard: int = DOCS_PER_SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards below ``folder``; returns their manifest: shard int, path string, docs long, ids long."""
    plain = id_and_text(docs, id_col, text_col).withColumn("place", F.xxhash64("text"))
    shards = max(1, min(MAX_SHARDS, -(-plain.count() // docs_per_shard)))
    manifest_schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, keys, writer = TaskContext.get(), deque(), None

        def texts() -> Iterator[str]:
            for key, text in pairs(batches):
                keys.append(key)
                yield text

        path = f"{folder}/shard-{context.partitionId():06d}-{context.taskAttemptId()}.sst"
        for ids in library_encoder(tokenizer_path, mode).encode(texts()):
            writer = writer or Writer(path)
            writer.add(key_of(keys.popleft()), pack_ids(np.append(ids, np.uint32(end_id))))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((context.partitionId(), path, writer.entries, writer.ids), manifest_schema, strict=True)], schema=manifest_schema)

    ordered = plain.repartitionByRange(shards, "doc_id", "place").sortWithinPartitions("doc_id", "place", "text").select("doc_id", "text")
    return written(ordered.mapInArrow(write, "shard int, path string, docs long, ids long"), "manifest")


def read_tables(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), ids binary (little-endian unsigned 32-bit)."""
    spark = manifest.sparkSession
    base, rows = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):  # at most MAX_SHARDS rows
        rows.append((r["path"], base))
        base += r["ids"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for path, start in pairs(batches):
            for doc_id, ids in Table(path):
                raw = ids.tobytes()
                yield from out.add((doc_id, start, raw), len(raw) + 64)
                start += len(ids)
        yield out.flush()

    files = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return files.mapInArrow(read, "doc_id long, start long, ids binary")


def op8_sorted_tables(spark, sf_dir: str) -> DataFrame:
    """Every document's ids as the files hold them."""
    manifest = write_tables(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"), shared_folder(spark, "tables"))
    return read_tables(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
