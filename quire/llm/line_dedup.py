"""Lines that many documents share stay in one document, by probing sharded perfect-hash arrays.

A line's key is the line without white space at its ends and with A-Z lower-cased; keys of at least
``min_chars`` code points that occur in at least ``min_docs`` documents lose their lines everywhere but
in the document of the largest id.

1. Each task reduces its lines to (128-bit hash, document, rows), of at most ``min_docs`` documents a hash: the
   smallest ids and the largest, which is enough to tell whether there are so many.  A line that a third of
   all documents hold leaves a task as ``min_docs`` rows.
2. The rows go to shards by hash, several shards to a partition; how many follows from the measured size of the
   texts.  A shard builds a minimal perfect hash over its distinct line hashes and three arrays in its order:
   fingerprints, document counts (up to ``min_docs``), largest ids.
3. Documents probe: the hash of a line goes to its shard, which answers from the arrays.  Lines never
   meet lines.  The few most frequent lines (at most HOT_LINES, which follows from their threshold, a
   HOT_LINES-th of all lines) are known to every task, so no shard gets their probes.
4. Only lines that must go travel back to their documents.

Null and empty texts are one empty line.  Rows of one id are one document where documents are counted, and lose
the same lines; each row has a row in the result.  A null id counts as the smallest long.  Extra columns are left
alone.  An empty table gives no rows.  Two different keys would need the same 128-bit hash to be confused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import pairs, written
from quire.llm.perfect_hash import PerfectHash

MIN_CHARS, MIN_DOCS = 20, 3
#: Bytes of text to a shard; with lines of MIN_CHARS at least, a shard's arrays take a few tens of MB at most.
SHARD_BYTES = 16_000_000
#: Shards that a partition holds, one after another.
SHARDS_EACH = 2
HOT_LINES = 10_000
#: Distinct lines of a task that are reduced at once.
REDUCE_LINES = 400_000
NO_ID = -(1 << 63)


def split_lines(text: str | None, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[bytes | None]]:
    """The lines and the 16-byte hash of each line's key, None where the key is too short."""
    from xxhash import xxh3_128_digest

    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    digests = []
    for line in lines:
        key = line.strip().lower()  # of bytes: ASCII white space and A-Z only
        long = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars)
        digests.append(xxh3_128_digest(key) if long else None)
    return lines, digests


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def reduce_lines(hi: np.ndarray, lo: np.ndarray, doc: np.ndarray, n: np.ndarray, min_docs: int) -> tuple[np.ndarray, ...]:
    """One row for each hash and document, of the min_docs - 1 smallest documents and the largest; n keeps its sum for each hash."""
    if not len(hi):
        return hi, lo, doc, n
    order = np.lexsort((doc, lo, hi))
    hi, lo, doc, n = hi[order], lo[order], doc[order], n[order]
    line = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))
    first = np.flatnonzero(line | np.append(True, doc[1:] != doc[:-1]))
    hi, lo, doc, n, line = hi[first], lo[first], doc[first], np.add.reduceat(n, first), line[first]
    begin = np.flatnonzero(line)
    size = np.diff(np.append(begin, len(hi)))
    place = np.arange(len(hi)) - np.repeat(begin, size)
    keep = (place < min_docs - 1) | (place == np.repeat(size, size) - 1)
    total = np.add.reduceat(n, begin)
    n[:] = 0
    n[begin] = total  # on the first row of a hash
    keep[begin] = True
    return hi[keep], lo[keep], doc[keep], n[keep]


def _count_lines(min_chars: int, min_docs: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, owners = [], []

        def flush() -> pa.RecordBatch:
            hi, lo = halves(digests)
            hi, lo, doc, n = reduce_lines(hi, lo, np.array(owners, np.int64), np.ones(len(hi), np.int64), min_docs)
            digests.clear(), owners.clear()
            return pa.RecordBatch.from_arrays([pa.array((hi % np.uint64(shards)).astype(np.int32)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(doc), pa.array(n)], names=["shard", "hi", "lo", "doc_id", "n"])

        for doc_id, text in pairs(batches):
            own = {d for d in split_lines(text, min_chars)[1] if d}
            digests += own
            owners += [doc_id] * len(own)
            if len(digests) >= REDUCE_LINES:
                yield flush()
        yield flush()

    return run


INDEX = T.StructType([T.StructField("shard", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("hash", "prints", "counts", "largest", "hot")), T.StructField("lines", T.LongType())])


def _build_shards(min_docs: int):
    """Rows sorted by shard to one row of arrays for each shard."""

    def merged(parts: list) -> tuple[np.ndarray, ...]:
        hi, lo, doc, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        return reduce_lines(hi, lo, doc, n, min_docs)

    def arrays_of(shard: int, parts: list) -> pa.RecordBatch:
        hi, lo, doc, n = merged(parts)
        begin = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
        docs, largest = np.diff(np.append(begin, len(hi))), np.maximum.reduceat(doc, begin)
        hi, lo, n = hi[begin], lo[begin], n[begin]
        index = PerfectHash.build(hi, lo)
        place = index.find(hi, lo)
        arrays = [np.empty(len(hi), t) for t in ("<u4", "<u4", "<i8")]
        for array, values in zip(arrays, (lo & np.uint64(0xFFFFFFFF), docs, largest), strict=True):
            array[place] = values
        frequent = n * HOT_LINES // 50 >= n.sum()  # candidates: at most a fixed number for each shard
        hot = np.stack([hi[frequent].view(np.int64), lo[frequent].view(np.int64), n[frequent], docs[frequent], largest[frequent]], axis=1).astype("<i8")
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in (index.to_bytes(), *(a.tobytes() for a in arrays), hot.tobytes())), pa.array([int(n.sum())])],
            names=INDEX.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, waiting = [], None, 0
        for batch in batches:
            shard = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
            for a, b in zip(edges, np.append(edges[1:], len(shard)) if len(shard) else [], strict=True):
                if held is not None and shard[a] != held:
                    yield arrays_of(held, parts)
                    parts, waiting = [], 0
                held = int(shard[a])
                hi, lo, doc, n = (c.to_numpy()[a:b] for c in batch.columns[1:])
                parts.append((hi.view(np.uint64), lo.view(np.uint64), doc, n))
                waiting += b - a
                if waiting > 2 * len(parts[0][0]) + REDUCE_LINES:
                    parts, waiting = [merged(parts)], 0
        if held is not None:
            yield arrays_of(held, parts)

    return run


def _by_shard(rows: DataFrame, shards: int, *order) -> DataFrame:
    """Whole shards to a partition, sorted by shard."""
    return rows.repartitionById(-(-shards // SHARDS_EACH), F.expr(f"cast(shard div {SHARDS_EACH} as int)")).sortWithinPartitions("shard", *order)


def build_index(docs: DataFrame, min_chars: int, min_docs: int, shards: int) -> DataFrame:
    """docs (doc_id, text) to one row of arrays for each shard, as a written table."""
    counted = docs.mapInArrow(_count_lines(min_chars, min_docs, shards), "shard int, hi long, lo long, doc_id long, n long")
    return written(_by_shard(counted, shards).mapInArrow(_build_shards(min_docs), INDEX), "lines")


def hot_lines(index: DataFrame) -> dict[bytes, tuple[int, int]]:
    """Hash to (documents up to min_docs, largest id) of the lines that make up a HOT_LINES-th of all lines each: at most HOT_LINES."""
    total = index.agg(F.sum("lines")).first()[0] or 0
    least = max(-(-total // HOT_LINES), 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column(0).to_pylist():
                rows = np.frombuffer(held, "<i8").reshape(-1, 5)
                rows = rows[rows[:, 2] >= least]
                yield pa.RecordBatch.from_arrays([pa.array([r[:2].tobytes() for r in rows], pa.binary()), pa.array(rows[:, 3].copy()), pa.array(rows[:, 4].copy())], names=["digest", "docs", "largest"])

    return {bytes(r["digest"]): (r["docs"], r["largest"]) for r in index.select("hot").mapInArrow(run, "digest binary, docs long, largest long").collect()}


def _probes(min_chars: int, shards: int, hot: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, owners = [], []

        def flush() -> pa.RecordBatch:
            hi, lo = halves(digests)
            out = pa.RecordBatch.from_arrays([pa.array((hi % np.uint64(shards)).astype(np.int32)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(owners, pa.int64())], names=["shard", "hi", "lo", "doc_id"])
            digests.clear(), owners.clear()
            return out

        for doc_id, text in pairs(batches):
            own = {d for d in split_lines(text, min_chars)[1] if d and d not in hot}
            digests += own
            owners += [doc_id] * len(own)
            if len(digests) >= 100_000:
                yield flush()
        yield flush()

    return run


def _answer(min_docs: int):
    """A shard's arrays come first, then its probes; out go (doc_id, hash) of lines to drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = prints = counts = largest = None
        for batch in batches:
            held, start = batch.column("hash").is_valid().to_numpy(zero_copy_only=False), 0
            for i in [*np.flatnonzero(held).tolist(), -1]:
                # probes up to the next shard's arrays
                end = i if i >= 0 else batch.num_rows
                if end > start:
                    hi, lo, doc_id = (batch.column(c).slice(start, end - start).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("hi", "lo", "doc_id"))
                    at = index.find(hi.view(np.uint64), lo.view(np.uint64))
                    known = at >= 0
                    known &= prints[at] == (lo.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    drop = np.flatnonzero(known & (counts[at] >= min_docs) & (largest[at] != doc_id))
                    both = np.stack([hi[drop], lo[drop]], axis=1).astype("<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(doc_id[drop]), pa.array([r.tobytes() for r in both], pa.binary())], names=["doc_id", "digest"])
                if i >= 0:
                    index = PerfectHash.from_bytes(batch.column("hash")[i].as_py())
                    prints, counts, largest = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("prints", "<u4"), ("counts", "<u4"), ("largest", "<i8")))
                    start = i + 1

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, text (the kept lines), n_lines, n_dropped, carry (a struct of the columns named in ``carry``)."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    plain = docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    index = build_index(plain, min_chars, min_docs, shards)
    hot = hot_lines(index)
    drop_hot = {d: largest for d, (n, largest) in hot.items() if n >= min_docs}

    probes = plain.mapInArrow(_probes(min_chars, shards, hot), "shard int, hi long, lo long, doc_id long")
    asked = _by_shard(index.drop("hot", "lines").unionByName(probes, allowMissingColumns=True), shards, F.col("hash").isNull())
    drops = asked.mapInArrow(_answer(min_docs), "doc_id long, digest binary").groupBy("doc_id").agg(F.collect_set("digest").alias("drops"))

    whole = docs.select(
        key.alias("key"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        (F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.struct(F.lit(0).alias("none"))).alias("carry"),
    )
    joined = whole.join(drops.withColumnRenamed("doc_id", "key").hint("shuffle_hash"), "key", "left").select("key", "doc_id", "text", "drops", "carry")
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), joined.schema["carry"]])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts, n_lines, n_dropped = [], [], []
                for k, text, drops in zip(*(part.column(c).to_pylist() for c in ("key", "text", "drops")), strict=True):
                    lines, digests = split_lines(text, min_chars)
                    gone = set(drops or ())
                    kept = [line for line, d in zip(lines, digests, strict=True) if d is None or d not in gone and drop_hot.get(d, k) == k]
                    texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), part.column("carry")], names=out.names)

    return joined.mapInArrow(keep, out)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line counts and the digest of what stays, for every document."""
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH line AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, range(1, len(string_split(coalesce(text, ''), chr(10))) + 1) AS r(i)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
), common AS (
  SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.i, k.line, (c.key IS NOT NULL AND c.largest <> k.doc_id) AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
