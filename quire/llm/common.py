"""What the operators share: written tables, samples, and Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.storage import shared_folder

#: Bytes after which an output batch is closed.
BATCH_BYTES = 8_000_000


def written(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends here, and a lost executor loses none of it."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(df: DataFrame) -> None:
    """Frees the disk of a table from ``written`` that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0].rsplit("/", 1)[0]) if df.inputFiles() else None
    if path is not None:
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(docs: DataFrame, id_col: str, text_col: str, whole: bool = True) -> DataFrame:
    """(doc_id long, text string), with null text as empty where ``whole``; other columns go, so their names can't clash."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.coalesce(text, F.lit("")) if whole else text).alias("text"))


def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of two-column batches, a bounded slice at a time as Python values."""
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


class Rows:
    """Collects output rows and hands out record batches of about BATCH_BYTES."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 64) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size >= BATCH_BYTES or len(self.rows) >= 50_000:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in self.schema]
        out = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0
        return out


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of the smallest key hashes.  A threshold on the hash leaves about half as many again before they are sorted, so tasks send few to the driver."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    share = 1.5 * rows / max(1, df.count())
    near = df.filter(place < int(share * (1 << 40))) if share < 1 else df
    return near.orderBy(place, *df.columns).limit(rows)

