"""Byte-level BPE encoding and decoding of whole texts, without a tokenizer library.

Texts are cut into pieces by arrays (``segment``); distinct pieces, bucketed by length, are merged in
padded numpy matrices where every row merges its leftmost minimum-rank pair each round, with hashed
pair lookup and compaction (``matrix_bpe``).  Decoding gathers the tokens' bytes.

Null and empty texts give no ids.  Repeated rows and ids are encoded alike, each for itself; null ids stay null.
Extra columns are left alone.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Rows, id_and_text, pairs
from quire.llm.library_tokens import rank_encoder, vocabulary
from quire.llm.segment import spread


class TokenBytes:
    """The bytes of ids, gathered from one array of all tokens."""

    def __init__(self, tokens: list[bytes]):
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray) -> bytes:
        return self.data[spread(self.first[ids], self.length[ids])].tobytes()


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id long, ids binary (little-endian unsigned 32-bit), decoded binary (the bytes the ids stand for)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = rank_encoder(vocabulary_path, pattern)
        table, out, keys = TokenBytes(tokens), Rows(schema), deque()

        def texts():
            for key, text in pairs(batches):
                keys.append(key)
                yield text

        for ids in encoder.encode(texts()):
            raw, decoded = ids.astype("<u4").tobytes(), table.decode(ids)
            yield from out.add((keys.popleft(), raw, decoded), len(raw) + len(decoded) + 64)
        yield out.flush()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded bytes of every document."""
    import public_tokenizers

    done = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
