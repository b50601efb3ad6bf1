"""Explicit schemas; nothing is inferred, so an id stays a string."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _STRINGS, _INT = T.StringType(), T.ArrayType(T.StringType()), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RAW_PAPER = _struct(pmid=_STRING, title=_STRING, abstract=_STRING, authors=_STRINGS, journal=_STRING, pub_date=_STRING, mesh_terms=_STRINGS, text_content=_STRING)

PROCESSED_PAPER = _struct(
    pmid=_STRING, title=_STRING, abstract=_STRING, text_content=_STRING, sentences=_STRINGS, chunks=_STRINGS, authors=_STRINGS,
    journal=_STRING, pub_date=_STRING, mesh_terms=_STRINGS, word_count=_INT, sentence_count=_INT, chunk_count=_INT,
)

SUMMARY = T.StructType([*PROCESSED_PAPER.fields, *_struct(summary=_STRING, error=_STRING, original_length=_INT, summary_length=_INT, compression_ratio=T.DoubleType()).fields])

VECTOR = _struct(pmid=_STRING, embedding=T.ArrayType(T.FloatType()))

ASSIGNMENT = _struct(pmid=_STRING, topic_id=_INT, topic_probability=T.DoubleType())
