"""The corpus pipeline: quality, lines, near-duplicates, passages, packing; each stage an operator of quire.llm.

A stage takes (spark, docs, sf_dir) and returns what it keeps; between stages the documents are a written
Parquet table.  All but the last stage return the columns of ``documents``, and no extra ones; a text that a
stage changes gets its new n_chars.

Null and empty texts go through every stage (the classifier decides on them as on others; they are near copies of
each other; they pack to the end id), as do null ids, which no other document stands for.  Ties go to the smaller
id, of lines to the largest.  Rows of one id are one document: equal ones leave near_copies as one row, others with
it.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import written
from quire.llm.library_tokens import vocabulary
from quire.llm.line_dedup import dedup_lines
from quire.llm.packing import pack_documents
from quire.llm.quality import fit, held_out, score_documents
from quire.llm.simhash import near_duplicates
from quire.llm.substring_dedup import dedup_passages
from quire.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id")))
    return score_documents(docs, model, carry=list(COLUMNS)).filter("predicted = 1").select("carry.*")


def _changed(done: DataFrame) -> DataFrame:
    """The documents with the text an operator left of them."""
    return done.select("carry.doc_id", "text", "carry.lang", "carry.source", F.char_length("text").cast("long").alias("n_chars"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    ship(spark)
    return _changed(dedup_lines(docs, carry=["doc_id", "lang", "source"]))


#: Near copies: words of a shingle, bits between fingerprints of candidates, and the least similarity of a link.
SHINGLE, DISTANCE, SIMILARITY = 5, 14, (4, 5)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 (5-word shingles) the document of the smallest id stays; so does a row without an id, which no other can stand for."""
    ship(spark)
    found = near_duplicates(docs, DISTANCE, SHINGLE, least=SIMILARITY).filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    own = docs.select(*COLUMNS)
    once = own.join(found.filter("n = 1"), "doc_id", "left_semi")
    again = own.join(found.filter("n > 1"), "doc_id", "left_semi").dropDuplicates(list(COLUMNS))
    return once.unionByName(again).unionByName(own.filter("doc_id is null"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages stay in the earliest document that holds them."""
    ship(spark)
    return _changed(dedup_passages(docs, carry=["doc_id", "lang", "source"]))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 1024 ids."""
    ship(spark)
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("passages", passages), ("packing", packing)]

#: The classifier, the fingerprints and the ids have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
