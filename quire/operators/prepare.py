"""Validation and the processing projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.functions import text as T
from quire.functions.sentences import Splitter, split_trained


def is_valid(config: EngineConfig = EngineConfig()) -> Column:
    """An id; a title or an abstract; a raw text of an allowed length."""
    title, abstract = (F.coalesce(F.col(c), F.lit("")) for c in ("title", "abstract"))
    length = F.char_length(T.strip(F.concat_ws(" ", title, abstract)))
    return (F.coalesce(F.col("pmid"), F.lit("")) != "") & ((title != "") | (abstract != "")) & length.between(config.min_text_length, config.max_text_length)


def validate(papers: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    return papers.filter(is_valid(config))


def process(papers: DataFrame, config: EngineConfig = EngineConfig(), splitter: Splitter | None = None) -> DataFrame:
    """The 13 columns of a processed paper.  Each derived array is computed once and reused.  ``splitter``: a trained one, instead of the rule."""
    none = F.array().cast("array<string>")
    cleaned = papers.select(
        "pmid",
        T.clean_text(F.col("title")).alias("title"),
        T.clean_text(F.col("abstract")).alias("abstract"),
        T.clean_text(F.col("journal")).alias("journal"),
        F.coalesce("authors", none).alias("authors"),
        F.coalesce("pub_date", F.lit("Unknown")).alias("pub_date"),
        F.coalesce("mesh_terms", none).alias("mesh_terms"),
    ).withColumn("text_content", T.text_content(F.col("title"), F.col("abstract")))
    if splitter is None:
        split = cleaned.withColumn("sentences", T.split_sentences(F.col("text_content"), config.sentence_min_chars))
    else:
        parts = cleaned.withColumn("_parts", split_trained(T.collapse(F.col("text_content")), splitter))
        split = parts.withColumn("sentences", T.split_sentences(F.col("text_content"), config.sentence_min_chars, F.col("_parts")))
    chunked = split.withColumn("chunks", T.chunk_sentences(F.col("sentences"), config.chunk_words))
    return chunked.select(
        "pmid", "title", "abstract", "text_content", "sentences", "chunks", "authors", "journal", "pub_date", "mesh_terms",
        T.word_count(F.col("text_content")).alias("word_count"), F.size("sentences").alias("sentence_count"), F.size("chunks").alias("chunk_count"),
    )


def process_valid(papers: DataFrame, config: EngineConfig = EngineConfig(), splitter: Splitter | None = None) -> tuple[DataFrame, Observation]:
    """Processed valid papers, and an observation with ``seen`` and ``processed`` once an action has run."""
    counts = Observation("papers")
    seen = papers.observe(counts, F.count("*").alias("seen"), F.count_if(is_valid(config)).alias("processed"))
    return process(validate(seen, config), config, splitter), counts


def with_text(papers: DataFrame) -> DataFrame:
    return papers.filter(F.char_length(F.coalesce("text_content", F.lit(""))) > 0)


def paper(papers: DataFrame, pmid: str) -> DataFrame:
    """The row of an id, or none."""
    return papers.filter(F.col("pmid") == pmid).limit(1)
