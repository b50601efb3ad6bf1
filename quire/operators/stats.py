"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.dates import year


def histogram(rows: DataFrame, column: str, name: str | None = None, k: int | None = None) -> DataFrame:
    """Values and their counts; with k the most frequent, ties by value."""
    counts = rows.groupBy(F.col(column).alias(name or column)).agg(F.count("*").alias("count"))
    return counts if k is None else counts.orderBy(F.desc("count"), name or column).limit(k)


def exploded(papers: DataFrame, array: str, name: str) -> DataFrame:
    return papers.select(*[c for c in ("pmid", "pub_date") if c in papers.columns], F.explode(array).alias(name))


def term_histogram(papers: DataFrame, k: int | None = None) -> DataFrame:
    return histogram(exploded(papers, "mesh_terms", "term"), "term", k=k)


def corpus_totals(processed: DataFrame) -> DataFrame:
    """One row: papers, words, sentences, their averages, first and last year; no row for an empty corpus."""
    n = F.count("*")
    totals = processed.agg(
        n.alias("total_papers"),
        F.sum("word_count").cast("long").alias("total_words"),
        F.sum("sentence_count").cast("long").alias("total_sentences"),
        F.avg("word_count").alias("avg_words_per_paper"),
        F.avg("sentence_count").alias("avg_sentences_per_paper"),
        F.min(year(F.col("pub_date")).cast("int")).alias("min_year"),
        F.max(year(F.col("pub_date")).cast("int")).alias("max_year"),
    )
    return totals.filter("total_papers > 0")


def corpus_stats(processed: DataFrame) -> DataFrame:
    """The totals with the ten top journals and twenty top terms as arrays."""
    ranked = lambda df, c: df.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), F.col(c).alias(c), "count"))), lambda x: F.struct(x[c].alias(c), x["count"].alias("count"))).alias(f"top_{c}s"))
    return corpus_totals(processed).crossJoin(ranked(histogram(processed, "journal", k=10), "journal")).crossJoin(ranked(term_histogram(processed, 20), "term"))  # one row each


def embedding_stats(vectors: DataFrame, model_name: str = "hashed tf-idf") -> DataFrame:
    return vectors.agg(F.count("*").alias("num_embeddings"), F.max(F.size("embedding")).alias("embedding_dim"), F.count_distinct("pmid").alias("num_papers")).select(
        "num_embeddings", "embedding_dim", F.lit(model_name).alias("model_name"), F.lit("flat inner product").alias("index_type"), "num_papers"
    )
