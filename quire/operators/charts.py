"""Chart-ready tables and display projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import ellipsis
from quire.functions.vectors import cosine
from quire.operators.topics import topic_centres, trending


def trend_lines(trends: DataFrame, k: int = 10) -> DataFrame:
    return trending(trends, k).select("topic_id", "growth_score", F.explode("time_series").alias("p")).select("topic_id", "p.time_period", "p.count", "growth_score")


def growth_bars(trends: DataFrame, labels: DataFrame | None = None, k: int = 10) -> DataFrame:
    top = trending(trends, k)
    if labels is None:
        return top.select(F.col("topic_id").cast("string").alias("label"), "growth_score")
    return top.join(F.broadcast(labels.select("topic_id", "topic_label")), "topic_id", "left").select(F.coalesce("topic_label", F.col("topic_id").cast("string")).alias("label"), "growth_score")


def topic_similarity(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """Cosine of the topics' mean vectors; as many rows as pairs of topics, which the model's k bounds."""
    mean = topic_centres(vectors, assigned).withColumnRenamed("centre", "v")
    a, b = mean.select(F.col("topic_id").alias("topic_a"), F.col("v").alias("va")), mean.select(F.col("topic_id").alias("topic_b"), F.col("v").alias("vb"))
    return a.join(b, F.col("topic_a") < F.col("topic_b")).select("topic_a", "topic_b", cosine(F.col("va"), F.col("vb")).alias("similarity"))


def cards(papers: DataFrame) -> DataFrame:
    """What a result list shows of a paper."""
    shown = lambda a: F.when(F.size(a) > 5, F.concat(F.array_join(F.slice(a, 1, 5), ", "), F.lit("..."))).otherwise(F.array_join(a, ", "))
    return papers.select("pmid", "title", ellipsis(F.col("journal"), 30, always=True).alias("journal"), ellipsis(F.col("abstract"), 500).alias("abstract"), shown("mesh_terms").alias("mesh_terms"))


def ranked(rows: DataFrame, *order) -> DataFrame:
    """Adds a 1-based rank; for result lists, which are at most k rows."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
