"""Embedding and exact vector search.  Scores come from ids and vectors alone; payload joins the k rows found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.functions import vectors as V
from quire.functions.text import tokens
from quire.operators.prepare import with_text


class Embedder:
    """Deterministic text vectors: hashed terms, inverse document frequency, unit norm.  Others may stand in: fit, embed and embed_text."""

    def __init__(self, config: EngineConfig = EngineConfig(), model: PipelineModel | None = None):
        self.config, self.model = config, model

    def fit(self, papers: DataFrame) -> Embedder:
        stages = [HashingTF(inputCol="tokens", outputCol="tf", numFeatures=self.config.embedding_dim), IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="unit")]
        self.model = Pipeline(stages=stages).fit(with_text(papers).select(tokens(F.col("text_content")).alias("tokens")))
        return self

    def embed(self, papers: DataFrame) -> DataFrame:
        """(pmid, embedding) of the papers with a text."""
        rows = with_text(papers).select("pmid", tokens(F.col("text_content")).alias("tokens"))
        return self.model.transform(rows).select("pmid", vector_to_array("unit", "float32").alias("embedding"))

    def embed_text(self, spark, text: str) -> list[float]:
        one = self.embed(spark.createDataFrame([("", text)], "pmid string, text_content string")).first()
        return list(one["embedding"]) if one else [0.0] * self.config.embedding_dim


def top_k(vectors: DataFrame, query: Sequence[float], k: int | None = None, default: int = 10) -> DataFrame:
    """(pmid, similarity_score) of the k largest inner products, ties by id.  The query is a literal: one stage and a top-k, no shuffle of vectors."""
    scored = vectors.select("pmid", V.dot(F.col("embedding"), V.literal(query)).alias("similarity_score"))
    return scored.orderBy(F.desc("similarity_score"), "pmid").limit(k or default)


def vector_of(vectors: DataFrame, pmid: str) -> list[float] | None:
    row = vectors.filter(F.col("pmid") == pmid).select("embedding").first()
    return None if row is None else list(row["embedding"])


def similar(vectors: DataFrame, pmid: str, k: int | None = None, default: int = 10) -> DataFrame:
    """The nearest other papers; none for an unknown id.  The paper's vector is looked up first, then it is a literal of the search."""
    own = vector_of(vectors, pmid)
    return top_k(vectors.filter(F.col("pmid") != pmid) if own is not None else vectors.limit(0), own or [], k, default)


def with_payload(hits: DataFrame, papers: DataFrame) -> DataFrame:
    """Papers of the hits with their scores, best first; hits are at most k rows."""
    return papers.join(F.broadcast(hits), "pmid").orderBy(F.desc("similarity_score"), "pmid")
