"""Latent semantic vectors: truncated singular value decomposition of the tf-idf matrix, for texts and for words.

The matrix has a row for each text and a column for each of the most frequent terms (at most ``vocabulary``; a term is in two
texts at least).  Its leading right singular vectors come from subspace iteration: a random basis of the terms is multiplied
by the matrix and its transpose in one pass over the written rows, and made orthonormal on the driver.  What a
pass returns, and what tasks are sent, is terms x (dim + OVERSAMPLE) numbers whatever the number of texts; the sums are
Spark's.  A text's vector is the unit vector of its tf-idf row times the singular vectors; a word's is that of a text
of this word alone.  So two texts, or a word and a text, may be near without sharing a term.

Texts without a known term, null and empty ones, have the zero vector.  Ties in the vocabulary go by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.config import EngineConfig
from quire.functions.text import tokens
from quire.operators.prepare import with_text
from quire.storage import written

OVERSAMPLE, PASSES = 10, 5
#: Rows and entries of the matrix that a task multiplies at once, as a dense block of the terms that they hold.
ROWS, ENTRIES = 128, 16_000
#: Queries and candidates that a task compares at once, and the queries of one product.
ASKED, HELD, PRODUCT = 4_096, 8_192, 256


def frequent_terms(texts: DataFrame, size: int, min_texts: int = 2) -> list[tuple[str, int]]:
    """(term, texts) of the terms that most texts (tokens array<string>) hold, ties by word."""
    held = texts.select(F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return [(r["word"], r["n"]) for r in held.filter(F.col("n") >= min_texts).orderBy(F.desc("n"), "word").limit(size).collect()]


def _slices(offsets: np.ndarray):
    """Ranges of at most ROWS rows of about ENTRIES entries."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + ENTRIES, "right")) - 1)
        last = min(last, first + ROWS)
        yield first, last
        first = last


def _blocks(places: np.ndarray, values: np.ndarray, offsets: np.ndarray):
    """(first row, end, terms, dense block of these rows and terms), entries of one place added up; rows without an entry are rows of noughts."""
    for a, b in _slices(offsets):
        own = slice(offsets[a], offsets[b])
        terms, column = np.unique(places[own], return_inverse=True)
        row = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
        yield a, b, terms, np.bincount(row * len(terms) + column, values[own], (b - a) * len(terms)).reshape(b - a, len(terms))


def _lists(column) -> tuple:
    """The values of an Arrow column of lists as one array, and their offsets; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.append(0, np.cumsum(sizes, dtype=np.int64))


def _as_lists(values: np.ndarray, offsets: np.ndarray):
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _known(words, offsets: np.ndarray, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the words that are terms, and the offsets of their lists."""
    found = pc.fill_null(pc.index_in(words, value_set=pa.array(terms, words.type)), -1).to_numpy(zero_copy_only=False)
    return found[found >= 0].astype(np.int64), np.append(0, np.cumsum(found >= 0))[offsets]


def gram_times(matrix: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The matrix's transpose times the matrix times a basis, in one pass over rows (places array<int>, values array<double>)."""

    def run(batches):
        total = np.zeros_like(basis)
        for part in batches:
            places, offsets = _lists(part.column("places"))
            values = _lists(part.column("values"))[0].to_numpy(zero_copy_only=False)
            for _, _, terms, block in _blocks(places.to_numpy(zero_copy_only=False), values, offsets):
                total[terms] += block.T @ (block @ basis[terms])
        touched = np.flatnonzero(total.any(axis=1)).astype(np.int32)
        for i in range(0, len(touched), 1000):
            some = touched[i : i + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(some), _as_lists(total[some].ravel(), np.arange(len(some) + 1) * basis.shape[1])], ["place", "sums"])

    tasks = 2 * matrix.sparkSession.sparkContext.defaultParallelism  # each returns its sums, so their number doesn't grow with the rows
    parts = matrix.select("places", "values").coalesce(tasks).mapInArrow(run, "place int, sums array<double>")
    sums = parts.groupBy("place").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    out = np.zeros_like(basis)
    for r in sums.collect():  # a row a term
        out[r["place"]] = r["sums"]
    return out


def leading_directions(matrix: DataFrame, terms: int, dim: int, seed: int = 42, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors as columns, singular values), the greatest first; the sign makes each vector's largest entry positive."""
    if not terms:
        return np.zeros((0, 0)), np.zeros(0)
    width = min(terms, dim + OVERSAMPLE)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(terms, width)))[0]
    for _ in range(passes):
        basis = np.linalg.qr(gram_times(matrix, basis))[0]
    small = basis.T @ gram_times(matrix, basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[: min(dim, terms)]
    directions = basis @ vectors[:, order]
    directions *= np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
    return directions, np.sqrt(np.maximum(values[order], 0))


class LatentEmbedder:
    """Stands in for ``search.Embedder``: fit, embed and embed_text; also word_vectors, save and load."""

    def __init__(self, config: EngineConfig = EngineConfig(), terms: list[str] | None = None, weights: np.ndarray | None = None, directions: np.ndarray | None = None):
        self.config, self.terms, self.weights, self.directions = config, terms, weights, directions

    def fit(self, papers: DataFrame) -> LatentEmbedder:
        texts = written(with_text(papers).select(tokens(F.col("text_content")).alias("tokens")), "tokens")
        total, found = texts.count(), frequent_terms(texts, self.config.latent_vocabulary)
        self.terms = [w for w, _ in found]
        self.weights = np.log((total + 1) / (np.array([n for _, n in found], np.float64) + 1))
        matrix = written(self.rows(texts).select("row.places", "row.values"), "tf-idf")
        self.directions, _ = leading_directions(matrix, len(self.terms), self.config.latent_dim, self.config.seed)
        return self

    def rows(self, texts: DataFrame) -> DataFrame:
        """texts with ``row``: the places of their terms and the values of the unit tf-idf row, in the place of ``tokens``."""
        terms, weights = self.terms, self.weights
        kind = T.StructType([T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])

        @F.arrow_udf(kind)
        def row(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in batches:
                found, offsets = _known(*_lists(column), terms)
                parts = [(np.zeros(0, np.int32), np.zeros(0), np.zeros(1, np.int64))]
                for a, b in _slices(offsets):
                    rows = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
                    entries, counts = np.unique(rows * len(terms) + found[offsets[a] : offsets[b]], return_counts=True)
                    rows, places = np.divmod(entries, max(len(terms), 1))
                    values = counts * weights[places]
                    norm = np.sqrt(np.bincount(rows, values**2, b - a))
                    parts.append((places.astype(np.int32), values / np.where(norm > 0, norm, 1.0)[rows], np.bincount(rows, minlength=b - a)))
                places, values, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
                begin = np.cumsum(sizes)
                yield pa.StructArray.from_arrays([_as_lists(places, begin), _as_lists(values, begin)], ["places", "values"])

        return texts.withColumn("row", row("tokens")).drop("tokens")

    def embed(self, papers: DataFrame) -> DataFrame:
        """(pmid, embedding) of the papers with a text."""
        directions, dim = self.directions, self.config.latent_dim

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def vector(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for places, values in batches:
                at, offsets = _lists(places)
                out = np.zeros((len(places), dim))
                for a, b, terms, block in _blocks(at.to_numpy(zero_copy_only=False), _lists(values)[0].to_numpy(zero_copy_only=False), offsets):
                    out[a:b, : directions.shape[1]] = block @ directions[terms]
                norm = np.linalg.norm(out, axis=1, keepdims=True)
                yield _as_lists((out / np.where(norm > 0, norm, 1.0)).astype(np.float32).ravel(), np.arange(len(out) + 1) * dim)

        rows = self.rows(with_text(papers).select("pmid", tokens(F.col("text_content")).alias("tokens")))
        return rows.select("pmid", vector("row.places", "row.values").alias("embedding"))

    def embed_text(self, spark: SparkSession, text: str) -> list[float]:
        one = self.embed(spark.createDataFrame([("", text)], "pmid string, text_content string")).first()
        return list(one["embedding"]) if one else [0.0] * self.config.latent_dim

    def sentence_cosines(self, sentences: Column, query: list[float]) -> Column:
        """The cosine of each of an array of sentences and a query's vector, within the row; sentences without a known term have 0."""
        terms, weights, along = self.terms, self.weights, self.directions
        wanted = np.array(query, np.float64)[: along.shape[1]]

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def cosines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in batches:
                texts, begin = _lists(column)
                places, offsets = _known(*_lists(texts), terms)
                out = np.zeros(len(texts))
                for a, b, own, block in _blocks(places, weights[places], offsets):
                    vectors = block @ along[own]
                    norm = np.linalg.norm(vectors, axis=1) * np.linalg.norm(wanted)
                    out[a:b] = np.where(norm > 0, vectors @ wanted / np.where(norm > 0, norm, 1.0), 0.0)
                yield _as_lists(out, begin)

        return cosines(F.transform(sentences, tokens))

    def word_vectors(self, spark: SparkSession) -> DataFrame:
        """(word, embedding) of every term: the vector of a text of this word alone."""
        norm = np.linalg.norm(self.directions, axis=1, keepdims=True)
        unit = np.pad(self.directions / np.where(norm > 0, norm, 1.0), ((0, 0), (0, self.config.latent_dim - self.directions.shape[1]))) * (self.weights > 0)[:, None]
        return spark.createDataFrame([(w, v.tolist()) for w, v in zip(self.terms, unit, strict=True)], "word string, embedding array<float>")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, w, float(x), v.tolist()) for i, (w, x, v) in enumerate(zip(self.terms, self.weights, self.directions, strict=True))]
        spark.createDataFrame(rows, "place int, word string, weight double, direction array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: EngineConfig = EngineConfig()) -> LatentEmbedder:
        rows = spark.read.parquet(path).orderBy("place").collect()  # a row a term
        return cls(config, [r["word"] for r in rows], np.array([r["weight"] for r in rows]), np.array([r["direction"] for r in rows]).reshape(len(rows), -1))


def rank_quality(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """One row: queries, the share whose own candidate is among its k nearest, and the mean of 1 / rank, for rows (pmid, embedding) of equal ids; ties count against it.

    All queries meet all candidates, as ranks are exact: blocks of ASKED queries and of HELD candidates meet in a task each, so
    neither memory nor what the driver holds grows with their number; the work does, with its product."""
    session = candidates.sparkSession
    held = written(candidates.select("pmid", "embedding"), "held")
    own = held.join(queries.select("pmid").distinct(), "pmid", "left_semi").groupBy("pmid").agg(F.min("embedding").alias("own"))
    asked = written(queries.select("pmid", "embedding").join(own, "pmid").select(F.monotonically_increasing_id().alias("query"), "embedding", "own"), "asked")
    blocks, parts = -(-asked.count() // ASKED), max(2 * session.sparkContext.defaultParallelism, -(-held.count() // HELD))
    if not blocks:
        return session.createDataFrame([(0, None, None)], "queries long, recall double, reciprocal_rank double")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"), "query", "embedding", "own")
    right = held.select(every(blocks).alias("block"), F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int").alias("part"), "embedding")

    def better(mine, others):
        n, ahead = mine.num_rows, np.zeros(mine.num_rows, np.int64)
        matrix = lambda t, c: _lists(t.column(c).combine_chunks())[0].to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        if n and others.num_rows:
            vectors, rows = matrix(mine, "embedding"), matrix(others, "embedding")
            score = np.einsum("ij,ij->i", vectors, matrix(mine, "own"))
            for i in range(0, n, PRODUCT):
                ahead[i : i + PRODUCT] = (vectors[i : i + PRODUCT] @ rows.T >= score[i : i + PRODUCT, None] - 1e-12).sum(axis=1)  # its own among them
        return pa.table({"query": mine.column("query"), "ahead": pa.array(ahead)})

    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(better, "query long, ahead long")
    ranks = met.groupBy("query").agg(F.greatest(F.sum("ahead"), F.lit(1)).alias("rank"))
    return ranks.agg(F.count("*").alias("queries"), F.avg((F.col("rank") <= k).cast("double")).alias("recall"), F.avg(1 / F.col("rank")).alias("reciprocal_rank"))
