"""An approximate vector index: a table partitioned by the signs of random projections, pruned at query time.

Vectors fall into 2^bits buckets by the signs of their projections on orthonormal random directions, after the mean is
taken off.  A query visits buckets in the order of what its projections would have to cross to get there (the
sum of the squares of those that differ in sign), and scores all rows of the buckets visited exactly.  How many are visited is measured
when the index is built: the fewest with which a sample finds the wanted share of its own nearest rows.  Rows are denser in the
whole table than in the sample, so its neighbours are nearer and the share found is no less.

Below ``path``: ``rows`` (partitioned by bucket; large buckets are many files, so rows that are all alike are no hot
task) and ``meta`` (one row).  Rows without a vector, or with a null or non-finite component, are left out.  A query for more rows than the visited
buckets hold goes on to further ones.  ``top_k`` over the same vectors is the exact way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.search import top_k

MAX_BITS = 12
#: Rows of a bucket that are wanted at least, on average; rows of a file.
BUCKET_ROWS, FILE_ROWS = 64, 200_000
#: Rows of the sample in which the visits are measured, and those of them that are queries.
SAMPLE, QUERIES = 4_096, 256


def directions(dim: int, bits: int, seed: int) -> np.ndarray:
    """``bits`` orthonormal directions as columns."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, bits)))[0]


def bucket_of(vector: Column, planes: np.ndarray, centre: np.ndarray) -> Column:
    """The number whose bit i tells whether projection i is above the mean's."""
    level = centre @ planes

    @F.pandas_udf("int")
    def bucket(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int32")
        signs = np.array(vectors.tolist(), np.float64) @ planes > level
        return pd.Series((signs << np.arange(planes.shape[1])).sum(axis=1).astype("int32"))

    return bucket(vector)


def visiting_order(projections: np.ndarray) -> np.ndarray:
    """For each row of projections (less the mean's) all buckets, the nearest first; ties by number."""
    bits = projections.shape[-1]
    signs = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    own = projections > 0
    cost = np.where(own, projections**2, 0) @ (1 - signs).T + np.where(own, 0, projections**2) @ signs.T
    return np.argsort(cost, axis=-1, kind="stable")


def visits_needed(sample: np.ndarray, planes: np.ndarray, centre: np.ndarray, k: int, recall: float) -> int:
    """The fewest buckets that hold ``recall`` of the k nearest rows, by inner product, of the sample's first rows."""
    projections = (sample - centre) @ planes
    bucket = ((projections > 0) << np.arange(planes.shape[1])).sum(axis=1)
    ranks = []
    for i in range(min(QUERIES, len(sample))):
        score = sample @ sample[i]
        score[i] = -np.inf
        near = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
        order = visiting_order(projections[i])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ranks.append(place[bucket[near]])
    ranks = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0, np.int64)
    return int(ranks[math.ceil(recall * len(ranks)) - 1]) + 1 if len(ranks) else 1


def usable(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    planes: np.ndarray
    centre: np.ndarray
    visits: int
    counts: dict[int, int]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, bits: int | None = None, recall: float = 0.95, k: int = 10, visits: int | None = None, seed: int = 42) -> VectorIndex:
        """Writes the index of (pmid, embedding); ``visits`` fixes the number of buckets visited instead of measuring it."""
        spark = vectors.sparkSession
        own = usable(vectors).select("pmid", "embedding")
        mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
        total = own.count()
        centre = np.array(own.agg(vector_to_array(mean)).first()[0] if total else [0.0])
        if bits is None:
            bits = max(1, min(MAX_BITS, len(centre), int(math.log2(max(2, total / BUCKET_ROWS)))))
        planes = directions(len(centre), bits, seed)
        rows = own.withColumn("bucket", bucket_of(F.col("embedding"), planes, centre))
        counts = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}  # at most 2^MAX_BITS
        if visits is None:
            share = min(1.0, 2 * SAMPLE / max(1, total))
            some = own.filter(F.pmod(F.xxhash64("pmid"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).orderBy(F.xxhash64("pmid", F.lit(seed))).limit(SAMPLE)
            sample = np.array([r["embedding"] for r in some.select("embedding").collect()], np.float64).reshape(-1, len(centre))
            visits = visits_needed(sample, planes, centre, k, recall)
        files = F.greatest(F.lit(1), F.ceil(F.element_at(F.create_map(*(F.lit(x) for b, n in counts.items() for x in (b, n))), F.col("bucket")) / FILE_ROWS)) if counts else F.lit(1)
        dealt = rows.withColumn("file", F.pmod(F.xxhash64("pmid"), files)).repartition("bucket", "file").drop("file")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
        meta = spark.createDataFrame([(bits, visits, [[float(x) for x in p] for p in planes], [float(x) for x in centre], counts)], "bits int, visits int, planes array<array<double>>, centre array<double>, counts map<int,long>")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        return cls(spark, path, planes, centre, visits, counts)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        m = spark.read.parquet(f"{path}/meta").first()
        return cls(spark, path, np.array(m["planes"]), np.array(m["centre"]), m["visits"], m["counts"])

    def buckets(self, query: Sequence[float], k: int, visits: int | None = None) -> list[int]:
        """The buckets to visit for k rows."""
        order = visiting_order((np.array(query, np.float64) - self.centre) @ self.planes).tolist()
        chosen, held = [], 0
        for i, bucket in enumerate(order):
            if i >= (visits or self.visits) and held >= k:
                break
            if n := self.counts.get(bucket, 0):
                chosen.append(bucket)
                held += n
        return chosen

    def rows(self, buckets: Sequence[int]) -> DataFrame:
        """The indexed rows of some buckets; other buckets' files aren't read."""
        if not self.counts:
            return self.spark.createDataFrame([], "pmid string, embedding array<float>, bucket int")
        return self.spark.read.parquet(f"{self.path}/rows").filter(F.col("bucket").isin(list(buckets)))

    def search(self, query: Sequence[float], k: int = 10, visits: int | None = None) -> DataFrame:
        """(pmid, similarity_score) of the largest inner products among the rows visited, ties by id."""
        return top_k(self.rows(self.buckets(query, k, visits)), query, k)

    def similar(self, pmid: str, k: int = 10, visits: int | None = None) -> DataFrame:
        """The nearest other rows of an indexed one; none for an unknown id."""
        own = self.spark.read.parquet(f"{self.path}/rows").filter(F.col("pmid") == pmid).select("embedding").first() if self.counts else None
        if own is None:
            return self.spark.createDataFrame([], "pmid string, similarity_score double")
        return top_k(self.rows(self.buckets(own["embedding"], k + 1, visits)).filter(F.col("pmid") != pmid), own["embedding"], k)

    def search_many(self, queries: DataFrame, k: int = 10, visits: int | None = None) -> DataFrame:
        """(query, pmid, similarity_score, rank) for rows (query, embedding): queries meet the rows of their buckets only, in products of matrices.

        Queries are a stated set that fits a task; rows come from their files, bucket by bucket, and only the k best of a task travel."""
        asked = queries.select(F.col("query").cast("string"), "embedding").collect()
        schema = "query string, pmid string, similarity_score double"
        if not asked or not self.counts:
            return self.spark.createDataFrame([], schema + ", rank long")
        names, vectors = [r["query"] for r in asked], np.array([r["embedding"] for r in asked], np.float64)
        by_bucket: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            for b in self.buckets(v, k, visits):
                by_bucket.setdefault(b, []).append(i)

        def scan(batches):
            best: dict[int, list] = {}
            for frame in batches:
                for bucket, part in frame.groupby("bucket"):
                    ids, own = part["pmid"].to_numpy(), by_bucket[int(bucket)]
                    score = np.array(part["embedding"].tolist(), np.float64) @ vectors[own].T
                    for column, i in enumerate(own):
                        top = np.lexsort((ids, -score[:, column]))[:k]
                        best[i] = sorted([*best.get(i, []), *zip((-score[top, column]).tolist(), ids[top].tolist(), strict=True)])[:k]
            rows = [(names[i], p, -s) for i, found in best.items() for s, p in found]
            yield pd.DataFrame(rows, columns=["query", "pmid", "similarity_score"])

        found = self.rows(sorted(by_bucket)).select("bucket", "pmid", "embedding").mapInPandas(scan, schema)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity_score"), "pmid"))
        return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)
