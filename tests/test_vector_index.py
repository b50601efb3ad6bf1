"""The vector index against exact search: recall on spread and clustered vectors, files read, odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import search
from quire.operators.vector_index import VectorIndex, bucket_of, directions, visiting_order
from quire.plans import queries, views

TYPE = "pmid string, embedding array<double>"


def exact(vectors, query, k=10):
    return sorted(((-float(np.dot(v, query)), p) for p, v in vectors.items()))[:k]


def frame(spark, vectors, parts=4):
    return spark.createDataFrame([(p, [float(x) for x in v]) for p, v in vectors.items()], TYPE).repartition(parts)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32)) * 3
    rows = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 32)) * 0.3
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    return {f"p{i}": v for i, v in enumerate(rows)}


def test_recall_and_files_read_on_clusters(spark, clustered, tmp_path):
    index = VectorIndex.build(frame(spark, clustered), str(tmp_path / "i"))
    assert index.visits <= (1 << index.planes.shape[1]) // 8
    asked = [f"p{i}" for i in range(0, 6000, 50)]
    found = index.search_many(frame(spark, {p: clustered[p] for p in asked}).withColumnRenamed("pmid", "query")).collect()
    got = {}
    for r in found:
        got.setdefault(r["query"], {})[r["pmid"]] = r["similarity_score"]
    hits = sum(len({p for _, p in exact(clustered, clustered[q])} & set(got[q])) for q in asked)
    assert hits >= 0.9 * 10 * len(asked)
    for q in asked[:5]:  # scores are exact, and one query finds what many at once find
        assert all(abs(s - float(np.dot(clustered[p], clustered[q]))) < 1e-9 for p, s in got[q].items())
        assert {r["pmid"]: r["similarity_score"] for r in index.search(clustered[q]).collect()} == pytest.approx(got[q])
    plan = index.search(clustered["p0"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN", plan) or "bucket" in re.search(r"PartitionFilters: \[(.*?)\]", plan)[1]
    everything = len(spark.read.parquet(f"{index.path}/rows").inputFiles())
    chosen = index.buckets(clustered["p0"], 10)
    files = {r[0] for r in index.rows(chosen).select(F.input_file_name()).distinct().collect()}
    assert len(files) <= len(chosen) < everything / 4


def test_recall_of_the_query_on_spread_vectors(spark, sf):
    vectors = {r["pmid"]: np.array(r["embedding"], float) for r in views.paper_vectors(spark, sf).collect()}
    got = {}
    for r in queries.lsh_search(spark, sf).collect():
        got.setdefault(r["query"], set()).add(r["pmid"])
    assert set(got) == {p for p in vectors if int(p) % 50 == 0}
    assert sum(len({p for _, p in exact(vectors, vectors[q])} & got[q]) for q in got) >= 0.9 * 10 * len(got)


def test_opened_index_finds_the_same(spark, clustered, tmp_path):
    built = VectorIndex.build(frame(spark, clustered), str(tmp_path / "i"), bits=5)
    opened = VectorIndex.open(spark, str(tmp_path / "i"))
    assert [tuple(r) for r in opened.similar("p7", 5).collect()] == [tuple(r) for r in built.similar("p7", 5).collect()]
    assert "p7" not in {r["pmid"] for r in opened.similar("p7", 5).collect()}
    every = [tuple(r) for r in opened.search(clustered["p7"], 10, visits=1 << 5).collect()]
    assert every == [tuple(r) for r in search.top_k(frame(spark, clustered), clustered["p7"], 10).collect()]
    assert opened.similar("unknown").count() == 0


def test_odd_rows(spark, tmp_path):
    """Copies in one bucket, too few rows in the visited buckets, rows without a usable vector, an empty table."""
    vectors = {f"c{i:03}": [1.0, 0.0, 0.0] for i in range(300)} | {"a": [-1.0, 0.1, 0.0], "z": [0.0, 0.0, 0.0]}
    odd = [("n", None), ("e", []), ("i", [float("inf"), 0.0, 0.0]), ("x", [float("nan"), 0.0, 0.0]), ("h", [1.0, None, 0.0])]
    rows = frame(spark, vectors).unionByName(spark.createDataFrame(odd, TYPE)).withColumn("bucket", F.lit("clash"))
    index = VectorIndex.build(rows, str(tmp_path / "i"), bits=3, visits=1)
    assert sum(index.counts.values()) == 302
    assert [r["pmid"] for r in index.search([-1.0, 0.0, 0.0], 302).collect()][:2] == ["a", "z"]
    assert index.search([-1.0, 0.0, 0.0], 302).count() == 302
    assert [r["pmid"] for r in index.search([1.0, 0.0, 0.0], 3).collect()] == ["c000", "c001", "c002"]
    empty = VectorIndex.build(rows.limit(0), str(tmp_path / "e"))
    assert empty.search([1.0], 3).count() == 0 and VectorIndex.open(spark, str(tmp_path / "e")).similar("a").count() == 0


def test_buckets_and_order():
    planes = directions(8, 3, 1)
    assert np.allclose(planes.T @ planes, np.eye(3))
    order = visiting_order(np.array([0.5, -0.1, 2.0]))
    assert order[0] == 0b101 and order[1] == 0b111 and order[-1] == 0b010 and sorted(order) == list(range(8))


def test_bucket_column(spark, clustered):
    planes, centre = directions(32, 4, 9), np.full(32, 0.01)
    got = frame(spark, clustered).select("pmid", bucket_of(F.col("embedding"), planes, centre).alias("b")).collect()
    assert all(r["b"] == sum(1 << i for i in range(4) if (clustered[r["pmid"]] - centre) @ planes[:, i] > 0) for r in got)
