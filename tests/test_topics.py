"""Topic assignment against brute force, principal components, keyword re-ranking, vocabularies."""

import math

import numpy as np
from pyspark.sql import functions as F

from quire.operators import topics
from quire.plans import views


def test_assignment_by_hand(spark, sf):
    vectors = views.paper_vectors(spark, sf).select("pmid", "embedding")
    model = topics.fit_kmeans(vectors, 5)
    centres = np.array(model.stages[-1].clusterCenters())
    got = {r["pmid"]: r for r in topics.assign_topics(vectors, model).collect()}
    for r in vectors.collect():
        d = ((centres - np.array(r["embedding"], float)) ** 2).sum(axis=1)
        own = got[r["pmid"]]
        assert own["topic_id"] == d.argmin() and math.isclose(own["topic_probability"], 1 / np.exp(d.min() - d).sum(), rel_tol=1e-9)
    sizes = {t: n for t, n in topics.topic_info(topics.assign_topics(vectors, model)).collect()}
    limit = sorted(sizes.values())[2]
    after = {t: n for t, n in topics.topic_info(topics.assign_topics(vectors, model, limit)).collect()}
    assert after == {t: n for t, n in sizes.items() if n >= limit} | {-1: sum(n for n in sizes.values() if n < limit)}


def test_components_and_runs(spark, sf):
    vectors = views.paper_vectors(spark, sf).select("pmid", "embedding")
    model = topics.fit_kmeans(vectors, 4, runs=3, reduce_to=5)
    assert topics.assign_topics(vectors, model).count() == vectors.count()
    assert len(model.stages[-1].clusterCenters()[0]) == 5


def test_rerank(spark):
    keywords = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.5, 2), (1, "c", 0.1, 3)], "topic_id int, word string, score double, rank int")
    words = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0])], "word string, embedding array<double>")
    centres = spark.createDataFrame([(1, [1.0, 0.1])], "topic_id int, centre array<double>")
    assert [r["word"] for r in topics.rerank_keywords(keywords, words, centres).orderBy("rank").collect()] == ["b", "a", "c"]


def test_vocabulary(spark):
    rows = spark.createDataFrame([("1", "the blue whale and blue whale"), ("2", "a blue bird"), ("3", ""), ("4", None)], "pmid string, text_content string")
    assert [tuple(r) for r in topics.vocabulary(rows, min_df=1, size=4).collect()] == [("blue", 3, 2), ("blue whale", 2, 1), ("whale", 2, 1), ("bird", 1, 1)]
    assert [r["word"] for r in topics.vocabulary(rows).collect()] == ["blue"]
    one = topics.ctfidf(rows.withColumn("topic_id", F.lit(1)), ngrams=2, words=topics.vocabulary(rows), min_count=1).collect()
    assert [r["word"] for r in one] == ["blue"]
