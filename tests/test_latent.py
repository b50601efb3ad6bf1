"""Latent vectors against NumPy's decomposition, synonyms that never meet, odd rows, keeping."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.operators import latent, search
from quire.plans import queries

TYPE = "pmid string, text_content string"


def texts(spark, rows):
    return spark.createDataFrame(rows, TYPE)


@pytest.fixture(scope="module")
def themed():
    """Four themes; each has a shared middle and two dialects whose words never meet in a text."""
    rng = np.random.default_rng(1)
    rows, kind = [], []
    for i in range(240):
        theme, dialect = i % 4, i // 4 % 2
        own = [f"t{theme}d{dialect}w{j}" for j in rng.integers(0, 8, 8)]
        shared = [f"t{theme}s{j}" for j in rng.integers(0, 10, 6)]
        rows.append((str(i), " ".join(own + shared)))
        kind.append((theme, dialect))
    return rows, kind


def test_directions_are_numpys(spark):
    rng = np.random.default_rng(0)
    dense = rng.normal(size=(120, 30)) @ np.diag(0.8 ** np.arange(30)) * (rng.random((120, 30)) < 0.5)
    rows = [(np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for r in dense]
    matrix = spark.createDataFrame([*rows, ([], [])], "places array<int>, values array<double>").repartition(5)
    basis = rng.normal(size=(30, 7))
    assert np.allclose(latent.gram_times(matrix, basis), dense.T @ dense @ basis)
    got, values = latent.leading_directions(matrix, 30, 6, passes=12)
    _, s, vt = np.linalg.svd(dense)
    assert np.allclose(values, s[:6], rtol=1e-6)
    assert np.allclose(np.abs(np.sum(got * vt[:6].T, axis=0)), 1, atol=1e-4)
    assert (got[np.abs(got).argmax(axis=0), np.arange(6)] > 0).all()


def test_synonyms_meet_and_words_have_vectors(spark, themed):
    rows, kind = themed
    papers = texts(spark, rows)
    config = EngineConfig(latent_dim=4)
    model = latent.LatentEmbedder(config).fit(papers)
    own = {r["pmid"]: np.array(r["embedding"], float) for r in model.embed(papers).collect()}
    v = np.array([own[str(i)] for i in range(len(rows))])
    near = np.argsort(-(v @ v.T - 9 * np.eye(len(v))), axis=1)[:, :10]
    assert np.mean([kind[j][0] == kind[i][0] for i in range(len(rows)) for j in near[i]]) > 0.97
    assert np.mean([kind[j][1] != kind[i][1] for i in range(len(rows)) for j in near[i]]) > 0.2
    words = {r["word"]: np.array(r["embedding"], float) for r in model.word_vectors(spark).collect()}
    assert words["t1d0w3"] @ words["t1d1w3"] > 0.8 > 0.2 > abs(words["t1d0w3"] @ words["t2d0w3"])
    assert np.allclose(model.embed_text(spark, "t1d0w3"), words["t1d0w3"], atol=1e-6)


def test_rank_quality_against_the_hashed_default(spark, themed):
    """One dialect asks for texts of the other: hashed words share nothing but the middle."""
    rows, _ = themed
    asked = texts(spark, [(p, " ".join(w for w in t.split() if "d" in w)) for p, t in rows[:40]])
    held = texts(spark, [(p, " ".join(w for w in t.split() if "s" in w)) for p, t in rows])
    scores = []
    for model in (search.Embedder(), latent.LatentEmbedder(EngineConfig(latent_dim=4))):
        model.fit(texts(spark, rows))
        scores.append(latent.rank_quality(model.embed(asked), model.embed(held), 60).first())
    assert scores[0]["queries"] == scores[1]["queries"] == 40
    assert scores[1]["recall"] > 0.9 > scores[0]["recall"]


def test_rank_quality_by_hand(spark):
    held = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.6, 0.8]), ("d", [0.0, 1.0])], "pmid string, embedding array<double>")
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("x", [1.0, 0.0])], "pmid string, embedding array<double>")
    assert tuple(latent.rank_quality(asked, held, 2).first()) == (2, 0.5, (1 + 1 / 4) / 2)  # b ties with d
    assert latent.rank_quality(asked.limit(0), held).first()["queries"] == 0


def test_odd_rows_and_keeping(spark, tmp_path):
    papers = texts(spark, [("1", "blue whale blue sea"), ("2", "blue whale"), ("3", ""), ("4", None), ("5", "zz yy"), ("6", "sea " * 30_000), ("6", "sea")]).withColumn("row", F.lit(1))
    model = latent.LatentEmbedder(EngineConfig(latent_dim=8)).fit(papers)
    assert sorted(model.terms) == ["blue", "sea", "whale"]
    got = {(r["pmid"], tuple(np.round(r["embedding"], 5))) for r in model.embed(papers).collect()}
    assert all(len(v) == 8 for _, v in got) and ("5", (0.0,) * 8) in got
    assert len({v for p, v in got if p == "6"}) == 1
    model.save(spark, str(tmp_path / "m"))
    again = latent.LatentEmbedder.load(spark, str(tmp_path / "m"), EngineConfig(latent_dim=8))
    assert np.allclose(again.embed_text(spark, "blue sea"), model.embed_text(spark, "blue sea"))
    none = latent.LatentEmbedder().fit(papers.limit(0))
    assert none.embed(papers.limit(0)).count() == 0 and none.embed_text(spark, "blue") == [0.0] * 64


def test_conversations_are_found_no_worse_than_by_hashed_words(spark):
    got = {r["vectors"]: r for r in queries.latent_quality(spark, "/root/testdata/sf0.01").collect()}
    assert got["latent"]["queries"] == got["hashed"]["queries"] > 0
    assert got["latent"]["reciprocal_rank"] >= got["hashed"]["reciprocal_rank"]
