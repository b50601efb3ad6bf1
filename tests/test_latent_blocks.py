"""Blocks of latent vectors: bounded, and nothing is left out."""

import numpy as np

from quire.operators import latent


def test_blocks_are_bounded_and_whole():
    rng = np.random.default_rng(2)
    sizes = np.append(rng.integers(0, 40, 400), latent.ENTRIES + 5)
    offsets = np.append(0, np.cumsum(sizes))
    places, values = rng.integers(0, 50, offsets[-1]), rng.random(offsets[-1])
    want = np.zeros((len(sizes), 50))
    np.add.at(want, (np.repeat(np.arange(len(sizes)), sizes), places), values)
    got = np.zeros_like(want)
    for a, b, terms, block in latent._blocks(places, values, offsets):
        assert b - a <= latent.ROWS and (b - a == 1 or offsets[b] - offsets[a] <= latent.ENTRIES)
        got[a:b, terms] = block
    assert np.allclose(got, want)


def test_ranks_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(latent, "ASKED", 3)
    monkeypatch.setattr(latent, "HELD", 5)
    monkeypatch.setattr(latent, "PRODUCT", 2)
    v = np.random.default_rng(4).normal(size=(60, 6))
    held = spark.createDataFrame([(str(i), [float(x) for x in p]) for i, p in enumerate(v)], "pmid string, embedding array<double>")
    asked = spark.createDataFrame([(str(i), [float(x) for x in v[i] + 0.7 * v[(i + 1) % 60]]) for i in range(0, 60, 4)], "pmid string, embedding array<double>")
    score = np.array([[(v[i] + 0.7 * v[(i + 1) % 60]) @ w for w in v] for i in range(0, 60, 4)])
    rank = np.array([(s >= s[i] - 1e-12).sum() for s, i in zip(score, range(0, 60, 4), strict=True)])
    got = latent.rank_quality(asked, held, 2).first()
    assert got["queries"] == 15 and np.isclose(got["recall"], (rank <= 2).mean()) and np.isclose(got["reciprocal_rank"], (1 / rank).mean())
