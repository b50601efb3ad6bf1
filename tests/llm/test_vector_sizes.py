"""Vector search on vectors of very large and very small finite components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ann


@pytest.mark.parametrize("size", [1e-140, 1e-25, 1.0, 1e20, 1e37, 1e150])
def test_recall_at_any_size(spark, size):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(600, 24)) * size / 5
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(rows, F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert len(got) == 30 and all(len(x) == 10 for x in got.values())
    hits = 0
    for q, found in got.items():
        exact = (v / size) @ (v[q] / size)
        exact[q] = -np.inf
        hits += len({i for _, i, _ in found} & set(np.argsort(-exact)[:10].tolist()))
        if size < 1e150:
            assert all(np.isclose(s, float(v[i] @ v[q]), rtol=1e-9, atol=1e-9 * size**2) for _, i, s in found)
    assert hits >= 0.9 * 300


def test_sizes_far_apart(spark):
    """A few vectors are far larger than the rest; every query still gets its neighbours."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 16))
    v[:5] *= 1e12
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(rows, F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, found in got.items():
        exact = v @ v[q]
        exact[q] = -np.inf
        hits += len(found & set(np.argsort(-exact)[:10].tolist()))
    assert len(got) == 20 and hits >= 0.9 * 200
