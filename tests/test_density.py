"""Density clusters against brute force, planted clusters with noise, copies and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import density
from quire.operators.components import connected_components

POINTS = "id string, v array<double>, weight long"


def points(spark, v, weights=None):
    return spark.createDataFrame([(f"{i:04}", [float(x) for x in p], int(weights[i]) if weights is not None else 1) for i, p in enumerate(v)], POINTS).repartition(3)


def all_distances(v):
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return d


def by_definition(v, weights, k, limits, min_size):
    """Labels of the points: sets of rows, -1 as None."""
    n, d = len(v), all_distances(v)
    order = np.lexsort((np.broadcast_to(np.arange(n), (n, n)), d))[:, : min(k, n - 1)]
    core = np.full(n, np.inf)
    for i in range(n):
        rows = weights[i] - 1
        if rows >= k:
            core[i] = 0
        for j in order[i]:
            rows += weights[j]
            if rows >= k and core[i] == np.inf:
                core[i] = d[i, j]
    edges = [(max(d[i, j], core[i], core[j]), i, j) for i in range(n) for j in order[i] if i < j and i in order[j]]
    levels = []
    for t in limits:
        group = {i: i for i in range(n) if core[i] <= t}

        def root(x):
            while group[x] != x:
                x = group[x]
            return x

        for length, i, j in edges:
            if length <= t:
                a, b = sorted((root(i), root(j)))
                group[b] = a
        sets = {}
        for i in group:
            sets.setdefault(root(i), set()).add(i)
        levels.append([s for s in sets.values() if sum(weights[i] for i in s) >= min_size])
    own, best, taken = {}, {}, []
    for level, sets in enumerate(levels):
        last = level + 1 == len(limits)
        drop = (1 / limits[level] if level == 0 else 0) if last else 1 / limits[level] - 1 / limits[level + 1]
        for s in sets:
            kids = [c for c in levels[level - 1] if c <= s] if level else []
            key = (level, min(s))
            o = sum(weights[i] for i in s) * drop + (own[level - 1, min(kids[0])] if len(kids) == 1 else 0)
            below = sum(best[level - 1, min(c)] for c in kids)
            own[key], best[key] = o, max(o, below)
            if o > 0 and o >= below:
                taken.append((level, s))
    label = [None] * n
    for _, s in sorted(taken, key=lambda x: x[0]):
        for i in s:
            label[i] = frozenset(s)
    return label, core


def groups(labels):
    out = {}
    for row, t in labels.items():
        out.setdefault(t, set()).add(row)
    return out


@pytest.mark.parametrize("seed, dims, k", [(0, 2, 4), (1, 3, 6), (2, 5, 3)])
def test_nearest_is_exact(spark, seed, dims, k):
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.normal(size=(300, dims)), rng.integers(0, 3, (20, dims)) * 1.0 + np.arange(20)[:, None] * 10])
    got = {}
    for r in density.nearest(points(spark, v), k, box_points=25).collect():
        got.setdefault(int(r["id"]), []).append((r["distance"], int(r["other"])))
    d = all_distances(v)
    for i in range(len(v)):
        near = np.lexsort((np.arange(len(v)), d[i]))[:k]
        assert [j for _, j in sorted(got[i])] == near.tolist() and np.allclose([x for x, _ in sorted(got[i])], d[i, near])


def test_nearest_of_few(spark):
    got = density.nearest(points(spark, np.array([[0.0], [1.0], [5.0]])), 4).orderBy("id", "distance").collect()
    assert [(r["id"], r["other"], r["distance"]) for r in got] == [("0000", "0001", 1.0), ("0000", "0002", 5.0), ("0001", "0000", 1.0), ("0001", "0002", 4.0), ("0002", "0001", 4.0), ("0002", "0000", 5.0)]
    assert density.nearest(points(spark, np.array([[0.0]])), 4).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_clusters_by_definition(spark, seed):
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.normal(size=(40, 2)) * 0.2 + c for c in ((0, 0), (1.4, 0), (6, 6))] + [rng.uniform(-3, 9, (25, 2))])
    copies = rng.integers(0, len(v), 12)
    rows = [(f"{i:04}", [float(x) for x in p]) for i, p in enumerate(v)] + [(f"{len(v) + n:04}", [float(x) for x in v[i]]) for n, i in enumerate(copies)]
    weights = 1 + np.bincount(copies, minlength=len(v))
    _, core = by_definition(v, weights, 5, [1.0], 8)
    limits = sorted(float(np.quantile(core[core > 0], q)) for q in (0.2, 0.5, 0.7, 0.85))
    label, _ = by_definition(v, weights, 5, limits, 8)
    table = spark.createDataFrame(rows, "pmid string, embedding array<double>").repartition(4)
    got = density.density_clusters(table, 8, 5, components=None, limits=limits, box_points=20).collect()
    found = {r["pmid"]: r["topic_id"] for r in got}
    assert len(got) == len(rows) and all(found[f"{len(v) + n:04}"] == found[f"{i:04}"] for n, i in enumerate(copies))
    mine = groups({int(p): t for p, t in found.items() if int(p) < len(v)})
    want = groups(dict(enumerate(label)))
    assert mine.pop(-1) == want.pop(None)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
    sizes = [sum(1 for t in found.values() if t == i) for i in range(len(mine))]
    assert sizes == sorted(sizes, reverse=True) and set(found.values()) == {-1, *range(len(mine))}
    assert all((r["topic_probability"] == 0) == (r["topic_id"] == -1) and 0 <= r["topic_probability"] <= 1 for r in got)


def test_planted_clusters_in_many_dimensions(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(4, 40)) * 4
    v = np.concatenate([c + rng.normal(size=(60, 40)) * 0.3 for c in centres] + [rng.normal(size=(60, 40)) * 6])
    table = spark.createDataFrame([(str(i), [float(x) for x in p]) for i, p in enumerate(v)], "pmid string, embedding array<double>")
    found = {int(r["pmid"]): r["topic_id"] for r in density.density_clusters(table, 15).collect()}
    own = [[found[i] for i in range(c * 60, c * 60 + 60)] for c in range(4)]
    main = [max(set(x), key=x.count) for x in own]
    assert len(set(main)) == 4 and -1 not in main
    assert all(x.count(m) >= 55 for x, m in zip(own, main, strict=True))
    assert sum(found[i] == -1 for i in range(240, 300)) >= 45


def test_odd_rows(spark):
    """Rows without a vector are outliers; a group of copies is a cluster; clashing names; too few rows; an empty table."""
    rows = [(f"c{i}", [1.0, 2.0]) for i in range(30)] + [(f"x{i}", [float(10 * i), 50.0]) for i in range(5)] + [("n", None)]
    table = spark.createDataFrame(rows, "pmid string, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("topic_id", F.lit(5))
    found = {r["pmid"]: r["topic_id"] for r in density.density_clusters(table, 10, 5, components=None, limits=[1.0, 2.0]).collect()}
    assert len(found) == 36 and {p for p, t in found.items() if t == 0} == {f"c{i}" for i in range(30)} and {t for t in found.values()} == {0, -1}
    assert {r["topic_id"] for r in density.density_clusters(table.limit(2)).collect()} == {-1}
    assert density.density_clusters(table.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, str(a), str(b)) for k in (0, 1) for a, b in [(i, i + 1) for i in range(100, 180) if not (k and i == 140)] + [(500, 500)]]
    found = connected_components(spark.createDataFrame(edges, "k int, a string, b string"), ("k",)).collect()
    assert {r["component"] for r in found if r["k"] == 0} == {"100", "500"}
    assert {r["component"] for r in found if r["k"] == 1} == {"100", "141", "500"} and len(found) == 2 * 82
