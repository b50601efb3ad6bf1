"""How topics lie to each other: merges of their centres, and their places on a plane.  There are as many centres as topics, so both are small tables that the driver makes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.topics import topic_centres


def merge_table(centres: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int, float, int]]:
    """(step, left, right, distance, size): the two nearest groups become group n + step, until one is left.

    Distance is 1 less the cosine; that of groups is the mean over their pairs of rows, by the sizes of their topics.  Ties go to the smaller numbers."""
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    unit = centres / np.where(norm > 0, norm, 1.0)
    n = len(unit)
    far = np.full((2 * n, 2 * n), np.inf)
    far[:n, :n] = np.round(1 - unit @ unit.T, 12)
    size = np.append(np.asarray(sizes, float), np.zeros(n))
    open_ = np.arange(2 * n) < n
    out = []
    for step in range(n - 1):
        live = np.flatnonzero(open_)
        part = far[np.ix_(live, live)]
        part[np.tril_indices(len(live))] = np.inf
        left, right = (int(live[i]) for i in np.unravel_index(part.argmin(), part.shape))
        new = n + step
        others = live[(live != left) & (live != right)]
        mean = (size[left] * far[left, others] + size[right] * far[right, others]) / (size[left] + size[right])
        far[new, others] = far[others, new] = mean
        size[new] = size[left] + size[right]
        out.append((step, left, right, float(far[left, right]), int(size[new])))
        open_[[left, right]], open_[new] = False, True
    return out


def plane(centres: np.ndarray) -> np.ndarray:
    """Principal coordinates of the centres, two columns; each axis points to its largest entry."""
    middle = centres - centres.mean(axis=0) if len(centres) else centres
    if not len(middle):
        return np.zeros((0, 2))
    u, s, _ = np.linalg.svd(middle, full_matrices=False)
    out = np.zeros((len(middle), 2))
    k = min(2, len(s))
    out[:, :k] = u[:, :k] * s[:k]
    sign = np.sign(out[np.abs(out).argmax(axis=0), np.arange(2)])
    return out * np.where(sign == 0, 1, sign)


def _topics(vectors: DataFrame, assigned: DataFrame, outlier: int) -> tuple[list, np.ndarray, np.ndarray]:
    own = assigned.filter(F.col("topic_id") != outlier)
    sizes = {r["topic_id"]: r["count"] for r in own.groupBy("topic_id").count().collect()}  # a row a topic
    rows = topic_centres(vectors.select("pmid", "embedding"), own).orderBy("topic_id").collect()
    return [r["topic_id"] for r in rows], np.array([r["centre"] for r in rows] or np.zeros((0, 1)), float), np.array([sizes[r["topic_id"]] for r in rows])


def topic_hierarchy(vectors: DataFrame, assigned: DataFrame, outlier: int = -1) -> DataFrame:
    """(step, left, right, distance, size, topics): merges of topics; left and right name the topics that their groups begin with, topics all of the new group."""
    ids, centres, sizes = _topics(vectors, assigned, outlier)
    groups = {i: [t] for i, t in enumerate(ids)}
    rows = []
    for step, left, right, distance, size in merge_table(centres, sizes):
        groups[len(ids) + step] = sorted(groups[left] + groups[right])
        rows.append((step, groups[left][0], groups[right][0], distance, size, groups[len(ids) + step]))
    return vectors.sparkSession.createDataFrame(rows, "step int, left int, right int, distance double, size long, topics array<int>")


def topic_map(vectors: DataFrame, assigned: DataFrame, outlier: int = -1) -> DataFrame:
    """(topic_id, x, y, size) for a map of topics."""
    ids, centres, sizes = _topics(vectors, assigned, outlier)
    rows = [(int(t), float(x), float(y), int(n)) for t, (x, y), n in zip(ids, plane(centres), sizes, strict=True)]
    return vectors.sparkSession.createDataFrame(rows, "topic_id int, x double, y double, size long")
