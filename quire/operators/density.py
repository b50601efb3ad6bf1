"""Density clusters: components of a mutual nearest-neighbour graph under falling density, the stable ones chosen, the rest outliers.

1. Equal vectors are one point with their number as weight, so a group of copies is no hot group.
2. ``nearest`` finds the exact k nearest other points of every point.  Space is cut into boxes by the medians of a bounded
   sample; a point looks in its own box first, then in the boxes that the ball of its distance so far reaches.
3. A point's core distance is that to its k-th neighbour, copies counted.  Two points that are among each other's k nearest are
   linked at the greatest of their distance and both core distances.
4. Under each of a falling series of thresholds (quantiles of the core distances) the links no longer than it make components;
   those of ``min_size`` rows or more are nodes of a tree, a node's parent being the component that holds it under the next
   threshold.  All thresholds go through one run of ``connected_components``.
5. A node's stability is its rows times the drop of density (1 / threshold) to its parent's level, plus its child's where it
   has one only: the cluster goes on.  From the leaves up a node is taken instead of its descendants if its stability is no less
   than what they add up to.  Rows in no node taken are outliers (-1).

Ties go to the smaller id; clusters are numbered by size, then least id.  Rows without a vector are outliers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.components import connected_components, meeting
from quire.storage import written

#: Rows that the boxes are cut by, points wanted in a box, boxes at most; beyond that boxes grow.
SAMPLE, BOX_POINTS, MOST_BOXES = 200_000, 2_000, 20_000
OUTLIER = -1


class Boxes:
    """A tree of median cuts; leaf boxes are numbered in order."""

    def __init__(self, sample: np.ndarray, leaves: int):
        dims = sample.shape[1]
        self.axis, self.cut, self.child, self.low, self.high, self.leaf = [], [], [], [], [], []
        self.leaves = 0

        def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, want: int) -> int:
            me = len(self.axis)
            for x, v in ((self.axis, 0), (self.cut, 0.0), (self.child, (-1, -1)), (self.low, low), (self.high, high), (self.leaf, -1)):
                x.append(v)
            axis = int(np.argmax(rows.max(axis=0) - rows.min(axis=0))) if len(rows) else 0
            cut = float(np.median(rows[:, axis])) if len(rows) else 0.0
            left = rows[:, axis] < cut if len(rows) else np.zeros(0, bool)
            if want < 2 or not left.any() or left.all():
                self.leaf[me], self.leaves = self.leaves, self.leaves + 1
                return me
            self.axis[me], self.cut[me] = axis, cut
            upper, lower = high.copy(), low.copy()
            upper[axis] = lower[axis] = cut
            self.child[me] = (grow(rows[left], low, upper, want // 2), grow(rows[~left], lower, high, want - want // 2))
            return me

        grow(sample, np.full(dims, -np.inf), np.full(dims, np.inf), leaves)
        self.axis, self.cut, self.child, self.leaf = np.array(self.axis), np.array(self.cut), np.array(self.child), np.array(self.leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.zeros(len(points), np.int64)
        while len(inner := np.flatnonzero(self.leaf[node] < 0)):
            at = node[inner]
            right = points[inner, self.axis[at]] >= self.cut[at]
            node[inner] = self.child[at, right.astype(int)]
        return self.leaf[node]

    def within(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the point, leaf) for every leaf that a point's closed ball touches."""
        who, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        out = []
        while len(who):
            gap = np.maximum(self.low[node] - points[who], points[who] - self.high[node]).clip(min=0)
            near = (gap**2).sum(axis=1) <= radius[who] ** 2 * (1 + 1e-12)
            who, node = who[near], node[near]
            done = self.leaf[node] >= 0
            out.append((who[done], self.leaf[node[done]]))
            who, node = np.repeat(who[~done], 2), self.child[node[~done]].reshape(-1)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _closest(ids: np.ndarray, points: np.ndarray, other_ids: np.ndarray, others: np.ndarray, weights: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest others of each point, a block of points at a time; exact distances of the candidates."""
    rank = np.unique(np.concatenate([ids, other_ids]), return_inverse=True)[1]  # in the order of the ids
    own, their = rank[: len(ids)], rank[len(ids) :]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    squares = (others**2).sum(axis=1)
    for i in range(0, len(points), 512):
        part, me = points[i : i + 512], own[i : i + 512]
        rough = (part**2).sum(axis=1)[:, None] + squares[None] - 2 * part @ others.T
        rough[me[:, None] == their[None]] = np.inf
        bound = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(others) > k else np.full(len(part), np.finfo(float).max)
        bound = np.minimum(bound, np.finfo(float).max)
        slack = 1e-9 * ((part**2).sum(axis=1) + squares.max(initial=0) + 1)  # of the rounding of rough
        who, what = np.nonzero(rough <= (bound + slack)[:, None])
        distance = np.sqrt(((part[who] - others[what]) ** 2).sum(axis=1))
        order = np.lexsort((their[what], distance, who))
        who, what, distance = who[order], what[order], distance[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < k
        found.append((who[keep] + i, what[keep], distance[keep]))
    who, what, distance = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"id": ids[who], "other": other_ids[what], "distance": distance, "weight": weights[what]})


def nearest(points: DataFrame, k: int, box_points: int = BOX_POINTS) -> DataFrame:
    """(id, other, distance, weight): the exact k nearest others of each of points (id string, v array<double>, weight long), ties by id; fewer where there are no more."""
    n = points.count()
    share = min(1.0, 1.5 * SAMPLE / max(1, n))
    sample = points.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))).orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").collect()
    if not sample:
        return points.sparkSession.createDataFrame([], "id string, other string, distance double, weight long")
    boxes = Boxes(np.array([r["v"] for r in sample]), min(MOST_BOXES, max(1, n // box_points)))
    schema = "id string, other string, distance double, weight long"

    @F.pandas_udf("int")
    def box(v: pd.Series) -> pd.Series:
        return pd.Series(boxes.of(_matrix(v)).astype("int32") if len(v) else [], dtype="int32")

    def own(part: pd.DataFrame) -> pd.DataFrame:
        ids, v = part["id"].to_numpy(), _matrix(part["v"])
        return _closest(ids, v, ids, v, part["weight"].to_numpy(), k)

    placed = written(points.withColumn("box", box("v")), "boxed")
    first = written(placed.groupBy("box").applyInPandas(own, schema), "near-in-box")
    radius = first.groupBy("id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("radius"))

    def reach(batches):
        for part in batches:
            v = _matrix(part["v"]) if len(part) else np.zeros((0, boxes.low.shape[1]))
            who, leaf = boxes.within(v, part["radius"].to_numpy())
            away = leaf != part["box"].to_numpy()[who]
            who, leaf = who[away], leaf[away]
            yield pd.DataFrame({"box": leaf.astype("int32"), "id": part["id"].to_numpy()[who], "v": part["v"].to_numpy()[who]})

    def there(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return _closest(asked["id"].to_numpy(), _matrix(asked["v"]), held["id"].to_numpy(), _matrix(held["v"]), held["weight"].to_numpy(), k)

    wide = placed.join(meeting(radius), "id", "left").fillna(float("inf"), ["radius"]).select("box", "id", "v", "radius")
    asked = wide.mapInPandas(reach, "box int, id string, v array<double>")
    second = asked.groupBy("box").cogroup(placed.groupBy("box")).applyInPandas(there, schema)
    best = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return first.unionByName(second).withColumn("place", best).filter(F.col("place") <= k).drop("place")


def core_distances(points: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(id, core): the distance to the k-th nearest row, a point's own copies and its neighbours' counted; null where there are fewer."""
    upto = F.sum("weight").over(Window.partitionBy("id").orderBy("distance", "other"))
    own = near.select("id", "distance", upto.alias("rows")).join(meeting(points.select("id", F.col("weight").alias("copies"))), "id")
    reached = own.filter(F.col("rows") + F.col("copies") - 1 >= k).groupBy("id").agg(F.min("distance").alias("core"))
    alone = F.when(F.col("weight") > k, F.lit(0.0)).otherwise(F.col("core"))
    return points.join(meeting(reached), "id", "left").select("id", alone.alias("core"))


def links(near: DataFrame, cores: DataFrame) -> DataFrame:
    """(a, b, length) of points that are among each other's nearest, a < b."""
    one = near.filter("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"), "distance")
    back = near.filter("id > other").select(F.col("other").alias("a"), F.col("id").alias("b"))
    core = lambda name: cores.select(F.col("id").alias(name), F.col("core").alias(f"core_{name}"))
    joined = one.join(meeting(back), ["a", "b"]).join(meeting(core("a")), "a").join(meeting(core("b")), "b")
    return joined.filter("core_a is not null and core_b is not null").select("a", "b", F.greatest("distance", "core_a", "core_b").alias("length"))


def thresholds(cores: DataFrame, levels: int) -> list[float]:
    """Quantiles of the core distances from the densest tenth to the ninth, ascending, without repeats and noughts."""
    steps = [0.1 + 0.8 * i / max(1, levels - 1) for i in range(levels)]
    found = cores.filter("core > 0").agg(F.percentile_approx("core", [float(s) for s in steps], 100_000).alias("t")).first()["t"] or []
    return sorted(set(found))


def cluster_tree(points: DataFrame, linked: DataFrame, cores: DataFrame, limits: list[float], min_size: int) -> tuple[DataFrame, DataFrame]:
    """(members, nodes): members (level, id, node) of components of min_size rows or more, nodes (level, node, parent, size); level 0 is the densest."""
    levels = F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(limits) - 1)), lambda i: F.element_at(F.lit(limits), i + 1) >= F.col("length")))
    alone = points.join(meeting(cores), "id").filter(F.col("core").isNotNull())
    selves = alone.select(F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(limits) - 1)), lambda i: F.element_at(F.lit(limits), i + 1) >= F.col("core"))).alias("level"), F.col("id").alias("a"), F.col("id").alias("b"))
    found = connected_components(linked.select(levels.alias("level"), "a", "b").unionByName(selves), ("level",))
    own = found.select("level", F.col("node").alias("id"), F.col("component").alias("node")).join(meeting(points.select("id", "weight")), "id")
    sizes = own.groupBy("level", "node").agg(F.sum("weight").alias("size")).filter(F.col("size") >= min_size)
    members = written(own.join(meeting(sizes.select("level", "node")), ["level", "node"]).select("level", "id", "node", "weight"), "members")
    above = members.select((F.col("level") - 1).alias("level"), F.col("id").alias("node"), F.col("node").alias("parent"))
    nodes = members.groupBy("level", "node").agg(F.sum("weight").alias("size")).join(meeting(above), ["level", "node"], "left")  # a node is named after one of its members
    return members, written(nodes, "nodes")


def chosen_nodes(nodes: DataFrame, limits: list[float]) -> DataFrame:
    """(level, node) of the stable clusters, none below another: from the densest level up, a node's stability against the best of its children."""
    below = None
    kept = []
    for level, limit in enumerate(limits):
        sparser = limits[level + 1] if level + 1 < len(limits) else limit if level else float("inf")
        drop = 1 / limit - 1 / sparser
        now = nodes.filter(F.col("level") == level).select("node", "parent", (F.col("size") * drop).alias("mass"))
        if below is not None:
            now = now.join(meeting(below), "node", "left")
            going_on = F.when(F.col("children") == 1, F.col("only")).otherwise(0.0)
            now = now.select("node", "parent", (F.col("mass") + F.coalesce(going_on, F.lit(0.0))).alias("own"), F.coalesce("best_below", F.lit(0.0)).alias("best_below"))
        else:
            now = now.select("node", "parent", F.col("mass").alias("own"), F.lit(0.0).alias("best_below"))
        now = written(now.withColumn("taken", (F.col("own") > 0) & (F.col("own") >= F.col("best_below"))), "tree-level")
        kept.append(now.select(F.lit(level).alias("level"), "node", "taken"))
        best = F.greatest("own", "best_below")
        below = now.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.max("own").alias("only"), F.sum(best).alias("best_below")).filter("node is not null")
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out.filter("taken").drop("taken")


def reduced(vectors: DataFrame, components: int | None, vector_col: str = "embedding") -> DataFrame:
    """(pmid, v array<double>): the vectors, or their principal components."""
    rows = vectors.filter(F.col(vector_col).isNotNull()).select("pmid", F.col(vector_col).cast("array<double>").alias("v"))
    if components is None:
        return rows
    data, one = rows.select("pmid", array_to_vector("v").alias("features")), rows.select(F.size("v")).first()
    if one is None:
        return rows
    return PCA(k=min(components, one[0]), inputCol="features", outputCol="less").fit(data).transform(data).select("pmid", vector_to_array("less").alias("v"))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place in an order, from 0 on: ranges are sorted apart, and only their sizes meet."""
    dealt = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    begin, before = 0, []
    for part, n in sorted(tuple(r) for r in dealt.groupBy("_part").count().collect()):
        before += [F.lit(part), F.lit(begin)]
        begin += n
    if not before:
        return rows.withColumn(name, F.lit(0))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn(name, (place + F.element_at(F.create_map(*before), F.col("_part"))).cast("int")).drop("_part")


def density_clusters(vectors: DataFrame, min_size: int = 10, neighbours: int | None = None, components: int | None = 5, levels: int = 8, limits: list[float] | None = None, box_points: int = BOX_POINTS, vector_col: str = "embedding") -> DataFrame:
    """(pmid, topic_id, topic_probability) of (pmid, embedding): stable density clusters from 0 on, the largest first, outliers -1.

    The probability of a row is its cluster's least core distance over its own; an outlier has none (0).  ``neighbours``: min_size where not given;
    ``limits``: the thresholds themselves."""
    k = neighbours or min_size
    rows = written(reduced(vectors, components, vector_col), "reduced")
    points = written(rows.groupBy("v").agg(F.min("pmid").alias("id"), F.count("*").alias("weight")), "points")
    near = written(nearest(points, k, box_points), "near")
    cores = written(core_distances(points, near, k), "cores")
    limits = thresholds(cores, levels) if limits is None else sorted(limits)
    none = vectors.select("pmid", F.lit(OUTLIER).alias("topic_id"), F.lit(0.0).alias("topic_probability"))
    if not limits:
        return none
    members, nodes = cluster_tree(points, links(near, cores), cores, limits, min_size)
    own = members.join(meeting(chosen_nodes(nodes, limits)), ["level", "node"])
    outermost = own.groupBy("id").agg(F.max_by(F.struct("level", "node"), "level").alias("c")).select("id", "c.level", "c.node")
    sized = outermost.join(meeting(points.select("id", "weight")), "id").join(meeting(cores), "id")
    clusters = sized.groupBy("level", "node").agg(F.sum("weight").alias("size"), F.min(F.when(F.col("core") > 0, F.col("core"))).alias("densest"))
    clusters = numbered(clusters, [F.desc("size"), F.col("node")], "topic_id")
    probability = F.when(F.col("core") > 0, F.coalesce(F.col("densest") / F.col("core"), F.lit(1.0))).otherwise(1.0)
    labelled = sized.join(meeting(clusters.select("level", "node", "topic_id", "densest")), ["level", "node"]).select("id", "topic_id", probability.alias("topic_probability"))
    by_row = rows.join(meeting(points.select("v", "id")), "v").select("pmid", "id").join(meeting(labelled), "id").select("pmid", "topic_id", "topic_probability")
    return vectors.select("pmid").join(meeting(by_row), "pmid", "left").select("pmid", F.coalesce("topic_id", F.lit(OUTLIER)).alias("topic_id"), F.coalesce("topic_probability", F.lit(0.0)).alias("topic_probability"))
