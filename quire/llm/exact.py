"""Links of similar shingle sets within groups of candidates, verified on whole sets.

A group is worked on in cells of at most two blocks of about GROUP members, so none lands whole in a task, and
a cell gives a spanning forest of its links, not its pairs.  In a group of more than GROUP members one, that
nearest to the bits that most of them have, is compared with the others first; then only those that it does not
reach (the rest) are compared, with each other and with those reached.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pairs, written

GROUP = 256
#: Groups of up to so many members are compared pair by pair.
FEW = 6
#: Ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Groups with over a HOT-th of all candidates, under HOT of them, are joined by broadcast.
HOT = 1_000
COLUMNS = 4_096


def similar_pairs(sets: list[np.ndarray], split: int, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of similar sets, i before ``split`` and j from it on; i < j in one block if ``split`` is 0."""
    n = np.array(list(map(len, sets)))
    shared = np.zeros((len(sets), len(sets)), np.float32)
    if len(sets) <= FEW:
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                shared[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        _, number, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        both = held > 1  # what one set has alone is not shared
        owner, column = np.repeat(np.arange(len(sets)), n)[both[number]], (np.cumsum(both) - 1)[number[both[number]]]
        for first in range(0, int(both.sum()), COLUMNS):
            own = (column >= first) & (column < first + COLUMNS)
            has = np.zeros((len(sets), min(COLUMNS, int(both.sum()) - first)), np.float32)
            has[owner[own], column[own] - first] = 1
            shared += has @ has.T
    above, below = least
    similar = shared.astype(np.int64) * (above + below) >= above * (n[:, None] + n[None, :])
    i, j = np.nonzero(np.triu(similar, 1))
    if split:
        cross = (i < split) & (j >= split)
        i, j = i[cross], j[cross]
    return i, j


def _sets(hashes: Callable[[str], np.ndarray]):
    """(doc_id, text) to (node, its sorted set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        nodes, sets, held = [], [], 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "hashes"])
            nodes.clear(), sets.clear()
            return out

        for _, text in pairs(batches):
            own = np.unique(hashes(text))
            nodes.append(xxh3_64_intdigest(own.tobytes()))
            sets.append(own)
            held += len(own)
            if held >= 200_000:
                yield flush()
                held = 0
        yield flush()

    return run


def _cells(least: tuple[int, int]):
    """Rows (component, a, b, block, node, hashes) sorted by cell (component, a, b), then block, to links."""
    from quire.llm.simhash import forest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, sets, blocks, u, v = None, [], [], [], [], []

        def work() -> None:
            if len(sets) > 1:
                i, j = similar_pairs(sets, 0 if held[1] == held[2] else int(np.searchsorted(blocks, held[2])), least)
                if len(i):
                    own = np.array(nodes, np.int64)
                    a, b = forest(own[i], own[j])
                    u.append(a)
                    v.append(b)
            nodes.clear(), sets.clear(), blocks.clear()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (u, v)], names=["u", "v"])
            u.clear(), v.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for *cell, block, node, own in zip(*(part.column(c).to_pylist() for c in ("component", "a", "b", "block", "node")), part.column("hashes"), strict=True):
                    if cell != held:
                        work()
                        held = cell
                    nodes.append(node)
                    blocks.append(block)
                    sets.append(own.values.to_numpy(zero_copy_only=False).view(np.uint64))
            yield flush()
        work()
        yield flush()

    return run


def _of_groups(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """rows with the columns of their group (component, n, ...); no group lands whole in a task."""
    hot = F.col("n") > total / HOT
    met = rows.join(F.broadcast(groups.filter(hot).withColumn("hot", F.lit(True))), "component", "left")
    cold = met.filter("hot is null").select(*rows.columns).join(groups.filter(~hot), "component")
    return met.filter("hot").drop("hot").unionByName(cold)


def exact_links(groups: DataFrame, classes: DataFrame, plain: DataFrame, hashes: Callable[[str], np.ndarray], least: tuple[int, int]) -> DataFrame:
    """groups (node, component), classes (node, least, fingerprint), plain (doc_id, text) to links (u, v): within each group they have the components of all its similar pairs."""
    members = written(groups.join(classes.select("node", "least", "fingerprint"), "node"), "candidates")
    holders = members.select("least").distinct()
    total = members.count()
    if total <= BROADCAST_IDS:
        holders = F.broadcast(holders)
    texts = plain.join(holders, plain["doc_id"].eqNullSafe(holders["least"]), "left_semi")
    sets = texts.mapInArrow(_sets(hashes), "node long, hashes array<bigint>").join(members.drop("least"), "node").dropDuplicates(["node"])
    sets = written(sets, "sets")

    sizes = written(members.groupBy("component").agg(F.count("*").alias("n")), "group-sizes")
    large = sizes.filter(F.col("n") > GROUP).withColumn("parts", F.ceil(F.col("n") / GROUP).cast("int"))
    spreadout = _of_groups(sets, large, total)
    ones = spreadout.groupBy("component", "n", "parts").agg(*(F.sum(F.shiftrightunsigned("fingerprint", i).bitwiseAND(F.lit(1))).alias(f"bit{i}") for i in range(64)))
    most = reduce(lambda x, y: x.bitwiseOR(y), (F.when(2 * F.col(f"bit{i}") > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(64)))
    middle = ones.select("component", "n", most.alias("most"))
    place = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pivot = _of_groups(spreadout.drop("n"), middle, total).groupBy("component", "parts").agg(F.min(F.struct(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("most"))), F.col("node").alias("node"))).alias("nearest"))
    pivot = pivot.select("component", F.col("nearest.node").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pivot = pivot.join(sets.select(F.col("node").alias("pivot"), F.col("hashes").alias("others")), "pivot")
    above, below = least
    shared = F.size(F.array_intersect("hashes", "others"))
    star = spreadout.withColumn("part", place).join(pivot, ["component", "part"]).filter((F.col("node") != F.col("pivot")) & (shared * (above + below) >= above * (F.size("hashes") + F.size("others"))))
    star = written(star.select(F.col("node").alias("u"), F.col("pivot").alias("v")), "star-links")

    reached = star.select(F.col("u").alias("node")).unionByName(star.select(F.col("v").alias("node")).distinct()).withColumn("reached", F.lit(True))
    marked = members.select("node", "component").join(reached, "node", "left").select("node", "component", F.coalesce("reached", F.lit(False)).alias("reached"))
    counts = marked.groupBy("component").agg(F.count_if(~F.col("reached")).alias("rest"), F.count_if("reached").alias("star")).filter("rest > 0 and rest + star > 1")
    blocks = counts.select("component", (F.col("rest") + F.col("star")).alias("n"), *(F.ceil(F.col(c) / GROUP).cast("int").alias(c) for c in ("rest", "star")))
    dealt = _of_groups(marked, blocks, total).withColumn("block", F.when(F.col("reached"), F.col("rest") + F.pmod(F.xxhash64("node"), F.col("star"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int"))
    upto = F.when(F.col("reached"), F.col("rest")).otherwise(F.col("rest") + F.col("star"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), upto - 1)))
    cells = cells.select("component", "node", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    ordered = cells.join(sets.select("node", "hashes"), "node").repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "block", "node")
    return star.unionByName(ordered.mapInArrow(_cells(least), "u long, v long"))
