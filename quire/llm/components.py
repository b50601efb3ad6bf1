"""Connected components of a link table, by alternating large and small stars.

Every round is two reductions to a minimum and two joins; each round's links are a written table, so no
lineage grows and no links or components reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    """Large star (both_ways): each node's larger neighbours go to its smallest.  Small star: smaller neighbours and the node do."""
    seen = links.select("u", "v")
    if both_ways:
        seen = seen.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    if both_ways:
        # links are stored as u > v, so the larger neighbour of v is u
        moved = links.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("low").alias("v"))
    else:
        moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
    return moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links (u long, v long) to (node long, component long): every linked node and the smallest node it reaches."""
    now = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    shape = None
    while True:  # every round shortens paths until nothing moves
        now = written(_star(_star(now, True), False), "stars")
        again = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.sum(F.expr("cast(v as decimal(38, 0))")).alias("s")).first()
        if again == shape:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        shape = again
