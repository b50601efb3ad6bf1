"""Distinct counts over any range of periods: exact ones from the rows, or estimates from one sketch a period, which unite without their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.storage import written

#: The sketch's size as a power of two; its relative error is about 1.04 / sqrt(2^SKETCH_BITS), and small counts are exact.
SKETCH_BITS = 16


def period_sketches(rows: DataFrame, period: Column, value: str) -> DataFrame:
    """(period, sketch, rows): a HyperLogLog sketch of the values of each period; rows without a period or value don't count.

    Sketches are made on the map side, so what is shuffled is their size times tasks and periods, however many values there are."""
    named = rows.select(period.alias("period"), F.col(value).alias("value")).filter("period is not null and value is not null")
    return named.groupBy("period").agg(F.hll_sketch_agg("value", F.lit(SKETCH_BITS)).alias("sketch"), F.count("*").alias("rows"))


def distinct_between(sketches: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """One row: about how many distinct values the periods from first to last hold (all without bounds), and how many rows; 0 for none."""
    within = F.lit(True)
    within = within if first is None else within & (F.col("period") >= first)
    within = within if last is None else within & (F.col("period") <= last)
    united = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.filter(within).agg(F.coalesce(united, F.lit(0)).alias("distinct_values"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def running_distinct(sketches: DataFrame) -> DataFrame:
    """(period, distinct_values): about how many distinct values all periods up to each hold; as many rows as periods."""
    upto = sketches.alias("a").join(sketches.select(F.col("period").alias("until")), F.col("period") <= F.col("until"))  # periods, not rows
    return upto.groupBy(F.col("until").alias("period")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))


def exact_between(rows: DataFrame, period: Column, value: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """What distinct_between estimates, counted: each value is shuffled once a task."""
    named = rows.select(period.alias("period"), F.col(value).alias("value")).filter("period is not null and value is not null")
    within = F.lit(True)
    within = within if first is None else within & (F.col("period") >= first)
    within = within if last is None else within & (F.col("period") <= last)
    each = named.filter(within).groupBy("value").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("distinct_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def exact_running(rows: DataFrame, period: Column, value: str) -> DataFrame:
    """What running_distinct estimates, counted: a value counts from its first period on, so only the periods' numbers of new values are added up."""
    named = rows.select(period.alias("period"), F.col(value).alias("value")).filter("period is not null and value is not null")
    pairs = written(named.distinct(), "period-values")  # read twice; the rows once
    new = pairs.groupBy("value").agg(F.min("period").alias("period"), F.lit(1).cast("long").alias("n")).select("period", "n")
    each = new.unionByName(pairs.select("period", F.lit(0).cast("long").alias("n"))).groupBy("period").agg(F.sum("n").alias("n"))
    upto = each.alias("a").join(each.select(F.col("period").alias("until")), F.col("period") <= F.col("until"))  # periods, not rows
    return upto.groupBy(F.col("until").alias("period")).agg(F.sum("n").alias("distinct_values"))
