"""Distinct counts where a sketch is only near: tens of thousands of values."""

from pyspark.sql import functions as F

from quire.operators import sketches


def test_counts_of_many_values_are_exact(spark):
    rows = spark.range(120_000).select(F.concat(F.lit("19"), (90 + F.col("id") % 4).cast("string")).alias("p"), F.concat(F.lit("v"), (F.col("id") % 50_000).cast("string")).alias("v"))
    odd = spark.createDataFrame([(None, "x"), ("1995", None), ("1994", "v0")], "p string, v string")
    every = rows.unionByName(odd)
    seen = [(r["p"], r["v"]) for r in every.collect() if r["p"] and r["v"]]
    want = {p: len({v for q, v in seen if q <= p}) for p in {p for p, _ in seen}}
    got = {r["period"]: r["distinct_values"] for r in sketches.exact_running(every, F.col("p"), "v").collect()}
    assert got == want
    for first, last in ((None, None), ("1991", "1992"), ("2001", None)):
        within = [v for p, v in seen if (first is None or p >= first) and (last is None or p <= last)]
        assert tuple(sketches.exact_between(every, F.col("p"), "v", first, last).first()) == (len(set(within)), len(within))


def test_author_queries_count_exactly(spark, tmp_path):
    from datetime import date

    from quire.plans import queries

    n = 60_000
    tables = {
        "nation": spark.createDataFrame([(1, "N")], "n_nationkey int, n_name string"),
        "customer": spark.createDataFrame([(1, 1)], "c_custkey long, c_nationkey int"),
        "part": spark.createDataFrame([(1, "B")], "p_partkey long, p_brand string"),
        "supplier": spark.range(n).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("s_name")),
        "orders": spark.createDataFrame([(y, 1, date(y, 5, 5)) for y in (1993, 1995, 1996)], "o_orderkey long, o_custkey long, o_orderdate date"),
        "lineitem": spark.range(n).select((F.lit(1993) + F.col("id") % 4).alias("l_orderkey"), F.lit(1).cast("long").alias("l_partkey"), F.col("id").alias("l_suppkey")),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["period"]: r["distinct_values"] for r in queries.author_sketches(spark, str(tmp_path)).collect()}
    assert got == {"1993": n // 4, "1995": n // 2, "1996": 3 * n // 4}
    assert tuple(queries.author_sketch_range(spark, str(tmp_path)).first()) == (n // 2, n // 2)
