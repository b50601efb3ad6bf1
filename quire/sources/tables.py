"""JSON lines for interchange, Parquet inside; union of domains."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ready(spark: SparkSession, path: str) -> bool:
    """Whether a stage is there as a whole: a folder without the mark of a finished write is what a failed one left."""
    return _exists(spark, f"{path}/_SUCCESS")


def finish(spark: SparkSession, path: str) -> None:
    """Marks a folder of several writes, such as a model's, as finished."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True).close()


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A missing path is an empty table; a line that is no JSON raises; blank lines are skipped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def materialise(spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table at path; built and written first where it is missing or refresh is set."""
    if refresh or not ready(spark, path):
        write_parquet(build(), path)
    return spark.read.parquet(path)


def union_domains(parts: Sequence[DataFrame], dedup: bool = False) -> DataFrame:
    """All rows of all parts; with dedup the first part that has an id keeps it."""
    if not dedup:
        return reduce(DataFrame.unionByName, parts)
    marked = reduce(DataFrame.unionByName, [p.withColumn("_domain", F.lit(i)) for i, p in enumerate(parts)])
    return dedup_papers(marked, "_domain").drop("_domain")


def dedup_papers(papers: DataFrame, order: str, key: str = "pmid") -> DataFrame:
    """One row an id: that of the least ``order``; of equal ones the least row.  Rows without an id are papers of their own and all stay."""
    nameless = papers.filter(F.col(key).isNull())
    papers = papers.filter(F.col(key).isNotNull())
    rest = [c for c in papers.columns if c not in (order, key) and not isinstance(papers.schema[c].dataType, T.MapType)]
    first = Window.partitionBy(key).orderBy(order, *rest)
    return papers.withColumn("_row", F.row_number().over(first)).filter("_row = 1").drop("_row").unionByName(nameless)
