"""Paper-like views over the star-schema tables, and the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, which don't change; its schema is read from its files once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def papers_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One paper an order: date, the customer's nation as journal, its lines' suppliers as authors and brands as terms."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    lines = lines.join(t("supplier").select("s_suppkey", "s_name"), lines["l_suppkey"] == F.col("s_suppkey"), "left").join(t("part").select("p_partkey", "p_brand"), lines["l_partkey"] == F.col("p_partkey"), "left")
    lists = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("s_name")).alias("authors"), F.sort_array(F.collect_list("p_brand")).alias("mesh_terms"))
    nations = t("customer").select("c_custkey", "c_nationkey").join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    none = F.array().cast("array<string>")
    return (
        orders.join(lists, orders["o_orderkey"] == lists["l_orderkey"], "left")
        .join(nations, orders["o_custkey"] == nations["c_custkey"], "left")
        .select(
            F.col("o_orderkey").cast("string").alias("pmid"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("pub_date"),
            F.col("n_name").alias("journal"),
            F.coalesce("authors", none).alias("authors"),
            F.coalesce("mesh_terms", none).alias("mesh_terms"),
        )
    )


def papers_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """papers_meta without its arrays, for what needs dates and ids only: one table, two columns read."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("pmid"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("pub_date"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where a table has fewer files than there are cores, as one file may be one task whatever its size; a table of many files stays as it is read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def papers_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        F.col("doc_id").cast("string").alias("pmid"), F.lit("").alias("title"), F.col("text").alias("abstract"), none.alias("authors"), F.col("source").alias("journal"), F.lit("Unknown").alias("pub_date"), none.alias("mesh_terms")
    )


def paper_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("pmid"), "embedding", F.col("label").alias("topic_id"))


def conversation_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two papers a conversation of two turns or more: (pmid, text_content) of its first turns and of the others, as they come in order."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t")).filter(F.size("t") > 1)
    half = F.ceil(F.size("t") / 2).cast("int")
    part = lambda first, n: turns.select(F.col("conv_id").cast("string").alias("pmid"), F.array_join(F.transform(F.slice("t", first, n), lambda x: x["text"]), "\n").alias("text_content"))
    return part(F.lit(1), half), part(half + 1, F.size("t"))


def topic_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("pmid"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("topic_id"), F.col("o_orderdate").alias("date"))


def topic_papers_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic_papers with the topic of pending orders unknown."""
    own = table(spark, sf_dir, "orders")
    topic = F.when(F.col("o_orderstatus") == "P", -1).otherwise(F.left("o_orderpriority", F.lit(1)).cast("int"))
    return own.select(F.col("o_orderkey").cast("string").alias("pmid"), topic.alias("topic_id"), F.col("o_orderdate").alias("date"))


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points: balance in hundreds, nation."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.array(F.col("s_acctbal").cast("double") / 100, F.col("s_nationkey").cast("double")).alias("v"), F.lit(1).cast("long").alias("weight"))


def topic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("pmid"), F.col("event_type").alias("topic_id"), F.col("ts").alias("date"))


PAPERS_META = """
line_lists AS (
  SELECT l_orderkey, coalesce(list(s_name ORDER BY s_name) FILTER (WHERE s_name IS NOT NULL), []) AS authors,
         coalesce(list(p_brand ORDER BY p_brand) FILTER (WHERE p_brand IS NOT NULL), []) AS mesh_terms
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
), papers_meta AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS pmid, strftime(o_orderdate, '%Y-%m-%d') AS pub_date, n_name AS journal,
         coalesce(authors, []) AS authors, coalesce(mesh_terms, []) AS mesh_terms
  FROM orders LEFT JOIN line_lists ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
)"""

TOPIC_PAPERS = "topic_papers AS (SELECT CAST(o_orderkey AS VARCHAR) AS pmid, CAST(left(o_orderpriority, 1) AS INTEGER) AS topic_id, o_orderdate AS date FROM orders)"
TOPIC_OUTLIERS = "topic_outliers AS (SELECT CAST(o_orderkey AS VARCHAR) AS pmid, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE CAST(left(o_orderpriority, 1) AS INTEGER) END AS topic_id, o_orderdate AS date FROM orders)"
TOPIC_EVENTS = "topic_events AS (SELECT CAST(event_id AS VARCHAR) AS pmid, event_type AS topic_id, ts AS date FROM events)"
