"""Continuous ingest of landed JSON lines, and windowed counts over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.config import EngineConfig
from quire.operators.prepare import process, validate
from quire.schemas import RAW_PAPER


def paper_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Raw papers with their arrival time, one an id within a day of it."""
    schema = T.StructType([*RAW_PAPER.fields, T.StructField("arrived", T.TimestampType())])
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return rows.withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(["pmid"])


def processed_stream(papers: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    return process(validate(papers, config), config)


def start_ingest(stream: DataFrame, out: str, checkpoint: str):
    """Appends processed papers to Parquet, each once."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Topic counts in tumbling windows; works on streams and on tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("topic_id")).agg(F.count("*").alias("count")).select("topic_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")
