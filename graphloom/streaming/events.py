"""Structured Streaming over triples and events: an extension, since all batch inputs are read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.readers import TRIPLE

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and sum of values in each window and type; state goes once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("events"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events"))


def triple_stream(spark: SparkSession, path: str) -> DataFrame:
    """New triples as they land; lines that can't be read are left out."""
    return spark.readStream.schema(TRIPLE).option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null and length(head_text) > 0 and length(tail_text) > 0").drop("_bad")


def edge_counts(triples: DataFrame) -> DataFrame:
    """Running edges of a stream of triples, in update mode."""
    return triples.groupBy("head_type", "relation", "tail_type", "head_text", "tail_text").agg(F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("weight"))
