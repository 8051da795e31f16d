"""Structured Streaming over new pages: the stateless stages of the batch plans, and windowed counts of events.

Batch and stream share the Column functions, so a page gives the same rows either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..operators import lexicon


def read_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def stream_paragraphs(pages: DataFrame) -> DataFrame:
    """page_id, para_no and clean text of each paragraph; no state."""
    return lexicon.paragraphs(pages).withColumn("content", text.clean_html_text(text.strip_tags(F.col("content"))))


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums of events by window and type; the watermark bounds the state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
