"""Documents as a stream: the stage functions over arriving files, and counts over event time with late rows. An extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.clean import clean_source_text
from docspark.operators.segments import explode_segments


def document_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def segment_stream(documents: DataFrame, key: str = "doc_id", text_col: str = "raw_text") -> DataFrame:
    """Segments of arriving documents: stateless, so the batch operators hold as they are."""
    return explode_segments(documents.withColumn("__clean", clean_source_text(F.col(text_col))), key, "__clean")


def arrivals(documents: DataFrame, time_col: str = "fetched_at", late: str = "2 days", window: str = "1 day") -> DataFrame:
    """Documents and characters per window of event time; rows later than the watermark are left out."""
    return documents.withWatermark(time_col, late).groupBy(F.window(time_col, window)).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce(F.length("raw_text"), F.lit(0))).alias("chars")).select("window.start", "window.end", "documents", "chars")


def run_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]):
    """Each micro-batch through a batch function, once, until the files that are there have been read."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
