"""Streams beside the batch engine: an index kept up to date, and repeated lines counted over time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import index as I
from folioscan.operators.ingest import CHUNK


def chunk_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Chunks from JSON lines that are added to a folder."""
    return spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", files).json(path)


def keep_postings(chunks: DataFrame, path: str, checkpoint: str):
    """Writes the postings of new chunks, a folder for each batch; a batch that is repeated replaces its own folder.

    A chunk counts once, however often and in however many batches it is sent.
    """

    def write(batch: DataFrame, number: int) -> None:
        own = batch.dropDuplicates(["id"]).select(F.col("id").alias("chunk_id"), "text")
        try:
            held = batch.sparkSession.read.parquet(path).where(F.col("batch") != number)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            own = own.join(held.select("chunk_id").distinct(), "chunk_id", "left_anti")
        I.postings(own).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def line_counts(lines: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Masked lines (ts, text) counted in windows of time; rows later than the watermark are left out."""
    masked = lines.withWatermark("ts", late).select("ts", T.mask_line(F.col("text")).alias("masked"))
    return masked.groupBy(F.window("ts", window), "masked").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users (ts, user_id): events that follow one another within the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
