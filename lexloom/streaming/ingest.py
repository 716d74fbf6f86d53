"""Streaming ingest of chunk files: each row once, whatever is delivered again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_chunks(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def ingest(stream: DataFrame, table: str, checkpoint: str, key: str = "chunk_id") -> StreamingQuery:
    """Appends rows with keys that the stream hasn't had yet. Which it had is the stream's
    state, kept by key beside the checkpoint, so no batch looks through the table; and a batch
    that is run again after a failure writes its own folder again, so nothing is there twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    new = stream.where(F.col(key).isNotNull()).dropDuplicates([key])
    return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def channel_windows(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Trace events a channel and window, late ones within the watermark counted."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "channel")
    return w.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") != "success").alias("failures"), F.sum("latency").alias("latency")).select("window.start", "channel", "events", "failures", "latency")
