"""Incremental ingest with Structured Streaming; its checkpoint stands for a status column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlode.config import Settings
from paperlode.functions.columns import file_id
from paperlode.operators.chunks import ChunkSizes, chunk_documents
from paperlode.sources.files import OWN_FOLDER, kind_of, map_files

BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_documents(spark: SparkSession, folder: str, settings: Settings) -> DataFrame:
    """Documents of files as they come; a file that can't be read is a row with its error."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(folder)
    files = files.filter(~F.col("path").contains(f"/{OWN_FOLDER}/")).select("path", kind_of("path").alias("kind"), "content", file_id("content").alias("file_id"))
    return map_files(files, settings)


def run_available(spark: SparkSession, folder: str, out: str, settings: Settings | None = None) -> None:
    """Takes all files that are new since the last call into out/documents and out/chunks, and ends."""
    settings = settings or Settings()

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        sizes = ChunkSizes(settings.size_tokens, settings.overlap_tokens, settings.token_factor)
        chunk_documents(batch.filter("error IS NULL"), sizes).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        batch.unpersist()

    query = stream_documents(spark, folder, settings).writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total of a stream of events, late ones up to a watermark."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
