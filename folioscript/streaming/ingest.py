"""Incremental ingest: new files become chapters, bad files are quarantined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioscript.operators.chapters import detect
from folioscript.session import cut_lineage
from folioscript.sources.files import FILE_SCHEMA, books_from_uploads, judged_uploads, quarantine


def upload_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
            .option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path))


def start_ingest(stream: DataFrame, target: str) -> StreamingQuery:
    """Write chapters and quarantine rows per batch; a repeated batch overwrites itself."""
    root = target.rstrip("/")

    def handle(batch: DataFrame, batch_id: int) -> None:
        judged = cut_lineage(judged_uploads(batch), "uploads")
        detect(books_from_uploads(judged)).write.mode("overwrite").parquet(f"{root}/chapters/batch={batch_id:09d}")
        quarantine(judged).write.mode("overwrite").parquet(f"{root}/quarantine/batch={batch_id:09d}")

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True).start())
