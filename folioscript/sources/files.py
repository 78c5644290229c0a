"""File sources: text uploads with a quarantine, and clip inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscript.functions import mp3
from folioscript.functions import text as X
from folioscript.operators.chapters import detect

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def judged_uploads(files: DataFrame) -> DataFrame:
    """(path, length, text, reject_reason) for every upload.

    The size test is pushed into the scan, so an oversize file is never read.
    """
    small = files.filter(F.col("length") <= X.MAX_BYTES)
    big = files.filter(F.col("length") > X.MAX_BYTES).select(
        "path", "length", F.lit(None).cast("string").alias("text"), F.lit("too_large").alias("reject_reason"))
    plain = X.file_extension(F.col("path")).isin(".txt", ".md")
    body = F.when(plain, X.normalize(F.make_valid_utf8(F.col("content").cast("string"))))
    read = small.select("path", "length", body.alias("text"))
    return read.withColumn("reject_reason", X.reject_reason(F.col("path"), F.col("length"), F.col("text"))).unionByName(big)


def books_from_uploads(judged: DataFrame) -> DataFrame:
    """Accepted uploads as (doc_id, title, text); ids come from the path."""
    good = judged.filter("reject_reason IS NULL")
    return good.select(F.xxhash64("path").alias("doc_id"), "path", X.title_from_file_name(F.col("path")).alias("title"), "text")


def quarantine(judged: DataFrame) -> DataFrame:
    return judged.filter("reject_reason IS NOT NULL").select("path", "length", "reject_reason")


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters of good uploads, quarantined uploads)."""
    judged = judged_uploads(files)
    return detect(books_from_uploads(judged)), quarantine(judged)


def clip_inventory(files: DataFrame) -> DataFrame:
    """Audio bytes, frame count and duration of each MP3 file."""
    return files.select("path", "length", "content").mapInPandas(mp3.inventory_batches, mp3.INVENTORY)
