"""Sinks: tables in versions with a manifest, keyed upserts, script replacement, catalog snapshots.

A stored table is a folder:

    data/version=<n>/bucket=<b>/...   rows of the buckets that version n rewrote
    manifest/version=<n>/...          per bucket: the version that holds its rows, and their number

A write puts down the buckets it touches, then the manifest, one small file that
appears whole or not at all. Readers go by the newest manifest: what a writer that
died has left behind is never seen, and the next writer of that version replaces it.
Nothing that a reader may be using is changed. One writer at a time; a streaming batch
passes its number as the version, so that a repeated batch ends in the same table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscript.operators.voices import SNAPSHOT_REFRESH_SEC, SNAPSHOT_USABLE_SEC
from folioscript.session import cut_lineage

BUCKETS = 1024
MANIFEST = "bucket int, holder long, n long"


def bucket_of(*keys: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class StoredTable:
    """A versioned table below ``path``; ``bucket_by`` names the columns whose hash places a row."""

    def __init__(self, spark: SparkSession, path: str, schema: str, bucket_by: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.bucket_by, self.buckets = spark, path.rstrip("/"), bucket_by, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def versions(self) -> DataFrame | None:
        """All manifests, or None before the first one."""
        try:
            return self.spark.read.option("basePath", f"{self.path}/manifest").schema(f"{MANIFEST}, version long").parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def manifest(self, before: int | None = None) -> tuple[int, dict[int, tuple[int, int]]]:
        """(newest version, {bucket: (version that holds it, rows)}): one entry per bucket at most. Version -1 is the empty table."""
        found = self.versions()
        if found is None:
            return -1, {}
        newest = (found if before is None else found.filter(F.col("version") < before)).agg(F.max("version")).first()[0]
        if newest is None:
            return -1, {}
        rows = found.filter(F.col("version") == newest).collect()
        return newest, {r["bucket"]: (r["holder"], r["n"]) for r in rows if r["bucket"] >= 0}

    def _rows(self, held: dict[int, tuple[int, int]], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, (v, n) in held.items() if n and (only is None or b in only)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of ``version``, by default the newest."""
        return self._rows(self.manifest(None if version is None else version + 1)[1])

    def _commit(self, rows: DataFrame, touched: set[int], held: dict, version: int) -> None:
        data = f"{self.path}/data/version={version}"
        rows.withColumn("bucket", bucket_of(*self.bucket_by, buckets=self.buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        counts: dict[int, int] = {}
        if touched:
            try:
                counts = dict(self.spark.read.parquet(data).groupBy("bucket").count().collect())
            except AnalysisException as e:  # every touched bucket became empty
                if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                    raise
        held = held | {b: (version, counts.get(b, 0)) for b in touched}
        self.switch([(b, v, n) for b, (v, n) in sorted(held.items())] or [(-1, version, 0)], version)

    def switch(self, entries: list[tuple[int, int, int]], version: int) -> None:
        """Make ``version`` the one that readers see."""
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def replace(self, keys: DataFrame, rows: DataFrame, version: int | None = None) -> int:
        """Drop what is stored for ``keys`` and store ``rows`` instead; a key without rows is emptied. Returns the version.

        ``keys`` holds the bucketing columns and whatever else names what is replaced; ``rows`` of other keys are not allowed.
        """
        newest, held = self.manifest(version)
        version = newest + 1 if version is None else version
        keys = cut_lineage(keys.distinct().withColumn("_bucket", bucket_of(*self.bucket_by, buckets=self.buckets)), "keys")
        touched = {r[0] for r in keys.select("_bucket").distinct().collect()}  # at most one per bucket
        kept = self._rows(held, touched).join(keys.drop("_bucket"), keys.columns[:-1], "left_anti")
        self._commit(kept.select(self.schema.names).unionByName(rows.select(self.schema.names)), touched, held, version)
        return version

    def upsert(self, rows: DataFrame, merge: dict[str, Column] | None = None, version: int | None = None) -> int:
        """Insert ``rows`` or replace those of the same bucketing columns; only the buckets that hold them are rewritten.

        ``merge`` gives aggregates over the stored row and the new one, for values that only grow; else the new row counts.
        """
        newest, held = self.manifest(version)
        version = newest + 1 if version is None else version
        rows = cut_lineage(rows.select(self.schema.names), "upsert")
        touched = {r[0] for r in rows.select(bucket_of(*self.bucket_by, buckets=self.buckets)).distinct().collect()}
        others = [c for c in self.schema.names if c not in self.bucket_by]
        both = self._rows(held, touched).withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        aggs = {c: F.max_by(c, "_new") for c in others} | (merge or {})
        merged = both.groupBy(*self.bucket_by).agg(*[aggs[c].alias(c) for c in others])
        self._commit(merged.select(self.schema.names), touched, held, version)
        return version


def replace_scripts(table: StoredTable, chapters: DataFrame, segments: DataFrame, version: int | None = None) -> int:
    """Replace the stored scripts of ``chapters(book_id, chapter_id)`` by ``segments``; a chapter without segments is emptied.

    Readers see all of the new scripts or none.
    """
    return table.replace(chapters.select("book_id", "chapter_id"), segments, version)


def scripted(chapters: DataFrame, replaced: DataFrame) -> DataFrame:
    """``chapters`` after their scripts were replaced: scripted again, without audio, length or error."""
    hit = replaced.select(F.col("chapter_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    df = chapters.join(hit, "id", "left")
    gone = {c: F.when(F.col("_hit").isNull(), F.col(c)) for c in ("audio_path", "duration_sec", "error") if c in chapters.columns}
    return df.withColumns({"status": F.when(F.col("_hit"), "scripted").otherwise(F.col("status")), **gone}).select(chapters.columns)


def write_snapshot(table: StoredTable, voices: DataFrame, fetched_at_s: int) -> int:
    """Store the catalogue as fetched at a time; the one before stays readable until the switch."""
    rows = voices.withColumn("fetched_at_s", F.lit(fetched_at_s).cast("long"))
    everything = table.read().select(table.bucket_by).unionByName(rows.select(table.bucket_by))
    return table.replace(everything, rows)


def read_snapshot(table: StoredTable, as_of_s: int) -> DataFrame:
    """Snapshot rows while usable (under a day old), marked when a refresh is due."""
    age = F.lit(as_of_s) - F.col("fetched_at_s")
    return table.read().filter(age < SNAPSHOT_USABLE_SEC).withColumn("needs_refresh", age > SNAPSHOT_REFRESH_SEC)
