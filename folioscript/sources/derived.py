"""Further model views shared by queries (each is lazy and whole)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscript.sources.model import Model


def line_segments(m: Model) -> DataFrame:
    """Every document line as a timed segment: (chapter_id, idx, text, start_sec, duration_sec)."""
    lines = m.texts.select(
        F.col("doc_id").alias("chapter_id"), F.posexplode_outer(F.split("text", "\n")).alias("idx", "text"))
    return lines.filter(F.length("text") > 0).select(
        "chapter_id", F.col("idx").cast("long"), "text",
        (F.col("idx") * 10.0).alias("start_sec"), (F.length("text") / 16.0).alias("duration_sec"))


LINE_SEGMENTS_SQL = """SELECT doc_id AS chapter_id, i - 1 AS idx, l AS text, (i - 1) * 10.0 AS start_sec, length(l) / 16.0 AS duration_sec
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE length(l) > 0"""


def playheads(m: Model) -> DataFrame:
    """Three playhead positions per chapter."""
    return m.chapters.select(
        F.col("id").alias("chapter_id"),
        F.explode_outer(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(
            (F.col("id") * 3 + k).alias("probe_id"), (F.col("id") % 40 + k * 25).cast("double").alias("t")))).alias("p"),
    ).select("chapter_id", "p.probe_id", "p.t")


PLAYHEADS_SQL = """SELECT id AS chapter_id, id * 3 + k AS probe_id, CAST(id % 40 + k * 25 AS DOUBLE) AS t
  FROM chapters, (SELECT unnest([0, 1, 2]) AS k)"""
