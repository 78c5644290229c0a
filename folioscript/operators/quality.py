"""Data-quality checks; each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscript.functions.assemble import spans_tile
from folioscript.functions.domains import DELIVERY_NAMES
from folioscript.functions.js import trim_ws


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def index_gaps(segments: DataFrame) -> DataFrame:
    """Chapters whose segment positions are not exactly 0..n-1, each once."""
    per = segments.groupBy("chapter_id", "idx").agg(F.count("*").alias("times")).groupBy("chapter_id").agg(
        F.sum("times").alias("n"), F.count("*").alias("places"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    dense = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("places") == F.col("n"))
    return per.filter(~dense).select("chapter_id", "n", "lo", "hi")


def duplicate_labels(cast: DataFrame) -> DataFrame:
    """Variant labels that two characters of one group share."""
    return duplicate_keys(cast.filter(F.col("variant_group").isNotNull() & F.col("variant_label").isNotNull()), ["book_id", "variant_group", "variant_label"])


def duration_mismatch(durations: DataFrame, stored: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(chapter_id, off_by_sec) where the stored total (chapter_id, stored_sec) differs from the sum of clips and pauses."""
    df = durations.join(stored, "chapter_id")
    off = F.col("duration_sec") - F.col("stored_sec")
    return df.filter(F.abs(off) > tolerance).select("chapter_id", F.round(off, 6).alias("off_by_sec"))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose (non-null) reference has no parent."""
    keys = parent.select(F.col(pk).alias(fk))
    return child.filter(F.col(fk).isNotNull()).join(keys, fk, "left_anti")


def setting_violations(assignments: DataFrame) -> DataFrame:
    unit = lambda c: (F.col(c) >= 0) & (F.col(c) <= 1)
    ok = unit("stability") & unit("similarity_boost") & unit("style") & (F.col("speed") >= 0.7) & (F.col("speed") <= 1.2)
    return assignments.filter(~ok)


def domain_violations(segments: DataFrame) -> DataFrame:
    ok = F.col("kind").isin("narration", "dialogue", "sfx") & (F.col("delivery").isNull() | F.col("delivery").isin(DELIVERY_NAMES))
    return segments.filter(~ok)


def unclipped_segments(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """Segments without a clip in a chapter that claims to be playable."""
    playable = chapters.filter(F.col("status").isin("ready", "stale")).select(F.col("id").alias("chapter_id"))
    return segments.filter("audio_path IS NULL OR duration_sec IS NULL").join(playable, "chapter_id", "left_semi")


def flagged_segments(segments: DataFrame) -> DataFrame:
    return segments.filter("flagged").groupBy("chapter_id", "kind").agg(F.count("*").alias("n"))


def title_lines_left(chapters: DataFrame, text: str = "text", title: str = "title", longest: int = 60) -> DataFrame:
    """Chapters whose first line is a part of their title that cleaning should have taken out."""
    first = trim_ws(F.substring_index(F.col(text), "\n", 1))
    return chapters.filter(F.lower(F.col(title)).contains(F.lower(first)) & (F.length(first) <= longest))


def broken_spans(chapters: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Rows whose spans do not tile their text: a gap, an overlap, or characters that differ from the span's own slice."""
    return chapters.filter(~spans_tile(F.col(text), F.col(spans)))
