"""Reading view: segment boundaries in the text and paragraph blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscript.functions.assemble import find_boundaries, gather_blocks
from folioscript.functions.js import WS, settled
from folioscript.operators.timeline import split_phrases

KEY = ["chapter_id"]
BREAK_GAP = rf"\n[{WS}]*\n"


def boundaries(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """Add the three boundary flags to ``segments``.

    ``chapters``: (chapter_id, clean_text, announcement). A chapter's segments
    are parts of its own text, so gathering them is bounded by that text.
    """
    packed = segments.groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("idx", "kind", "text"))).alias("_segs"))
    df = packed.join(chapters.select("chapter_id", "clean_text", "announcement"), "chapter_id")
    df = df.withColumn("_b", find_boundaries(F.col("clean_text"), F.col("announcement"), F.col("_segs")))
    rows = df.select("chapter_id", F.inline_outer(F.arrays_zip(F.transform("_segs", lambda x: x["idx"]).alias("idx"), F.col("_b").alias("b"))))
    return segments.join(rows.select("chapter_id", "idx", "b.para_break_before", "b.space_before", "b.is_title"), ["chapter_id", "idx"])


def bounded_script(scripted: DataFrame) -> DataFrame:
    """Boundary flags of a chapter's own script, without leaving its row: rows per segment."""
    return scripted.withColumn("_rows", find_boundaries(F.col("clean_text"), F.col("announcement"), F.col("script")))


def boundary_rows(bounded: DataFrame) -> DataFrame:
    return bounded.select("chapter_id", F.posexplode_outer("_rows").alias("idx", "_r")).filter("_r IS NOT NULL").select(
        "chapter_id", F.col("idx").cast("long"), "_r.*")


def _bits(rows: Column) -> Column:
    """Phrases cut at blank lines, each with what it does to the paragraph it meets."""
    alone = lambda x: x["is_title"] | (x["kind"] == "sfx")

    def of_segment(x, i):
        before = F.get(rows, i - 1)
        opens = alone(x) | before.isNull() | F.coalesce(alone(before), F.lit(False)) | x["para_break_before"]
        phrases = F.when(alone(x), F.array(x["text"])).otherwise(split_phrases(x["text"]))

        def of_phrase(p, k):
            chunks = F.when(alone(x), F.array(p)).otherwise(F.split(p, BREAK_GAP))
            head = lambda j: (k == 0) & (j == 0)
            return F.transform(chunks, lambda c, j: F.struct(
                F.when(x["is_title"], "title").when(x["kind"] == "sfx", "sfx").otherwise("para").alias("kind"),
                F.when(head(j), opens).otherwise(j > 0).alias("starts"), (head(j) & ~opens & x["space_before"]).alias("space"), c.alias("text")))

        return F.flatten(F.transform(phrases, of_phrase))

    return F.flatten(F.transform(rows, of_segment))


def page_blocks(bounded: DataFrame) -> DataFrame:
    """Book-page blocks (chapter_id, block_idx, kind, text).

    Titles and sound effects stand alone; paragraphs open at a paragraph break,
    after a standing block, and at a blank line inside a phrase.
    """
    df = settled(settled(bounded, "_rows").withColumn("_bits", _bits(F.col("_rows"))), "_bits").withColumn("_blocks", gather_blocks(F.col("_bits")))
    return df.select("chapter_id", F.posexplode_outer("_blocks").alias("block_idx", "_x")).filter("_x IS NOT NULL").select(
        "chapter_id", F.col("block_idx").cast("long"), "_x.*")
