"""Chapter detection inside one document row: no shuffle of text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from folioscript.functions.js import WS, collapse_ws, trim_ws
from folioscript.operators.pack import SECTIONS, pack_text
from folioscript.session import travels

travels(__name__)

# Heading patterns and the limits around them.
UNITS = "one|two|three|four|five|six|seven|eight|nine"
WORD_NUMBERS = (
    f"(?:{UNITS}|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
    f"|twenty(?:[-\\s](?:{UNITS}))?|thirty(?:[-\\s](?:{UNITS}))?|forty|fifty)"
)
HEADINGS = "|".join([
    rf"(?i:^(?:chapter|part|book|canto|act|stave)[{WS}.:—-]*(?:\d{{1,4}}|[ivxlcdm]{{1,8}}|{WORD_NUMBERS})?\b.{{0,45}}\z)",
    r"(?i:^(?:prologue|epilogue|introduction|preface|foreword|interlude|afterword)\b.{0,35}\z)",
    r"(?:^[IVXLCDM]{1,8}\.?\z)",
    r"(?:^\d{1,3}\.?\z)",
])
HEADING_MAX = 60
MIN_AVERAGE = 800
FRONT_MATTER_MIN = 500
SECTIONS_OVER = 25_000


@F.pandas_udf(ArrayType(LongType()))
def _starts(sizes: pd.Series) -> pd.Series:
    """Start offset of each line from the line lengths (one newline between lines)."""
    return sizes.map(lambda n: np.concatenate(([0], np.cumsum(np.asarray(n[:-1], dtype="int64") + 1))), na_action="ignore")


def lines_with_offsets(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, line_idx, offset, line)."""
    lined = docs.withColumn("_lines", F.split("text", "\n"))
    placed = lined.withColumn("_at", _starts(F.transform("_lines", F.length)))
    return placed.select("doc_id", F.posexplode_outer(F.arrays_zip(F.col("_lines").alias("line"), F.col("_at").alias("offset")))
                         .alias("line_idx", "_r")).select("doc_id", F.col("line_idx").cast("long"), F.col("_r.offset"), F.col("_r.line"))


def is_heading(line: Column) -> Column:
    return line.rlike(HEADINGS)


def clean_title(heading: Column) -> Column:
    return trim_ws(F.regexp_replace(F.regexp_replace(heading, rf"[{WS}]+", " "), rf"[.:{WS}]+\z", ""))


def standalone_lines(trimmed: Column) -> Column:
    """Positions of short lines at document start or after a blank line."""
    def short_and_free(i):
        n = F.length(trimmed[i])
        return (n > 0) & (n <= HEADING_MAX) & ((i == 0) | (trimmed[F.greatest(i - 1, F.lit(0))] == ""))

    return F.filter(F.sequence(F.lit(0), F.size(trimmed) - 1), short_and_free)


def _plausible(picked: Column, text: Column) -> Column:
    return (F.size(picked) >= 2) & (F.length(text) / F.size(picked) >= MIN_AVERAGE)


def _subtitle_line(trimmed: Column, i: Column) -> Column:
    """Line number of a subtitle within two lines of heading ``i``, or null."""
    n = F.size(trimmed)
    at = lambda k: F.get(trimmed, k)
    first = F.when(at(i + 1) != "", i + 1).when(at(i + 2) != "", i + 2)
    return F.transform(F.array(first), lambda j: F.when(
        (F.length(at(j)) <= HEADING_MAX) & ((j + 1 >= n) | (at(j + 1) == "")) & ~is_heading(at(j)), j))[0]


def _chapters_at(lines: Column, trimmed: Column, picked: Column) -> Column:
    """Chapters for heading positions ``picked``, with front matter first."""
    def section(start, stop):
        return trim_ws(F.array_join(F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0))), "\n"))

    def chapter(i, k):
        stop = F.coalesce(F.get(picked, k + 1), F.size(lines))
        return F.transform(F.array(_subtitle_line(trimmed, i)), lambda sub: F.struct(
            clean_title(F.when(sub.isNotNull(), F.concat(clean_title(trimmed[i]), F.lit(" — "), F.get(trimmed, sub)))
                        .otherwise(trimmed[i])).alias("title"),
            section(F.coalesce(sub, i) + 1, stop).alias("text")))[0]

    front = F.transform(F.array(section(F.lit(0), picked[0])), lambda t: F.struct(F.lit("Front Matter").alias("title"), t.alias("text")))
    return F.concat(
        F.filter(front, lambda c: F.length(c["text"]) > FRONT_MATTER_MIN),
        F.filter(F.transform(picked, chapter), lambda c: c["text"] != ""))


def detect(docs: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, method, idx, title, text).

    ``supplied`` (doc_id, heading_indexes) names headings by their number among the
    standalone lines and is used where the patterns find no plausible split.
    """
    df = docs.select("doc_id", "text").withColumn("_lines", F.split("text", "\n"))
    df = df.withColumn("_trim", F.transform("_lines", trim_ws))
    df = df.withColumn("_free", standalone_lines(F.col("_trim")))
    df = df.withColumn("_found", F.filter("_free", lambda i: is_heading(F.col("_trim")[i])))
    if supplied is not None:
        df = df.join(supplied.select("doc_id", "heading_indexes"), "doc_id", "left")
        inside = F.filter(F.array_sort("heading_indexes"), lambda k: (k >= 0) & (k < F.size("_free")))
        df = df.withColumn("_given", F.transform(inside, lambda k: F.col("_free")[k]))
    else:
        df = df.withColumn("_given", F.lit(None).cast("array<int>"))
    text = F.col("text")
    method = (
        F.when(_plausible(F.col("_found"), text), "heuristic")
        .when((F.size("_free") >= 2) & F.coalesce(_plausible(F.col("_given"), text), F.lit(False)), "llm")
        .when(F.length(text) > SECTIONS_OVER, "sections")
        .otherwise("single"))
    df = df.withColumn("method", method)
    picked = F.when(F.col("method") == "heuristic", F.col("_found")).when(F.col("method") == "llm", F.col("_given"))
    numbered = lambda arr: F.transform(arr, lambda t, i: F.struct(
        F.concat(F.lit("Section "), (i + 1).cast("string")).alias("title"), t.alias("text")))
    df = df.withColumn("_picked", picked)
    df = df.withColumn("_ch", F.when(F.col("_picked").isNotNull(), _chapters_at(F.col("_lines"), F.col("_trim"), F.col("_picked")))
                       .when(F.col("method") == "sections", numbered(pack_text(text, SECTIONS)))
                       .otherwise(F.array(F.struct(F.lit("Chapter 1").alias("title"), text.alias("text")))))
    return df.select("doc_id", "method", F.posexplode_outer("_ch").alias("idx", "_c")).filter("_c IS NOT NULL").select(
        "doc_id", "method", F.col("idx").cast("long"), "_c.title", "_c.text")


def heading_candidates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, line_idx, offset, heading, is_heading) of standalone lines.

    Offsets need every line length but the lines themselves never leave their row.
    """
    df = docs.select("doc_id", "text").withColumn("_lines", F.split("text", "\n"))
    df = df.withColumn("_at", _starts(F.transform("_lines", F.length)))
    df = df.withColumn("_trim", F.transform("_lines", trim_ws)).withColumn("_free", standalone_lines(F.col("_trim")))
    rows = F.transform("_free", lambda i: F.struct(
        i.cast("long").alias("line_idx"), F.col("_at")[i].alias("offset"), F.col("_trim")[i].alias("heading")))
    return df.select("doc_id", F.inline_outer(rows)).filter("line_idx IS NOT NULL").withColumn("is_heading", is_heading(F.col("heading")))


def book_text(chapters: DataFrame) -> DataFrame:
    """Chapters of a book joined in order by blank lines, with its first 280 characters.

    A book's text is bounded by the ingestion gate, so one row may hold it.
    """
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return chapters.groupBy("doc_id").agg(parts.alias("_p")).select(
        "doc_id", F.array_join(F.transform("_p", lambda p: p["text"]), "\n\n").alias("text"),
        F.left(F.col("_p")[0]["text"], F.lit(280)).alias("opening"))
