"""Quotation spans of a chapter, and the chunks and passages cut from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscript.functions.assemble import mark_passages
from folioscript.functions.js import WS
from folioscript.functions.quote_scan import scan_quotes

# Chunk and context limits of the attribution step.
MAX_QUOTES, MAX_COVER, CONTEXT_PAD = 30, 12_000, 400
SINGLE_OPENER = rf"[‘'](?<![^{WS}(\[{{—–\-\"“][‘'])"  # the mark comes first: few places look behind


def quote_style(text: Column) -> Column:
    """curly, straight, single or none, by counting opening marks."""
    marks = lambda ch: F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))
    curly, straight = marks("“"), marks('"')
    singles = F.regexp_count(text, F.lit(SINGLE_OPENER))
    return (F.when(curly >= 2, "curly").when(straight >= 2, "straight")
            .when((curly == 0) & (straight == 0) & (singles >= 4), "single").otherwise("none"))


def with_spans(chapters: DataFrame, text: str = "text") -> DataFrame:
    """Add ``style`` and ``spans`` (kind, start, end, text, flagged, q), tiling the text.

    Texts with quotes go through the Arrow scanner, one pass each; a text without
    any is a single span and stays in the JVM.
    """
    t = F.col(text)
    df = chapters.withColumn("style", quote_style(t))
    quoted = F.col("style") != "none"
    plain = F.array(F.struct(F.lit("narration").alias("kind"), F.lit(0).cast("long").alias("start"), F.length(t).cast("long").alias("end"),
                             t.alias("text"), F.lit(False).alias("flagged"), F.lit(None).cast("long").alias("q")))
    df = df.withColumn("_py", scan_quotes(F.when(quoted, t), F.when(quoted, F.col("style"))))
    return df.withColumn("spans", F.when(quoted, F.col("_py")).when(F.length(t) > 0, plain).otherwise(F.slice(plain, 1, 0))).drop("_py")


def span_rows(spanned: DataFrame, keep: list[str]) -> DataFrame:
    return spanned.select(*keep, F.posexplode_outer("spans").alias("span_idx", "_s")).filter("_s IS NOT NULL").select(
        *keep, F.col("span_idx").cast("long"), "_s.*")


def quote_chunks(spans: Column) -> Column:
    """Runs of quotes for one attribution call as (first, cnt, start, stop)."""
    quotes = F.filter(spans, lambda s: s["kind"] == "quote")
    kind = "array<struct<first:bigint,cnt:bigint,start:bigint,stop:bigint>>"
    zero = F.struct(F.array().cast(kind).alias("done"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("cnt"),
                    F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"))
    run = lambda s: F.struct(s["first"], s["cnt"], s["start"], s["stop"])

    def step(s, q):
        full = (s["cnt"] > 0) & ((s["cnt"] >= MAX_QUOTES) | (q["end"] - s["start"] > MAX_COVER))
        fresh = full | (s["cnt"] == 0)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(run(s)))).otherwise(s["done"]).alias("done"),
            F.when(fresh, q["q"]).otherwise(s["first"]).alias("first"),
            F.when(fresh, F.lit(1).cast("long")).otherwise(s["cnt"] + 1).alias("cnt"),
            F.when(fresh, q["start"]).otherwise(s["start"]).alias("start"), q["end"].alias("stop"))

    return F.aggregate(quotes, zero, step, lambda s: F.when(s["cnt"] > 0, F.concat(s["done"], F.array(run(s)))).otherwise(s["done"]))


def attribution_chunks(spanned: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (keep, chunk, first, cnt, start, stop)."""
    df = spanned.withColumn("_c", quote_chunks(F.col("spans")))
    return df.select(*keep, F.posexplode_outer("_c").alias("chunk", "_r")).filter("_r IS NOT NULL").select(
        *keep, F.col("chunk").cast("long"), "_r.*")


def passages(spanned: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Marked passage of each chunk with context on both sides and ellipses where clipped."""
    df = spanned.withColumn("_c", quote_chunks(F.col("spans")))
    df = df.withColumn("_p", mark_passages(F.col(text), F.col("spans"), F.col("_c"), F.lit(CONTEXT_PAD)))
    return df.select(*keep, F.posexplode_outer("_p").alias("chunk", "passage")).filter("passage IS NOT NULL").select(
        *keep, F.col("chunk").cast("long"), "passage")
