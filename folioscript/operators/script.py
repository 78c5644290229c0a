"""Script assembly: attributed spans to ordered segments, notes and cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscript.functions import domains as D
from folioscript.functions.assemble import SEGMENT, fold_spans
from folioscript.functions.js import clamp, is_blank, round_half_up, settled, trim_ws
from folioscript.functions.text import clean_chapter, title_announcement
from folioscript.operators import ordered as O
from folioscript.operators.pack import NARRATION, pack_text, run_list
from folioscript.operators.quotes import with_spans

KEY = ["chapter_id"]
MAX_CUES = 2
SCRIPT_CHUNK = 14_000


def prepared_chapters(chapters: DataFrame) -> DataFrame:
    """Chapters with cleaned text, spoken title and spans."""
    df = chapters.withColumn("announcement", title_announcement(F.col("title"))).withColumn(
        "clean_text", clean_chapter(F.col("text"), F.col("title")))
    return with_spans(df, "clean_text")


def first_attributions(attributions: DataFrame) -> DataFrame:
    """One attribution per (chapter, quote): the first given."""
    return attributions.groupBy("chapter_id", "quote_id").agg(
        F.min_by(F.struct("speaker", "is_dialogue", "confidence"), "ord").alias("att"))


def _segment(kind, character_id, text, flagged, prose) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(kind).alias("kind"), lit(character_id).alias("character_id"), lit(text).alias("text"),
                    lit(flagged).alias("flagged"), lit(prose).alias("prose")).cast(SEGMENT)


def resolved_attributions(chapters: DataFrame, attributions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(chapter_id, atts): first answer per quote with its character, in quote order.

    Works on narrow rows only; a chapter's list is no longer than its quotes.
    """
    att = first_attributions(attributions.filter("quote_id >= 0")).withColumn("key", F.lower("att.speaker"))
    books = chapters.select("chapter_id", "book_id")
    att = att.join(books, "chapter_id").join(dictionary, ["book_id", "key"], "left")
    named = F.col("key") != "narrator"
    answer = F.struct(
        F.col("quote_id").alias("q"), F.when(named, F.col("character_id")).alias("found"),
        (named & F.col("character_id").isNull()).alias("unknown"), F.col("att.is_dialogue").alias("is_dialogue"),
        (F.col("att.confidence") == "low").alias("low"))
    return att.groupBy("chapter_id").agg(F.array_sort(F.collect_list(answer)).alias("atts"))


def _split_prose(segments: Column) -> Column:
    """Long narration is cut at paragraphs; everything else passes through."""
    def parts(x):
        cut = F.transform(pack_text(x["text"], NARRATION), lambda t: _segment("narration", x["character_id"], t, x["flagged"], True))
        return F.when(x["prose"] & (F.length(x["text"]) > NARRATION.limit), cut).otherwise(F.array(x))

    return F.flatten(F.transform(segments, parts))


def with_script(chapters: DataFrame, answers: DataFrame, pov: DataFrame) -> DataFrame:
    """Add ``script``, the ordered segments of each chapter, inside the chapter's row.

    ``chapters`` come from :func:`prepared_chapters`, ``answers`` from
    :func:`resolved_attributions`, ``pov`` is (chapter_id, pov_character_id). The
    text moves at most once, for the join on chapter_id.
    """
    df = chapters.join(answers, "chapter_id", "left").join(pov, "chapter_id", "left")
    none = F.array().cast("array<struct<q:bigint,found:bigint,unknown:boolean,is_dialogue:boolean,low:boolean>>")
    df = df.withColumn("_a", F.coalesce("atts", none)).withColumn("_raw", fold_spans(F.col("spans"), F.col("_a"), F.col("pov_character_id")))
    title = F.when(F.col("announcement").isNull(), F.slice("_raw", 1, 0)).otherwise(
        F.array(_segment("narration", F.lit(None), F.col("announcement"), False, False)))
    rows = F.filter(F.concat(title, _split_prose(F.col("_raw"))), lambda x: x["text"] != "")
    return settled(df.withColumn("script", rows), "script").drop("_a", "_raw", "atts")


def script_rows(scripted: DataFrame) -> DataFrame:
    """Segment rows (chapter_id, idx, character_id, kind, text, flagged)."""
    return scripted.select("chapter_id", F.posexplode_outer("script").alias("idx", "_s")).filter("_s IS NOT NULL").select(
        "chapter_id", F.col("idx").cast("long"), "_s.character_id", "_s.kind", "_s.text", "_s.flagged")


def valid_delivery_notes(script: DataFrame, notes: DataFrame) -> DataFrame:
    """First known delivery per dialogue line (chapter_id, line, delivery)."""
    talk = script.filter("kind = 'dialogue'").select("chapter_id", F.col("idx").alias("line"))
    good = notes.filter(F.col("delivery").isin(D.DELIVERY_NAMES)).join(talk, ["chapter_id", "line"], "left_semi")
    return good.groupBy("chapter_id", "line").agg(F.min_by("delivery", "ord").alias("delivery"))


EVIDENCE_BLOCK = 256


def evidenced(cues: DataFrame, texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The cues whose (trimmed, not blank) evidence occurs in their text.

    All evidence of a text is looked for inside one row, in blocks of at most about EVIDENCE_BLOCK different pieces, so
    the text travels once per block and not once per cue; cues meet only the pieces that were found.
    """
    cues = cues.withColumn("_piece", trim_ws(F.col("evidence"))).filter("_piece <> ''")
    pieces = cues.select(*keys, "_piece").distinct()
    many = pieces.groupBy(*keys).agg(F.count("*").alias("_n"))
    block = F.pmod(F.xxhash64("_piece"), F.ceil(F.col("_n") / EVIDENCE_BLOCK))
    grouped = pieces.join(many, keys).groupBy(*keys, block.alias("_block")).agg(F.collect_list("_piece").alias("_pieces"))
    hits = grouped.join(texts.select(*keys, F.col(text).alias("_text")), keys).select(
        *keys, F.explode(F.filter("_pieces", lambda p: F.contains(F.col("_text"), p))).alias("_piece")).distinct()
    return cues.join(hits, [*keys, "_piece"], "left_semi").drop("_piece")


def valid_cues(script: DataFrame, chapters: DataFrame, books: DataFrame, cues: DataFrame) -> DataFrame:
    """At most two evidenced cues per chapter, first per line: (chapter_id, line, prompt, seconds)."""
    lines = script.select("chapter_id", F.col("idx").alias("after_line"))
    enabled = books.filter("sfx_enabled").select(F.col("id").alias("book_id"))
    texts = chapters.join(enabled, "book_id", "left_semi").select("chapter_id", "clean_text")
    ready = cues.filter(~is_blank(F.col("prompt"))).join(lines, ["chapter_id", "after_line"], "left_semi")
    found = evidenced(ready, texts, KEY, "clean_text").select("chapter_id", "after_line", "ord", trim_ws(F.col("prompt")).alias("prompt"),
                         round_half_up(clamp(F.col("seconds"), 1.0, 6.0), 1).alias("seconds"))
    once = O.first_by(found, ["chapter_id", "after_line"], [F.col("ord")])
    return O.top_by(once, KEY, [F.col("ord")], MAX_CUES).select("chapter_id", F.col("after_line").alias("line"), "prompt", "seconds")


def final_script(script: DataFrame, notes: DataFrame, cues: DataFrame) -> DataFrame:
    """Segments with delivery notes, cue rows put behind their line, and dense positions."""
    spoken = script.withColumnRenamed("idx", "line").join(notes, ["chapter_id", "line"], "left").withColumns(
        {"is_cue": F.lit(0), "sfx_duration_sec": F.lit(None).cast("double")})
    rows = cues.select(
        "chapter_id", "line", F.lit(None).cast("long").alias("character_id"), F.lit("sfx").alias("kind"), F.col("prompt").alias("text"),
        F.lit(False).alias("flagged"), F.lit(None).cast("string").alias("delivery"), F.lit(1).alias("is_cue"), F.col("seconds").alias("sfx_duration_sec"))
    out = O.dense_index(spoken.unionByName(rows), KEY, [F.col("line"), F.col("is_cue")], "idx", O.rank_block(F.col("line")))
    return out.withColumn("text_hash", F.sha2("text", 256)).withColumn(
        "id", F.sha2(F.concat_ws("|", "chapter_id", "idx", "text_hash"), 256)).drop("line", "is_cue")


def script_line(idx: Column, kind: Column, name: Column, has_character: Column, text: Column) -> Column:
    label = F.when((kind == "dialogue") & has_character, F.coalesce(name, F.lit("?"))).otherwise("Narration")
    return F.concat(F.lit("#"), idx.cast("string"), F.lit(" ["), label, F.lit("]: "), text)


def script_lines(script: DataFrame, cast: DataFrame) -> DataFrame:
    names = cast.select(F.col("id").alias("character_id"), "name")
    df = script.join(names, "character_id", "left")
    return df.select("chapter_id", "idx", script_line(F.col("idx"), F.col("kind"), F.col("name"), F.col("character_id").isNotNull(), F.col("text")).alias("line"))


def script_chunks(lines: DataFrame) -> DataFrame:
    """Runs of script lines up to 14 000 characters: (chapter_id, chunk, first, cnt).

    Only line lengths are gathered per chapter.
    """
    sizes = lines.groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.length("line").alias("n")))).alias("_s"))
    runs = sizes.withColumn("_r", run_list(F.transform("_s", lambda x: x["n"]), SCRIPT_CHUNK))
    return runs.select("chapter_id", F.posexplode_outer("_r").alias("chunk", "_x")).select(
        "chapter_id", F.col("chunk").cast("long"), F.col("_x.first").cast("long").alias("first"), F.col("_x.cnt").cast("long").alias("cnt"))


def recent_attributions(chunks: DataFrame, attributions: DataFrame) -> DataFrame:
    """Context for the next chunk: attributions of a chunk's last three quotes."""
    tail = chunks.select("chapter_id", "chunk", F.explode_outer(F.sequence(
        F.greatest(F.col("first"), F.col("first") + F.col("cnt") - 3), F.col("first") + F.col("cnt") - 1)).alias("quote_id"))
    last = attributions.groupBy("chapter_id", "quote_id").agg(F.max_by("speaker", "ord").alias("speaker"))
    mark = F.concat(F.lit("⟦"), F.col("quote_id").cast("string"), F.lit("⟧="), F.col("speaker"))
    return tail.join(last, ["chapter_id", "quote_id"]).groupBy("chapter_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("quote_id", mark.alias("m")))).alias("_m")).select(
        "chapter_id", "chunk", F.array_join(F.transform("_m", lambda x: x["m"]), ", ").alias("recent"))
