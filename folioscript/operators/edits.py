"""Script and profile edits as command tables joined to the data they change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscript.functions.domains import DELIVERY_NAMES
from folioscript.functions.text import title_announcement

GENDERS = ["male", "female", "nonbinary", "unknown"]
PROFILE_FIELDS = ["gender", "age_range", "accent_hint", "heritage"]
RENDER_MODELS = ["eleven_v3", "eleven_multilingual_v2", "eleven_flash_v2_5"]


def edit_segments(segments: DataFrame, chapters: DataFrame, cast: DataFrame, commands: DataFrame) -> DataFrame:
    """Result of each command (segment_id, op, set_speaker, speaker, set_delivery, new_delivery).

    ``op`` is patch or delete. Accepted patches drop the clip; a refused command
    carries ``reject_reason`` and leaves its segment alone.
    """
    seg = segments.select(F.col("id").alias("segment_id"), "chapter_id", "kind", "character_id", "delivery", "flagged", "audio_path", F.lit(True).alias("_seg"))
    ch = chapters.select(F.col("id").alias("chapter_id"), F.col("book_id").alias("_book"))
    who = cast.select(F.col("id").alias("speaker"), F.col("book_id").alias("_speaker_book"))
    df = commands.join(seg, "segment_id", "left").join(ch, "chapter_id", "left").join(who, "speaker", "left")
    patch = F.col("op") == "patch"
    foreign = F.col("set_speaker") & F.col("speaker").isNotNull() & ~F.col("_speaker_book").eqNullSafe(F.col("_book"))
    noted = F.col("set_delivery") & F.col("new_delivery").isNotNull()
    reason = (
        F.when(patch & ~F.col("set_speaker") & ~F.col("set_delivery"), "nothing_to_update")
        .when(patch & noted & ~F.col("new_delivery").isin(DELIVERY_NAMES), "bad_request")
        .when(F.col("_seg").isNull(), "not_found")
        .when(patch & (F.col("kind") == "sfx"), "sfx_immutable")
        .when(~patch & (F.col("kind") != "sfx"), "not_sfx")
        .when(patch & foreign, "not_found")
        .when(patch & noted & (F.col("kind") != "dialogue"), "bad_delivery"))
    df = df.withColumn("reject_reason", reason)
    act = F.col("reject_reason").isNull() & patch
    speak = act & F.col("set_speaker")
    to_narrator = speak & F.col("speaker").isNull()
    return df.select(
        "segment_id", "chapter_id", "op", "reject_reason",
        F.when(speak, F.col("speaker")).otherwise(F.col("character_id")).alias("character_id"),
        F.when(to_narrator, "narration").otherwise(F.col("kind")).alias("kind"),
        F.when(speak, False).otherwise(F.col("flagged")).alias("flagged"),
        F.when(act & F.col("set_delivery"), F.col("new_delivery")).when(~to_narrator, F.col("delivery")).alias("delivery"),
        F.when(~act, F.col("audio_path")).alias("audio_path"))


def chapters_made_stale(edits: DataFrame, chapters: DataFrame) -> DataFrame:
    """Ready chapters touched by an accepted edit."""
    touched = edits.filter("reject_reason IS NULL").select(F.col("chapter_id").alias("id")).distinct()
    return chapters.filter("status = 'ready'").join(touched, "id", "left_semi").select(F.col("id").alias("chapter_id"))


def set_chapter_narrator(segments: DataFrame, chapters: DataFrame, cast: DataFrame, commands: DataFrame) -> DataFrame:
    """Point a chapter's narration (not its title line) at one character or the book narrator.

    ``commands``: (chapter_id, narrator). Rows of refused commands carry a reason.
    """
    ch = chapters.select(F.col("id").alias("chapter_id"), F.col("book_id").alias("_book"), title_announcement(F.col("title")).alias("_announce"))
    who = cast.select(F.col("id").alias("narrator"), F.col("book_id").alias("_nbook"), F.col("is_narrator").alias("_is_narrator"))
    cmd = commands.join(ch, "chapter_id").join(who, "narrator", "left")
    reason = F.when(F.col("narrator").isNotNull() & ~F.col("_nbook").eqNullSafe(F.col("_book")), "not_found").when(F.col("_is_narrator"), "bad_request")
    rows = segments.join(cmd.withColumn("reject_reason", reason), "chapter_id").filter(
        (F.col("kind") == "narration") & ~((F.col("idx") == 0) & F.coalesce(F.col("text") == F.col("_announce"), F.lit(False))))
    ok = F.col("reject_reason").isNull()
    return rows.select("chapter_id", "idx", "reject_reason", F.when(ok, F.col("narrator")).otherwise(F.col("character_id")).alias("character_id"),
                       F.when(~ok, F.col("audio_path")).alias("audio_path"))


def check_speakers(assignments: DataFrame, chapters: DataFrame, cast: DataFrame) -> DataFrame:
    """Reason a (chapter_id, character_id) pairing is invalid, or null."""
    ch = chapters.select(F.col("id").alias("chapter_id"), F.col("book_id").alias("_book"))
    who = cast.select(F.col("id").alias("character_id"), F.col("book_id").alias("_cbook"))
    df = assignments.join(ch, "chapter_id", "left").join(who, "character_id", "left")
    reason = F.when(F.col("_cbook").isNull(), "no_such_character").when(~F.col("_cbook").eqNullSafe(F.col("_book")), "other_book")
    return df.withColumn("reject_reason", reason).drop("_book", "_cbook")


def patch_profiles(cast: DataFrame, patches: DataFrame) -> DataFrame:
    """Sparse profile edits: given fields (map of name to value) win, the rest stay."""
    df = cast.join(patches.select(F.col("character_id").alias("id"), "fields"), "id")
    unknown = F.exists(F.map_keys("fields"), lambda k: ~k.isin(PROFILE_FIELDS))
    reason = (F.when(F.size("fields") == 0, "no_fields").when(unknown, "unknown_field")
              .when(F.col("fields")["gender"].isNotNull() & ~F.col("fields")["gender"].isin(GENDERS), "bad_gender"))
    df = df.withColumn("reject_reason", reason)
    new = lambda f: F.when(F.col("reject_reason").isNull(), F.coalesce(F.col("fields")[f], F.col(f))).otherwise(F.col(f))
    return df.select("id", "reject_reason", *[new(f).alias(f) for f in PROFILE_FIELDS],
                     (F.col("profile_edited") | F.col("reject_reason").isNull()).alias("profile_edited"))


def patch_books(books: DataFrame, patches: DataFrame) -> DataFrame:
    """Sparse book edits (book_id, new_title, new_author, new_model); blank author clears it."""
    df = books.join(patches.withColumnRenamed("book_id", "id"), "id")
    reason = (F.when((F.coalesce("new_model", F.lit("")) != "") & ~F.col("new_model").isin(RENDER_MODELS), "bad_model")
              .when(F.trim("new_title") == "", "bad_title"))
    df = df.withColumn("reject_reason", reason)
    ok = F.col("reject_reason").isNull()
    given = lambda c: ok & F.col(c).isNotNull()
    return df.select(
        "id", "reject_reason", F.when(given("new_title"), F.trim("new_title")).otherwise(F.col("title")).alias("title"),
        F.when(given("new_author"), F.nullif(F.trim("new_author"), F.lit(""))).otherwise(F.col("author")).alias("author"),
        F.when(ok & (F.coalesce("new_model", F.lit("")) != ""), F.col("new_model")).otherwise(F.col("render_model")).alias("render_model"))
