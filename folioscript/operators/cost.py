"""Credits, render plans, cache keys and model-sized pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscript.functions import domains as D
from folioscript.operators import ordered as O

SFX_SEC = lambda: F.coalesce("sfx_duration_sec", F.lit(float(D.DEFAULT_SFX_SECONDS)))
_count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def script_stats(segments: DataFrame) -> DataFrame:
    speech = F.col("kind") != "sfx"
    return segments.groupBy("chapter_id").agg(
        F.count("*").alias("segment_count"),
        _count(F.col("kind") == "dialogue").alias("dialogue_count"),
        _count(F.col("flagged")).alias("flagged_count"),
        F.sum(F.when(speech, F.length("text")).otherwise(0)).cast("long").alias("speech_chars"),
        F.sum(F.when(speech, 0.0).otherwise(SFX_SEC())).alias("sfx_seconds"),
    )


def chapter_credits(segments: DataFrame, chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Credits of a chapter's script under its book's model (rounded up after summing)."""
    models = chapters.select(F.col("id").alias("chapter_id"), "book_id").join(
        books.select(F.col("id").alias("book_id"), "render_model"), "book_id")
    return script_stats(segments).join(models, "chapter_id").select(
        "chapter_id", "render_model",
        (D.speech_credits(F.col("speech_chars"), F.col("render_model"))
         + D.sfx_credits(F.round("sfx_seconds", 6))).alias("credits"))


def work_totals(segments: DataFrame) -> DataFrame:
    weight = D.work_weight(F.col("kind"), F.col("text"), F.col("sfx_duration_sec"))
    return segments.groupBy("chapter_id").agg(F.sum(weight).alias("total"))


# ---- render plan and cache ------------------------------------------------
TITLE_PAUSE_V3 = " [pause]"
TITLE_PAUSE_V2 = ' <break time="1.5s" />'
PREVIEW_MAX = 300
SETTINGS = ["stability", "similarity_boost", "style", "speed"]
_DELIVERY_MAP = lambda: F.create_map(*[x for name, tag, a, b, c in D.DELIVERIES for x in (
    F.lit(name), F.struct(F.lit(tag).alias("tag"), F.lit(a).alias("stability"), F.lit(b).alias("style"), F.lit(c).alias("speed")))])


def render_plan(lines: DataFrame) -> DataFrame:
    """What is sent for each speech line, by model family.

    ``lines`` carry text, delivery, render_model, is_title and struct ``voice``.
    Third-generation models take an inline tag and a snapped stability; others
    take small setting changes. The twelve rules are a literal map, not a join.
    """
    df = lines.withColumn("_d", _DELIVERY_MAP()[F.col("delivery")])
    v3 = F.col("render_model") == D.V3_MODEL
    voice = lambda c: F.col(f"voice.{c}")
    stability, style, speed = D.nudged_settings(
        voice("stability"), voice("style"), voice("speed"), F.col("_d.stability"), F.col("_d.style"), F.col("_d.speed"))
    tag = F.when(v3 & F.col("_d").isNotNull(), F.concat("_d.tag", F.lit(" "))).otherwise("")
    pause = F.when(F.col("is_title"), F.when(v3, TITLE_PAUSE_V3).otherwise(TITLE_PAUSE_V2)).otherwise("")
    return df.withColumns({
        "rendered_text": F.concat(tag, F.col("text"), pause),
        "rendered_chars": (F.length(tag) + F.length("text") + F.length(pause)).cast("long"),
        "r_stability": F.when(v3, D.snapped_stability(voice("stability"))).otherwise(stability),
        "r_similarity": voice("similarity_boost"),
        "r_style": F.when(v3, voice("style")).otherwise(style),
        "r_speed": F.when(v3, voice("speed")).otherwise(speed),
    }).drop("_d")


def _canon(c: Column) -> Column:
    """A setting as its whole number, so that only equal settings give equal keys."""
    return c.cast("double").cast("string")


def content_key(*parts: Column) -> Column:
    """SHA-256 over a tuple: each part with its length in front, a null as a tilde, so that unlike tuples never spell alike."""
    spelled = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("~")) for p in parts]
    return F.sha2(F.concat(*spelled), 256)


def with_cache_key(plan: DataFrame) -> DataFrame:
    speech = content_key(F.col("rendered_text"), F.col("voice.voice_id"), _canon(F.col("r_stability")), _canon(F.col("r_similarity")),
                         _canon(F.col("r_style")), _canon(F.col("r_speed")), F.col("render_model"), F.col("voice.seed"))
    sfx = content_key(F.col("text"), _canon(SFX_SEC()), F.lit("sfx-v2"))
    return plan.withColumn("cache_key", F.when(F.col("kind") == "sfx", sfx).otherwise(speech))


def preview_key(voice_id: Column, text: Column, settings: list[Column]) -> Column:
    return content_key(voice_id, F.left(text, F.lit(PREVIEW_MAX)), *[_canon(s) for s in settings], F.lit(D.HALF_RATE_MODEL))


def intro_key(intro: Column, brief: Column, voice_id: Column, settings: list[Column], model: Column) -> Column:
    return F.left(content_key(intro, brief, voice_id, *[_canon(s) for s in settings], model, F.lit("intro-v3")), F.lit(16))


def probe_cache(plan: DataFrame, clips: DataFrame) -> DataFrame:
    """Add ``is_cached``; of several lines with one new key only the first is rendered."""
    known = clips.select("cache_key", F.lit(True).alias("_known"))
    keys = plan.groupBy("cache_key").agg(F.min(F.struct("chapter_id", "idx")).alias("_f")).join(known, "cache_key", "left")
    first = F.coalesce((F.col("chapter_id") == F.col("_f.chapter_id")) & (F.col("idx") == F.col("_f.idx")), F.lit(False))
    return plan.join(keys, "cache_key", "left").withColumn("is_cached", F.col("_known").isNotNull() | ~first).drop("_known", "_f")


def fresh_cost(probed: DataFrame) -> DataFrame:
    """Per chapter: lines, cached lines, and credits or characters still to pay for."""
    pay = F.when(F.col("is_cached"), 0).when(F.col("kind") == "sfx", D.sfx_credits(SFX_SEC())).otherwise(F.col("rendered_chars"))
    return probed.groupBy("chapter_id").agg(
        F.count("*").alias("lines"), _count(F.col("is_cached")).alias("cached"), F.sum(pay).cast("long").alias("to_pay"))


def stitch_chains(probed: DataFrame) -> DataFrame:
    """Runs of fresh lines with one voice, and the up to three clips each line follows.

    A chain breaks on a voice change, a cached clip or a sound effect.
    """
    keys, order = ["chapter_id"], [F.col("idx")]
    df = O.with_blocks(probed, O.rank_block(F.col("idx"))).withColumns({
        "_fresh": ~F.col("is_cached") & (F.col("kind") != "sfx"), "_voice": F.col("voice.voice_id")})
    df = O.previous_row(df, keys, order, ["_fresh", "_voice"], "prev")
    goes_on = F.col("_fresh") & F.coalesce(F.col("prev._fresh"), F.lit(False)) & F.col("prev._voice").eqNullSafe(F.col("_voice"))
    df = df.withColumn("_breaks", ~goes_on)
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    df = O.running_sums(df, keys, order, {"chain": one(F.col("_breaks")), "_nth": one(F.lit(True))})
    df = O.without_blocks(df.withColumn("_pos", F.col("_nth") - 1))
    df = O.preceding_rows(df, keys, "_pos", 3, ["idx", "chain"], "_last")
    same = F.filter("_last", lambda x: x["chain"] == F.col("chain"))
    stitched = F.when(F.col("_fresh") & (F.col("render_model") != D.V3_MODEL), F.transform(same, lambda x: x["idx"])).otherwise(
        F.array().cast("array<bigint>"))
    return df.withColumn("follows", stitched).drop("_fresh", "_voice", "_breaks", "_nth", "_pos", "_last", "prev")


def batches(segments: DataFrame, size: int) -> DataFrame:
    """Number every ``size`` consecutive segments of a chapter as one batch."""
    df = O.dense_index(segments, ["chapter_id"], [F.col("idx")], "_pos", O.rank_block(F.col("idx")))
    return df.withColumn("batch", F.floor(F.col("_pos") / size).cast("long")).drop("_pos")
