"""Clip timing: pauses, start times, playhead lookup, phrase timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscript.functions import domains as D
from folioscript.functions.js import WS, trim_ws
from folioscript.operators import ordered as O

KEY = ["chapter_id"]


def _by_idx():
    return [F.col("idx")], O.rank_block(F.col("idx"))


def with_previous(segments: DataFrame, cols: list[str]) -> DataFrame:
    """Previous segment of the chapter as struct ``prev``."""
    order, block = _by_idx()
    return O.previous_row(segments, KEY, order, cols, "prev", block)


def pauses(segments: DataFrame) -> DataFrame:
    """Target and inserted silence before every segment."""
    prev = with_previous(segments, ["kind", "text", "character_id", "is_title", "tail_sec"])
    target = D.target_pause(F.col("prev.kind"), F.col("prev.text"), F.col("prev.character_id"),
                            F.coalesce(F.col("prev.is_title"), F.lit(False)),
                            F.col("kind"), F.col("character_id"), F.col("para_break_before"))
    return prev.withColumn("target_sec", target).withColumn(
        "inserted_sec",
        F.when(F.col("prev").isNull(), 0.0).otherwise(
            D.inserted_pause(F.col("target_sec") - F.col("prev.tail_sec") - F.col("lead_sec"))),
    )


def timed_chapters(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters whose every segment has a clip, with their intro offset."""
    whole = segments.groupBy("chapter_id").agg(
        F.bool_or(F.col("duration_sec").isNull() | F.col("audio_path").isNull()).alias("broken")
    ).filter(~F.col("broken")).drop("broken")
    return chapters.select(
        F.col("id").alias("chapter_id"), F.coalesce("intro_duration_sec", F.lit(0.0)).alias("intro_sec")
    ).join(whole, "chapter_id")


def start_times(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """Start second of each segment: intro offset plus everything before it."""
    order, block = _by_idx()
    rows = segments.join(timed_chapters(segments, chapters), "chapter_id")
    gap = F.coalesce("pause_before_sec", F.lit(0.0))
    rows = O.running_sums(rows, KEY, order, {"_end": gap + F.col("duration_sec")}, block)
    return rows.withColumn("start_sec", F.col("intro_sec") + F.col("_end") - F.col("duration_sec")).drop("_end", "intro_sec")


def playhead_segment(timed: DataFrame, probes: DataFrame) -> DataFrame:
    """Segment under each probe ``(chapter_id, probe_id, t)``; slack of 50 ms."""
    hit = O.as_of(timed, probes, KEY, "start_sec", F.col("t") + 0.05, ["idx"], "idx", "hit")
    return hit.withColumn("idx", F.col("hit")["idx"]).drop("hit")


def neighbour_text(segments: DataFrame) -> DataFrame:
    """Tail of the nearest speech before and head of the nearest speech after."""
    order, block = _by_idx()
    speech = F.col("kind") != "sfx"
    df = O.with_blocks(segments, block)
    df = O.nearest(df, KEY, order, F.expr(f"right(text, {D.CONTEXT_CHARS})"), speech, "previous_text")
    return O.without_blocks(O.nearest(df, KEY, order, F.expr(f"left(text, {D.CONTEXT_CHARS})"), speech, "next_text", ahead=True))


def progress_before(segments: DataFrame) -> DataFrame:
    """Work finished before each segment starts."""
    order, block = _by_idx()
    weight = D.work_weight(F.col("kind"), F.col("text"), F.col("sfx_duration_sec"))
    return O.running_sums(segments, KEY, order, {"done_before": weight}, block, exclusive=True)


def speaker_labels(segments: DataFrame) -> DataFrame:
    """Show a label only where the dialogue speaker differs from the last dialogue speaker."""
    order, block = _by_idx()
    talk = F.col("kind") == "dialogue"
    df = O.nearest(segments, KEY, order, F.struct(F.col("character_id").alias("who")), talk, "last_dialogue", block)
    changed = talk & ~F.col("last_dialogue.who").eqNullSafe(F.col("character_id"))
    return df.withColumn("show_label", changed).drop("last_dialogue")


def chapter_durations(segments: DataFrame) -> DataFrame:
    return segments.groupBy("chapter_id").agg(
        F.sum(F.coalesce("duration_sec", F.lit(0.0)) + F.coalesce("pause_before_sec", F.lit(0.0))).alias("duration_sec"))


# Where a phrase may end, and the length it must have reached.
HARD_END = rf"[.!?;:…]+[\"”’)\]]*[{WS}]+"
SOFT_END = rf"[,—][\"”’)\]]*[{WS}]+"
HARD_MIN, SOFT_MIN, TAIL_MIN = 10, 48, 6


def split_phrases(text: Column) -> Column:
    """Clause-sized pieces that concatenate back to ``text``.

    The text is cut after every possible end; a fold then joins cuts until each
    piece is long enough, and a short remainder goes to the piece before it.
    """
    cuts = F.split(F.regexp_replace(text, f"({HARD_END}|{SOFT_END})", "$1\u0001"), "\u0001")
    need = lambda t: (F.when(t.rlike(f"(?:{SOFT_END})\\z"), SOFT_MIN)
                      .when(t.rlike(f"(?:{HARD_END})\\z"), HARD_MIN).otherwise(1 << 30))
    zero = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit("").alias("cur"), F.lit(False).alias("full"))

    def step(s, t):
        # A piece that reached its minimum is closed when the next cut arrives.
        cur = F.when(s["full"], t).otherwise(F.concat(s["cur"], t))
        pieces = F.when(s["full"], F.concat(s["pieces"], F.array(s["cur"]))).otherwise(s["pieces"])
        return F.struct(pieces.alias("pieces"), cur.alias("cur"), (F.length(cur) >= need(t)).alias("full"))

    return F.aggregate(cuts, zero, step, _with_remainder)


def _with_remainder(s: Column) -> Column:
    pieces, rest = s["pieces"], s["cur"]
    short = ~s["full"] & (F.length(trim_ws(rest)) < TAIL_MIN)
    return (
        F.when(F.size(pieces) == 0, F.array(rest))
        .when(rest == "", pieces)
        .when(short, F.concat(F.slice(pieces, 1, F.size(pieces) - 1), F.array(F.concat(F.element_at(pieces, -1), rest))))
        .otherwise(F.concat(pieces, F.array(rest))))


def phrase_rows(segments: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (keep, phrase_idx, phrase), without weights or times."""
    return segments.select(*keep, F.posexplode_outer(split_phrases(F.col("text"))).alias("phrase_idx", "phrase")).withColumn(
        "phrase_idx", F.col("phrase_idx").cast("long"))


def timed_phrases(timed: DataFrame) -> DataFrame:
    """One row per phrase; a segment's duration is shared by phrase weight.

    Everything happens inside the segment's own row: no shuffle.
    """
    pieces = timed.withColumn("_pieces", split_phrases(F.col("text")))
    weighed = pieces.withColumn("_w", F.transform("_pieces", D.phrase_weight))
    zero = F.array(F.lit(0).cast("long"))
    sums = F.aggregate("_w", zero, lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))
    rows = weighed.withColumn("_sum", sums).withColumn(
        "_ph", F.transform("_pieces", lambda p, i: F.struct(
            i.cast("long").alias("phrase_idx"), p.alias("phrase"), F.col("_w")[i].alias("weight"), F.col("_sum")[i].alias("before"))))
    return rows.select(
        *timed.columns, F.element_at("_sum", -1).alias("_total"), F.inline_outer("_ph")
    ).withColumns({
        "phrase_start_sec": F.col("start_sec") + F.col("duration_sec") * F.col("before") / F.col("_total"),
        "phrase_duration_sec": F.col("duration_sec") * F.col("weight") / F.col("_total"),
    }).drop("_total", "before")
