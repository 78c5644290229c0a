"""Queries over clip timing, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscript.functions import domains as D
from folioscript.operators import cost as C
from folioscript.operators import ordered as O
from folioscript.operators import quality as QA
from folioscript.operators import timeline as T
from folioscript.session import cut_lineage
from folioscript.sources.derived import LINE_SEGMENTS_SQL, PLAYHEADS_SQL, line_segments, playheads
from folioscript.sources.model import Model
from folioscript.sources.sql_model import WS, with_model

_r6 = lambda c: F.round(c, 6)

CLOSE = "[\"”’'')\\]]*"
PREV = "lag({0}) OVER (PARTITION BY chapter_id ORDER BY idx)"

PAUSE_SQL = f"""
  SELECT chapter_id, idx, target_sec, CASE WHEN NOT has_prev THEN 0.0
     ELSE greatest(floor(least(target_sec - ptail - lead_sec, 1.5) / (1152 / 44100.0::DOUBLE) + 0.5), 0) * (1152 / 44100.0::DOUBLE) END AS inserted_sec
  FROM (SELECT *, CASE WHEN pkind IS NULL OR ptitle THEN 0.0 WHEN pkind = 'sfx' OR kind = 'sfx' THEN 0.6
      WHEN para_break_before THEN 0.7
      WHEN regexp_matches(ptext, '[.!?…]{CLOSE}$') THEN CASE WHEN pchar IS NOT DISTINCT FROM character_id THEN 0.35 ELSE 0.45 END
      WHEN regexp_matches(ptext, '[,;:]{CLOSE}$') THEN 0.18 ELSE 0.08 END::DOUBLE AS target_sec
    FROM (SELECT *, lag(kind) OVER w AS pkind, regexp_replace(lag(text) OVER w, '[{WS}]+$', '') AS ptext,
            lag(character_id) OVER w AS pchar, coalesce(lag(is_title) OVER w, false) AS ptitle,
            lag(tail_sec) OVER w AS ptail, lag(kind) OVER w IS NOT NULL AS has_prev
          FROM segments WINDOW w AS (PARTITION BY chapter_id ORDER BY idx)))"""

TIMED_CTE = """SELECT s.*, coalesce(c.intro_duration_sec, 0.0)
      + sum(coalesce(pause_before_sec, 0.0) + s.duration_sec) OVER (PARTITION BY s.chapter_id ORDER BY s.idx) - s.duration_sec AS start_sec
  FROM segments s JOIN chapters c ON c.id = s.chapter_id
  WHERE chapter_id NOT IN (SELECT chapter_id FROM segments WHERE duration_sec IS NULL OR audio_path IS NULL)"""

WEIGHT = ("CASE WHEN kind = 'sfx' THEN CAST(ceil(coalesce(sfx_duration_sec, 3.0)::DOUBLE * 11) AS BIGINT) ELSE length(text) END")

HARD = f"[.!?;:…]+[\"”’)\\]]*[{WS}]+"
SOFT = f"[,—][\"”’)\\]]*[{WS}]+"

PHRASE_CTES = {
    "lines": LINE_SEGMENTS_SQL,
    "cuts": f"""SELECT chapter_id, idx, unnest(c) AS t, generate_subscripts(c, 1) AS i, len(c) AS n FROM (
        SELECT chapter_id, idx, string_split(regexp_replace(text, '({HARD.replace("'", "''")}|{SOFT})', '\\1' || chr(1), 'g'), chr(1)) AS c FROM lines)""",
    "fold": f"""SELECT chapter_id, idx, i, n, 0 AS piece, t AS cur,
          CASE WHEN length(t) >= CASE WHEN regexp_matches(t, '({SOFT})$') THEN 48 WHEN regexp_matches(t, '({HARD})$') THEN 10 ELSE 1000000000 END THEN true ELSE false END AS closed
        FROM cuts WHERE i = 1
        UNION ALL
        SELECT chapter_id, idx, i, n, piece, cur, length(cur) >= need FROM (
          SELECT c.chapter_id, c.idx, c.i, c.n, CASE WHEN f.closed THEN f.piece + 1 ELSE f.piece END AS piece,
             CASE WHEN f.closed THEN c.t ELSE f.cur || c.t END AS cur,
             CASE WHEN regexp_matches(c.t, '({SOFT})$') THEN 48 WHEN regexp_matches(c.t, '({HARD})$') THEN 10 ELSE 1000000000 END AS need
          FROM fold f JOIN cuts c ON c.chapter_id = f.chapter_id AND c.idx = f.idx AND c.i = f.i + 1)""",
    "raw_pieces": """SELECT chapter_id, idx, piece, arg_max(cur, i) AS p, arg_max(closed, i) AS closed FROM fold
        GROUP BY 1, 2, 3 HAVING arg_max(cur, i) <> ''""",
    "glued": f"""SELECT chapter_id, idx, CASE WHEN NOT closed AND piece > 0 AND length(regexp_replace(p, '^[{WS}]+|[{WS}]+$', '', 'g')) < 6
          THEN piece - 1 ELSE piece END AS piece, p, piece AS o FROM raw_pieces""",
    "pieces": "SELECT chapter_id, idx, CAST(piece AS BIGINT) AS phrase_idx, string_agg(p, '' ORDER BY o) AS phrase FROM glued GROUP BY 1, 2, 3",
    "weighed": f"""SELECT *, greatest(length(regexp_replace(regexp_replace(phrase, '[{WS}]+', ' ', 'g'), '^ +| +$', '', 'g')), 1)
          + CASE WHEN regexp_matches(phrase, '[.!?…]["”’)\\]]*[{WS}]*$') THEN 18
                 WHEN regexp_matches(phrase, '[,;:—]["”’)\\]]*[{WS}]*$') THEN 7 ELSE 0 END AS weight FROM pieces""",
}


def pause_policy(spark, d):
    return T.pauses(Model(spark, d).segments).select("chapter_id", "idx", "target_sec", _r6("inserted_sec").alias("inserted_sec"))


def segment_start_times(spark, d):
    m = Model(spark, d)
    return T.start_times(m.segments, m.chapters).select("chapter_id", "idx", _r6("start_sec").alias("start_sec"), "duration_sec")


def playhead_lookup(spark, d):
    m = Model(spark, d)
    timed = cut_lineage(T.start_times(m.segments, m.chapters).select("chapter_id", "idx", "start_sec"), "timeline")
    return T.playhead_segment(timed, playheads(m)).select("probe_id", "chapter_id", "t", "idx")


def neighbour_context(spark, d):
    return T.neighbour_text(Model(spark, d).segments).select("chapter_id", "idx", "previous_text", "next_text")


def running_progress(spark, d):
    return T.progress_before(Model(spark, d).segments).select("chapter_id", "idx", "done_before")


def dialogue_labels(spark, d):
    return T.speaker_labels(Model(spark, d).segments).select("chapter_id", "idx", "show_label")


def chapter_duration(spark, d):
    return T.chapter_durations(Model(spark, d).segments).select("chapter_id", F.round("duration_sec", 4).alias("duration_sec"))


def duration_mismatch(spark, d):
    """Playable chapters whose stored length is not that of their clips and pauses."""
    m = Model(spark, d)
    stored = m.timed_chapters.filter("duration_sec IS NOT NULL").select(F.col("id").alias("chapter_id"), F.col("duration_sec").alias("stored_sec"))
    return QA.duration_mismatch(T.chapter_durations(m.segments), stored, 1e-6)


def phrase_split(spark, d):
    return T.phrase_rows(line_segments(Model(spark, d)), ["chapter_id", "idx"])


def phrase_timing(spark, d):
    segs = line_segments(Model(spark, d))
    return T.timed_phrases(segs).select(
        "chapter_id", "idx", "phrase_idx", "weight", _r6("phrase_start_sec").alias("start_sec"),
        _r6("phrase_duration_sec").alias("duration_sec"))


def script_stats(spark, d):
    return C.script_stats(Model(spark, d).segments).withColumn("sfx_seconds", F.round("sfx_seconds", 4))


def credit_estimate(spark, d):
    m = Model(spark, d)
    return C.chapter_credits(m.segments, m.chapters, m.books)


def work_totals(spark, d):
    return C.work_totals(Model(spark, d).segments)


QUERIES = {
    "pause_policy": (pause_policy, with_model(f"SELECT chapter_id, idx, target_sec, round(inserted_sec, 6) AS inserted_sec FROM ({PAUSE_SQL})")),
    "segment_start_times": (segment_start_times, with_model(
        "SELECT chapter_id, idx, round(start_sec, 6) AS start_sec, duration_sec FROM timed", {"timed": TIMED_CTE})),
    "playhead_lookup": (playhead_lookup, with_model(
        """SELECT p.probe_id, p.chapter_id, p.t, s.idx FROM playheads p LEFT JOIN (SELECT chapter_id, idx, start_sec FROM timed) s
           ON s.chapter_id = p.chapter_id AND s.start_sec <= p.t + 0.05
           QUALIFY row_number() OVER (PARTITION BY p.probe_id ORDER BY s.idx DESC NULLS LAST) = 1""",
        {"timed": TIMED_CTE, "playheads": PLAYHEADS_SQL})),
    "neighbour_context": (neighbour_context, with_model(
        """SELECT chapter_id, idx,
             right(last_value(CASE WHEN kind <> 'sfx' THEN text END IGNORE NULLS) OVER (PARTITION BY chapter_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 250) AS previous_text,
             left(first_value(CASE WHEN kind <> 'sfx' THEN text END IGNORE NULLS) OVER (PARTITION BY chapter_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 250) AS next_text
           FROM segments""")),
    "running_progress": (running_progress, with_model(
        f"""SELECT chapter_id, idx, CAST(coalesce(sum({WEIGHT}) OVER (PARTITION BY chapter_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS done_before FROM segments""")),
    "dialogue_labels": (dialogue_labels, with_model(
        """SELECT chapter_id, idx, kind = 'dialogue' AND coalesce(character_id <> lastc, true) AS show_label FROM (
             SELECT *, last_value(CASE WHEN kind = 'dialogue' THEN character_id END IGNORE NULLS) OVER (PARTITION BY chapter_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastc FROM segments)""")),
    "chapter_duration": (chapter_duration, with_model(
        "SELECT chapter_id, round(sum(coalesce(duration_sec, 0.0) + coalesce(pause_before_sec, 0.0)), 4) AS duration_sec FROM segments GROUP BY 1")),
    "duration_mismatch": (duration_mismatch, with_model(
        """SELECT s.chapter_id, round((sum(coalesce(s.duration_sec, 0.0) + coalesce(s.pause_before_sec, 0.0)) - max(c.duration_sec))::DOUBLE, 6) AS off_by_sec
           FROM segments s JOIN timed_chapters c ON c.id = s.chapter_id WHERE c.status = 'stale' GROUP BY 1""")),
    "phrase_split": (phrase_split, with_model("SELECT chapter_id, idx, phrase_idx, phrase FROM pieces", PHRASE_CTES, recursive=True)),
    "phrase_timing": (phrase_timing, with_model(
        """SELECT w.chapter_id, w.idx, phrase_idx, weight,
             round(start_sec + duration_sec * (sum(weight) OVER (PARTITION BY w.chapter_id, w.idx ORDER BY phrase_idx) - weight)
               / sum(weight) OVER (PARTITION BY w.chapter_id, w.idx), 6) AS start_sec,
             round(duration_sec * weight / sum(weight) OVER (PARTITION BY w.chapter_id, w.idx), 6) AS duration_sec
           FROM weighed w JOIN lines l ON l.chapter_id = w.chapter_id AND l.idx = w.idx""", PHRASE_CTES, recursive=True)),
    "script_stats": (script_stats, with_model(
        """SELECT chapter_id, count(*) AS segment_count, count(*) FILTER (WHERE kind = 'dialogue') AS dialogue_count,
             count(*) FILTER (WHERE flagged) AS flagged_count,
             CAST(sum(CASE WHEN kind = 'sfx' THEN 0 ELSE length(text) END) AS BIGINT) AS speech_chars,
             round(sum(CASE WHEN kind = 'sfx' THEN coalesce(sfx_duration_sec, 3.0)::DOUBLE ELSE 0.0 END), 4) AS sfx_seconds
           FROM segments GROUP BY 1""")),
    "credit_estimate": (credit_estimate, with_model(
        """SELECT s.chapter_id, b.render_model,
             CAST(ceil(sum(CASE WHEN kind = 'sfx' THEN 0 ELSE length(text) END) * CASE WHEN render_model = 'eleven_flash_v2_5' THEN 0.5 ELSE 1.0 END)
              + ceil(round(sum(CASE WHEN kind = 'sfx' THEN coalesce(sfx_duration_sec, 3.0)::DOUBLE ELSE 0.0 END), 6) * 11) AS BIGINT) AS credits
           FROM segments s JOIN chapters c ON c.id = s.chapter_id JOIN books b ON b.id = c.book_id GROUP BY 1, 2""")),
    "work_totals": (work_totals, with_model(f"SELECT chapter_id, CAST(sum({WEIGHT}) AS BIGINT) AS total FROM segments GROUP BY 1")),
}
