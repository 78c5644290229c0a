"""Small rule tables and the column expressions that apply them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscript.functions.js import WS, clamp, round_half_up, rtrim_ws, trim_ws

# Limits and rates.
SAMPLE_RATE = 44_100
FRAME_SAMPLES = 1_152
FRAME_SEC = FRAME_SAMPLES / SAMPLE_RATE
BITRATE_BPS = 128_000
MAX_PAUSE_SEC = 1.5
DEFAULT_SFX_SECONDS = 3
SFX_CREDITS_PER_SEC = 11
HALF_RATE_MODEL = "eleven_flash_v2_5"
V3_MODEL = "eleven_v3"
CONTEXT_CHARS = 250
MODEL_LIMITS = {
    "eleven_multilingual_v2": 9_500, "eleven_flash_v2_5": 38_000,
    "eleven_turbo_v2_5": 38_000, "eleven_v3": 4_500,
}
DEFAULT_MODEL_LIMIT = 9_500

# Delivery name, inline tag, stability / style / speed delta.
DELIVERIES = [
    ("whisper", "[whispers]", 0.05, 0.1, -0.05),
    ("shout", "[shouting]", -0.2, 0.3, 0.03),
    ("angry", "[angry]", -0.2, 0.3, 0.02),
    ("fearful", "[fearful]", -0.15, 0.25, 0.04),
    ("sad", "[sad]", -0.1, 0.2, -0.05),
    ("excited", "[excited]", -0.2, 0.25, 0.05),
    ("tender", "[gently]", -0.05, 0.15, -0.03),
    ("sarcastic", "[sarcastic]", -0.1, 0.25, 0.0),
    ("urgent", "[urgently]", -0.15, 0.2, 0.05),
    ("weary", "[tired]", -0.05, 0.15, -0.05),
    ("amused", "[amused]", -0.1, 0.2, 0.02),
    ("solemn", "[solemnly]", 0.05, 0.1, -0.04),
]
DELIVERY_NAMES = [d[0] for d in DELIVERIES]

# Voice settings before any pick is applied.
NARRATOR_STABILITY = 0.65
DEFAULT_STABILITY = 0.5
DEFAULT_SIMILARITY = 0.75
DEFAULT_STYLE = 0.0
DEFAULT_SPEED = 1.0

# Accent families in match order.
ACCENT_FAMILIES = [
    ("caribbean", r"jamaic|caribbean|trinidad|bajan|west indian|creole"),
    ("irish", r"irish|ireland"),
    ("scottish", r"scottish|scotland|glasw"),
    ("welsh", r"welsh|wales"),
    ("australian", r"australia|aussie|new zealand|kiwi"),
    ("british", r"british|england|\benglish\b|london|cockney|yorkshire|received pronunciation|\brp\b"),
    ("american", r"american|\bu\.?s\.?\b|southern us|new york|texan|californ|midwest|canadian"),
    ("indian", r"india|indian"),
    ("french", r"french|france"),
    ("german", r"german|germany"),
    ("russian", r"russian|russia|slavic"),
    ("spanish", r"spanish|spain|mexic|latin|hispanic"),
    ("italian", r"italian|italy"),
    ("african", r"african|nigeria|ghana|kenya|south africa"),
]
# Age words, in match order.
AGE_OLD = r"elder|senior|\bold|\b[6-9]0s?\b"
AGE_MIDDLE = r"middle|\b[45]0s?\b"
AGE_YOUNG = r"child|kid|teen|young|\b[12]0s?\b|\b1?[0-9]\b"
# Punctuation classes and the silence they ask for, in seconds.
CLOSERS = "[\"”’')\\]]*"
SENTENCE_END = rf"[.!?…]{CLOSERS}\z"
CLAUSE_END = rf"[,;:]{CLOSERS}\z"
PAUSE_SFX, PAUSE_PARAGRAPH, PAUSE_TURN, PAUSE_SENTENCE, PAUSE_CLAUSE, PAUSE_TIGHT = 0.6, 0.7, 0.45, 0.35, 0.18, 0.08


def age_bucket_of_text(c: Column) -> Column:
    t = F.lower(c)
    return (F.when(t.rlike(AGE_OLD), "old").when(t.rlike(AGE_MIDDLE), "middle").when(t.rlike(AGE_YOUNG), "young"))


def age_bucket_of_voice(c: Column) -> Column:
    t = F.lower(c)
    return F.when(t.contains("young"), "young").when(t.contains("old"), "old").when(t.contains("middle"), "middle")


def accent_family(c: Column) -> Column:
    t = F.lower(c)
    (name, pattern), *rest = ACCENT_FAMILIES
    out = F.when(t.rlike(pattern), name)
    for name, pattern in rest:
        out = out.when(t.rlike(pattern), name)
    return out


def gender_clash(character: Column, voice: Column) -> Column:
    v = F.lower(F.coalesce(voice, F.lit("")))
    return character.isin("male", "female") & v.isin("male", "female") & (character != v)


def age_clash(character_bucket: Column, voice_bucket: Column) -> Column:
    a, b = character_bucket, voice_bucket
    return F.coalesce(((a == "old") & (b == "young")) | ((a == "young") & (b == "old")), F.lit(False))


def speech_credits(chars: Column, model: Column) -> Column:
    return F.ceil(chars * F.when(model == HALF_RATE_MODEL, 0.5).otherwise(1.0)).cast("long")


def sfx_credits(seconds: Column) -> Column:
    return F.ceil(seconds * SFX_CREDITS_PER_SEC).cast("long")


def work_weight(kind: Column, text: Column, sfx_sec: Column) -> Column:
    return F.when(kind == "sfx", sfx_credits(F.coalesce(sfx_sec, F.lit(float(DEFAULT_SFX_SECONDS))))).otherwise(
        F.length(text).cast("long"))


def target_pause(prev_kind: Column, prev_text: Column, prev_speaker: Column, prev_is_title: Column,
                 kind: Column, speaker: Column, para_break: Column) -> Column:
    """Silence wanted before a segment; 0 at chapter start (no previous kind)."""
    tail = rtrim_ws(prev_text)
    return (
        F.when(prev_kind.isNull() | prev_is_title, 0.0)
        .when((prev_kind == "sfx") | (kind == "sfx"), PAUSE_SFX)
        .when(para_break, PAUSE_PARAGRAPH)
        .when(tail.rlike(SENTENCE_END), F.when(prev_speaker.eqNullSafe(speaker), PAUSE_SENTENCE).otherwise(PAUSE_TURN))
        .when(tail.rlike(CLAUSE_END), PAUSE_CLAUSE)
        .otherwise(PAUSE_TIGHT)
    )


def inserted_pause(target: Column) -> Column:
    """Clamp to the ceiling and round to whole frames; never negative."""
    frames = F.floor(F.least(target, F.lit(MAX_PAUSE_SEC)) / F.lit(FRAME_SEC) + 0.5)
    return F.when(frames > 0, frames * F.lit(FRAME_SEC)).otherwise(0.0)


def bytes_to_seconds(n: Column) -> Column:
    return n * 8 / F.lit(float(BITRATE_BPS))


def phrase_weight(piece: Column) -> Column:
    """Speech length of a phrase: collapsed characters plus a pause bonus."""
    chars = F.length(trim_ws(F.regexp_replace(piece, rf"[{WS}]+", " ")))
    close = r'["”’)\]]*'
    bonus = (F.when(piece.rlike(rf"[.!?…]{close}[{WS}]*\z"), 18)
             .when(piece.rlike(rf"[,;:—]{close}[{WS}]*\z"), 7).otherwise(0))
    return (F.greatest(chars, F.lit(1)) + bonus).cast("long")


def snapped_stability(c: Column) -> Column:
    return F.when(c < 0.25, 0.0).when(c < 0.75, 0.5).otherwise(1.0)


def nudged_settings(stability: Column, style: Column, speed: Column,
                    d_stability: Column, d_style: Column, d_speed: Column) -> tuple[Column, Column, Column]:
    """Settings after a delivery delta, clamped and rounded to 2 places; unchanged without one."""
    none = d_stability.isNull()
    r = lambda c: round_half_up(c, 2)
    return (
        F.when(none, stability).otherwise(r(clamp(stability + d_stability, 0.0, 1.0))),
        F.when(none, style).otherwise(r(clamp(style + d_style, 0.0, F.greatest(F.lit(0.4), style)))),
        F.when(none, speed).otherwise(r(clamp(speed + d_speed, 0.85, 1.1))),
    )


def model_limit(model: Column) -> Column:
    out = None
    for name, limit in MODEL_LIMITS.items():
        out = F.when(model == name, limit) if out is None else out.when(model == name, limit)
    return out.otherwise(DEFAULT_MODEL_LIMIT)
