"""Text normalisation, titles and chapter cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscript.functions.js import WS, collapse_ws, first_char_upper, let, rtrim_ws, trim_ws

# Limits of the ingestion gate and of title handling.
MAX_BYTES = 30 * 1024 * 1024
MIN_CHARS = 100
TITLE_LINE_MAX = 60
EMPHASIS = r"_((?:(?!\n\n)[^_]){1,400})_"
KEPT_PAIR = r"(_[^_]{1,400}_)"
TITLE_WORDS = "chapter|part|book|canto|act|stave"


def strip_emphasis(c: Column) -> Column:
    """Drop ``_emphasis_`` marks; a pair around a blank line stays and is skipped whole.

    The second branch matches such a pair, so its closing mark cannot open another.
    """
    return F.regexp_replace(c, rf"{EMPHASIS}|{KEPT_PAIR}", "$1$2")


def normalize(raw: Column) -> Column:
    t = F.regexp_replace(raw, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip_emphasis(trim_ws(t))


def title_from_file_name(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)\z", 1)
    stem = F.when(base.rlike(r"^.+\.[^.]*\z"), F.regexp_replace(base, r"\.[^.]*\z", "")).otherwise(base)
    return collapse_ws(F.regexp_replace(stem, r"[-_]+", " "))


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]*)\z", 1))


def reject_reason(name: Column, n_bytes: Column, text: Column) -> Column:
    """Why an input file is refused, or null when it is good."""
    ext = file_extension(name)
    return (
        F.when(n_bytes > MAX_BYTES, "too_large")
        .when(ext == ".doc", "legacy_doc")
        .when(~ext.isin(".txt", ".md"), "unsupported_file")
        .when(text.isNull() | (F.length(text) < MIN_CHARS), "empty_extraction")
    )


def roman_to_int(c: Column) -> Column:
    """Value of a roman numeral without a validity check; null unless positive.

    Each letter counts negative when the letter right of it is worth more.
    """
    values = F.create_map(*[F.lit(x) for kv in
                            {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in kv])
    worth = F.transform(F.split(F.lower(c), ""), lambda ch: values[ch])
    following = F.concat(F.slice(worth, 2, F.size(worth)), F.array(F.lit(0)))
    signed = F.zip_with(worth, following, lambda a, b: F.when(a < b, -a).otherwise(a))
    total = F.aggregate(signed, F.lit(0), lambda s, v: s + v)
    return F.when(total > 0, total)


def title_announcement(title: Column) -> Column:
    """Spoken form of a chapter title; null for generated titles."""
    return let(collapse_ws(title), _announce)


def _announce(t: Column) -> Column:
    silent = (t == "") | t.rlike(r"(?i)^(?:section \d+|front matter)\z")
    numbered = rf"(?i)^({TITLE_WORDS})([{WS}.:]+)([ivxlcdm]+)\b"
    word, gap, numeral = (F.regexp_extract(t, numbered, k) for k in (1, 2, 3))
    after = t.substr(F.length(word) + F.length(gap) + F.length(numeral) + 1, F.length(t))
    spoken = F.when(
        t.rlike(numbered),
        let(roman_to_int(numeral), lambda n: F.when(
            n.isNotNull(), F.concat(first_char_upper(word), F.lit(" "), n.cast("string"), after)).otherwise(t)),
    ).otherwise(t)
    keyword = rf"(?i)^({TITLE_WORDS})\b"
    spoken = let(spoken, lambda s: let(F.regexp_extract(s, keyword, 1), lambda k: F.when(
        k != "", F.concat(first_char_upper(k), s.substr(F.length(k) + 1, F.length(s)))).otherwise(s)))
    spoken = F.regexp_replace(spoken, rf"[{WS}]*[—–][{WS}]*", ". ")
    return F.when(~silent, F.concat(F.regexp_replace(spoken, rf"[.:{WS}]+\z", ""), F.lit(".")))


def match_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def clean_chapter(text: Column, title: Column) -> Column:
    """Strip emphasis and drop a first line that repeats the end of the title."""
    out = strip_emphasis(text)
    first = trim_ws(F.regexp_extract(out, rf"\A[{WS}]*([^\n]*)", 1))
    form = match_form(first)
    repeats = (form != "") & (F.length(first) <= TITLE_LINE_MAX) & F.endswith(match_form(title), form)
    body = F.regexp_replace(out, rf"\A[{WS}]*[^\n]*(?:\n|\z)", "")
    return trim_ws(F.when(repeats, body).otherwise(out))


def opening_excerpt(text: Column, head: int = 3000, tail: int = 1000) -> tuple[Column, Column]:
    """First ``head`` characters, and the last ``tail`` when the text is longer than both."""
    return F.left(text, F.lit(head)), F.when(F.length(text) > head + tail, F.right(text, F.lit(tail))).otherwise("")


def safe_file_name(title: Column, fallback: Column) -> Column:
    name = F.substring(trim_ws(F.regexp_replace(title, rf"[^\w{WS}-]", "")), 1, 80)
    return F.when(name == "", fallback).otherwise(name)
