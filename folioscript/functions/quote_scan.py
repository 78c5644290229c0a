"""Quote scanner.

One pass over the marks and paragraph breaks of a text, as a small per-row
helper behind an Arrow UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from folioscript.session import travels

travels(__name__)

# White space, mark contexts, and how far a quotation may run.
SPACE = " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
OPENS_AFTER = set(SPACE) | set("([{—–-\"“")
CLOSES_BEFORE = set(SPACE) | set(".,;:!?)]}—–-\"”")
MAX_CROSSINGS = 3
MARKS = {"curly": "“”", "single": "‘’'", "straight": '"'}

SPANS = ArrayType(StructType([
    StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()),
    StructField("text", StringType()), StructField("flagged", BooleanType()), StructField("q", LongType())]))


def _letter(ch: str) -> bool:
    return ch.isascii() and ch.isalpha()


def _roles(text: str, i: int, style: str) -> tuple[bool, bool]:
    """Whether the mark at ``i`` may open and may close a quotation."""
    ch = text[i]
    if style == "curly":
        return ch == "“", ch == "”"
    if style == "straight":
        return ch == '"', ch == '"'
    before, after = text[i - 1:i], text[i + 1:i + 2]
    opens = ch in "‘'" and (not before or before in OPENS_AFTER)
    inside_word = bool(before) and bool(after) and _letter(before) and _letter(after)
    closes = ch in "’'" and not inside_word and (not after or after in CLOSES_BEFORE)
    return opens, closes


def _reopens(text: str, at: int, stop: int, style: str) -> bool:
    """Whether the paragraph ``text[at:stop]`` begins with an opening mark."""
    while at < stop and text[at] in SPACE:
        at += 1
    return at < stop and text[at] in MARKS[style] and _roles(text, at, style)[0]


def quote_pieces(text: str, style: str) -> list[tuple[str, bool, bool]]:
    """(text, is quote, flagged) pieces that concatenate back to ``text``."""
    out: list[tuple[str, bool, bool]] = []
    done = 0

    def emit(end: int, quote: bool, flagged: bool = False) -> None:
        nonlocal done
        if end > done:
            out.append((text[done:end], quote, flagged))
            done = end

    breaks = [m.span() for m in re.finditer(r"\n\n+", text)]
    events = [(i, None) for i in (m.start() for m in re.finditer(f"[{MARKS[style]}]", text))]
    for k, (end, start) in enumerate(breaks):
        stop = breaks[k + 1][0] if k + 1 < len(breaks) else len(text)
        events.append((end, (start, stop) if start < len(text) else ()))
    if not breaks or breaks[-1][1] < len(text):
        events.append((len(text), ()))
    inside, crossed = False, 0
    for at, following in sorted(events, key=lambda e: e[0]):
        if following is None:
            opens, closes = _roles(text, at, style)
            if inside and closes:
                emit(at + 1, True)
                inside = False
            elif opens:
                emit(at, inside, inside)
                inside, crossed = True, 0
        elif inside:
            if following and _reopens(text, *following, style):
                emit(at, True)
                inside = False
            elif not following or style == "straight" or crossed >= MAX_CROSSINGS:
                emit(at, True, True)
                inside = False
            else:
                crossed += 1
    emit(len(text), False)
    return out


def quote_spans(text: str, style: str) -> list[dict]:
    """Pieces with their offsets and quote ordinals."""
    spans, at, q = [], 0, 0
    for piece, quote, flagged in quote_pieces(text, style):
        spans.append({"kind": "quote" if quote else "narration", "start": at, "end": at + len(piece),
                      "text": piece, "flagged": flagged, "q": q if quote else None})
        at += len(piece)
        q += quote
    return spans


@F.pandas_udf(SPANS)
def scan_quotes(texts: pd.Series, styles: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else quote_spans(t, s) for t, s in zip(texts, styles)], dtype=object)
