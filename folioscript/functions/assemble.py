"""Linear passes over the ordered parts of one chapter, behind Arrow UDFs.

Each helper walks a chapter's list once and joins text once at the end of a part,
so its time grows with the chapter's length. Spark's higher-order folds copy
their list and their buffer at every step instead.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from folioscript.functions.quote_scan import SPACE
from folioscript.session import travels

travels(__name__)
SEGMENT = "struct<kind:string,character_id:bigint,text:string,flagged:boolean,prose:boolean>"
_SEGMENT = pa.list_(pa.struct([("kind", pa.string()), ("character_id", pa.int64()), ("text", pa.string()), ("flagged", pa.bool_()), ("prose", pa.bool_())]))
_FLAGS = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("para_break_before", pa.bool_()), ("space_before", pa.bool_()), ("is_title", pa.bool_())]))
_BLOCK = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
GAP = re.compile(rf"\n[{SPACE}]*\n")


def segments_of(spans: list[dict], answers: list[dict], pov: int | None) -> list[dict]:
    """Segments of a chapter: text between spoken lines flows into one narration.

    A spoken line joins the line before it when only white space lies between and
    the speaker is the same. Answers are in quote order.
    """
    out: list[dict] = []
    held: list[str] = []
    doubt, nth = False, 0

    def put(kind, who, text, flagged, prose):
        out.append({"kind": kind, "character_id": who, "text": [text], "flagged": flagged, "prose": prose})

    def narrate(text):
        if text.strip(SPACE):
            put("narration", pov, text.strip(SPACE), doubt, True)

    for span in spans:
        quote = span["kind"] == "quote"
        answer = answers[nth] if quote and nth < len(answers) and answers[nth]["q"] == span["q"] else None
        nth += answer is not None
        low = bool(answer and answer["low"])
        if not quote or (answer and answer["is_dialogue"] is False):
            doubt = doubt or (quote and (span["flagged"] or low))
            held.append(span["text"])
            continue
        between = "".join(held)
        who = answer["found"] if answer and answer["found"] is not None else pov
        flagged = span["flagged"] or answer is None or low or bool(answer["unknown"])
        last = out[-1] if out else None
        if last and not between.strip(SPACE) and last["kind"] == "dialogue" and who is not None and last["character_id"] == who:
            last["text"] += [between or " ", span["text"]]
            last["flagged"] = last["flagged"] or flagged
        else:
            narrate(between)
            put("narration" if who is None else "dialogue", who, span["text"], flagged, False)
        held, doubt = [], False
    narrate("".join(held))
    for seg in out:
        seg["text"] = "".join(seg["text"])
    return out


class Finder:
    """``text.find`` for many needles, most of which may be missing: after some misses a needle is looked up by its first characters."""

    MISSES, HEAD = 8, 12

    def __init__(self, text: str):
        self.text, self.missed, self.places = text, 0, None

    def find(self, needle: str, start: int) -> int:
        if self.missed < self.MISSES or len(needle) < self.HEAD:
            at = self.text.find(needle, start)
            self.missed += at < 0
            return at
        if self.places is None:
            self.places = {}
            for i in range(len(self.text) - self.HEAD + 1):
                self.places.setdefault(self.text[i : i + self.HEAD], []).append(i)
        here = self.places.get(needle[: self.HEAD], ())
        for at in here[bisect_left(here, start) :]:
            if self.text.startswith(needle, at):
                return at
        return -1


def boundaries_of(text: str, announcement: str | None, segments: list[dict]) -> list[dict]:
    """Kind, text and boundary flags per segment, found by walking the text forward.

    A segment that is not found degrades to a paragraph break for narration and a
    space otherwise, and does not move the walk on.
    """
    out, cursor, matched, finder = [], 0, False, Finder(text)
    for seg in segments:
        title = seg["kind"] == "narration" and seg["text"] == announcement
        outside = title or seg["kind"] == "sfx"
        at = -1 if outside else finder.find(seg["text"], cursor)
        if outside:
            opens, space = True, False
        elif at < 0:
            opens = seg["kind"] == "narration"
            space = not opens
        else:
            opens = not matched or bool(GAP.search(text, cursor, at))
            space = not opens and at > cursor
            cursor, matched = at + len(seg["text"]), True
        out.append({"kind": seg["kind"], "text": seg["text"], "para_break_before": opens, "space_before": space, "is_title": title})
    return out


def blocks_of(bits: list[dict]) -> list[dict]:
    """Page blocks: titles and effects stand alone, phrases run on until one that starts a paragraph."""
    out: list[dict] = []
    held: list[str] = []
    shown = False

    def close():
        if shown:
            out.append({"kind": "para", "text": "".join(held)})

    for bit in bits:
        some = bool(bit["text"].strip(SPACE))
        text = bit["text"] if some else ""
        if bit["kind"] != "para":
            close()
            out.append({"kind": bit["kind"], "text": bit["text"]})
            held, shown = [], False
        elif bit["starts"]:
            close()
            held, shown = [text], some
        else:
            held += [" " if bit["space"] and shown else "", text]
            shown = shown or some
    close()
    return out


def passages_of(text: str, spans: list[dict], chunks: list[dict], pad: int) -> list[str]:
    """Marked passage of each chunk of quotes; chunks and spans are both in order."""
    out, k = [], 0
    for c in chunks:
        lo, hi = max(0, c["start"] - pad), min(len(text), c["stop"] + pad)
        while k < len(spans) and spans[k]["start"] < c["start"]:
            k += 1
        marked = []
        while k < len(spans) and spans[k]["end"] <= c["stop"]:
            s = spans[k]
            marked.append(f"⟦{s['q']}⟧{s['text']}⟦/{s['q']}⟧" if s["kind"] == "quote" else s["text"])
            k += 1
        out.append(("…" if lo > 0 else "") + text[lo : c["start"]] + "".join(marked) + text[c["stop"] : hi] + ("…" if hi < len(text) else ""))
    return out


def tiles(text: str, spans: list[dict]) -> bool:
    """Whether the spans, in order, cover the text without gap or overlap and each holds its own slice."""
    at = 0
    for s in spans:
        if s["start"] != at or s["end"] < at or s["text"] != text[at : s["end"]]:
            return False
        at = s["end"]
    return at == len(text)


@F.arrow_udf(from_arrow_type(pa.bool_()))
def spans_tile(text: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([tiles(t or "", s or []) for t, s in zip(text.to_pylist(), spans.to_pylist())], pa.bool_())


@F.arrow_udf(from_arrow_type(_SEGMENT))
def fold_spans(spans: pa.Array, answers: pa.Array, pov: pa.Array) -> pa.Array:
    return pa.array([None if s is None else segments_of(s, a or [], p) for s, a, p in zip(spans.to_pylist(), answers.to_pylist(), pov.to_pylist())], _SEGMENT)


@F.arrow_udf(from_arrow_type(_FLAGS))
def find_boundaries(text: pa.Array, announcement: pa.Array, segments: pa.Array) -> pa.Array:
    return pa.array([None if s is None else boundaries_of(t or "", a, s) for t, a, s in zip(text.to_pylist(), announcement.to_pylist(), segments.to_pylist())], _FLAGS)


@F.arrow_udf(from_arrow_type(_BLOCK))
def gather_blocks(bits: pa.Array) -> pa.Array:
    return pa.array([None if b is None else blocks_of(b) for b in bits.to_pylist()], _BLOCK)


@F.arrow_udf(from_arrow_type(pa.list_(pa.string())))
def mark_passages(text: pa.Array, spans: pa.Array, chunks: pa.Array, pad: pa.Array) -> pa.Array:
    rows = zip(text.to_pylist(), spans.to_pylist(), chunks.to_pylist(), pad.to_pylist())
    return pa.array([None if s is None else passages_of(t or "", s, c or [], n) for t, s, c, n in rows], pa.list_(pa.string()))
