"""Greedy packing of ordered items into bounded groups, inside one row.

An ordered fold per document: it needs no shuffle and documents run in
parallel. The fold keeps only the cut list, not a copy of the items, so its
cost is items + groups², and a document is bounded by the ingestion size gate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscript.functions.js import WS, is_blank

ALL = 1 << 30
CUTS = "array<struct<first:int,skip:int,cnt:int,take:int>>"


@dataclass(frozen=True)
class Packing:
    """``limit`` per group; ``test_sep`` characters are added in the limit test.

    ``joiner`` glues items; ``hard`` cuts an oversize item at the limit;
    ``whole`` passes a text within the limit through untouched; ``drop_blank``
    drops a blank last group (otherwise only an empty one).
    """

    limit: int
    test_sep: int
    joiner: str
    separator: str
    hard: bool = False
    whole: bool = True
    drop_blank: bool = True


# The five packings.
SECTIONS = Packing(14_000, 0, "\n\n", r"\n\n+", whole=False)
ANALYSIS_CHUNKS = Packing(24_000, 2, "\n\n", r"\n\n+", hard=True)
NARRATION = Packing(2_800, 2, "\n\n", r"\n\n+")
SENTENCE_GAP = rf"(?<=[.!?…\"'”’])[{WS}]+"


def model_pieces(limit: int) -> Packing:
    return Packing(limit, 1, " ", SENTENCE_GAP, hard=True, drop_blank=False)


def cut_list(sizes: Column, limit: Column, test_sep: int, join_len: int, hard: bool) -> Column:
    """Cuts as (first item, chars to skip, item count, chars to take)."""
    zero = F.struct(F.array().cast(CUTS).alias("cuts"), F.lit(0).alias("i"), F.lit(0).alias("first"),
                    F.lit(0).alias("skip"), F.lit(0).alias("cnt"), F.lit(0).alias("len"))

    def cut(first, skip, cnt, take):
        return F.struct(first.alias("first"), skip.alias("skip"), cnt.alias("cnt"), F.lit(take).cast("int").alias("take")
                        if isinstance(take, int) else take.cast("int").alias("take"))

    def place(s, n):
        fresh = s["len"] == 0
        full = ~fresh & (s["len"] + n + test_sep > limit)
        starts = fresh | full
        return F.struct(
            F.when(full, F.concat(s["cuts"], F.array(cut(s["first"], s["skip"], s["cnt"], ALL)))).otherwise(s["cuts"]).alias("cuts"),
            (s["i"] + 1).alias("i"),
            F.when(starts, s["i"]).otherwise(s["first"]).alias("first"),
            F.when(starts, 0).otherwise(s["skip"]).alias("skip"),
            F.when(starts, 1).otherwise(s["cnt"] + 1).alias("cnt"),
            F.when(starts, n).otherwise(s["len"] + join_len + n).alias("len"))

    def split_oversize(s):
        extra = (F.ceil(s["len"] / limit) - 1).cast("int")
        slices = F.transform(F.sequence(F.lit(0), extra - 1),
                             lambda j: cut(s["first"], s["skip"] + j * limit, s["cnt"], limit))
        over = s["len"] > limit
        return F.struct(
            F.when(over, F.concat(s["cuts"], slices)).otherwise(s["cuts"]).alias("cuts"), s["i"], s["first"],
            F.when(over, s["skip"] + extra * limit).otherwise(s["skip"]).alias("skip"), s["cnt"],
            F.when(over, s["len"] - extra * limit).otherwise(s["len"]).alias("len"))

    def step(s, n):
        placed = place(s, n)
        return F.transform(F.array(placed), split_oversize)[0] if hard else placed

    return F.aggregate(
        sizes, zero, step,
        lambda s: F.when(s["len"] > 0, F.concat(s["cuts"], F.array(cut(s["first"], s["skip"], s["cnt"], ALL)))).otherwise(s["cuts"]))


def _texts(items: Column, cuts: Column, joiner: str) -> Column:
    def text(c):
        joined = F.array_join(F.slice(items, c["first"] + 1, c["cnt"]), joiner)
        return F.when((c["skip"] == 0) & (c["take"] == ALL), joined).otherwise(joined.substr(c["skip"] + 1, c["take"]))

    return F.transform(cuts, text)


def pack_text(text: Column, p: Packing, limit: Column | None = None) -> Column:
    """Array of packed pieces of ``text``."""
    limit = F.lit(p.limit) if limit is None else limit

    def packed(items):
        cuts = cut_list(F.transform(items, F.length), limit, p.test_sep, len(p.joiner), p.hard)
        pieces = _texts(items, cuts, p.joiner)
        if not p.drop_blank:
            return pieces
        return F.transform(F.array(pieces), lambda a: F.filter(a, lambda t, i: (i < F.size(a) - 1) | ~is_blank(t)))[0]

    pieces = F.transform(F.array(F.split(text, p.separator)), packed)[0]
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(pieces) if p.whole else pieces


def run_list(sizes: Column, limit: int) -> Column:
    """Consecutive runs of items as (first, cnt) by total size, without splitting."""
    return cut_list(sizes, F.lit(limit), 0, 0, False)
