"""String helpers with Unicode-aware trimming and half-up rounding.

Spark's ``trim`` strips spaces only and Java's ``\\s`` is ASCII, so whitespace
rules that must hold for any language go through this module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the whitespace set every trim and collapse below uses.
WS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# The same set, character by character: a trim looks at the ends only, a pattern tries every character of a text.
WS_CHARS = " \t\n\v\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def rtrim_ws(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, rf"[{WS}]+", " "))


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^{WS}]")


def lower_key(c: Column) -> Column:
    """Case-insensitive lookup key of a name."""
    return F.lower(trim_ws(c))


def round_half_up(c: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def clamp(c: Column, low: float | Column, high: float | Column) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(high, F.greatest(low, c))


def first_char_upper(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` with column ``name`` computed before anything that reads it.

    A generator over one element keeps Spark from merging the projections, which
    it must not do where a Python function reads what a lambda has made.
    """
    return df.withColumn(name, F.explode(F.array(F.col(name))))
