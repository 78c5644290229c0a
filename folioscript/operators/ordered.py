"""Ordered computations that stay parallel inside one hot key.

A plain ``Window.partitionBy(key)`` hands every row of a key to one task. Here
each key's rows are first cut into *blocks* of consecutive order values. The
window runs per (key, block); one summary row per block then carries the state
from the blocks before it. Summaries are the only thing a key gathers in one
place, and a key with a single block needs no carry at all.

``block`` must never decrease along ``order``; :func:`rank_block` makes one
from an integer position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536
_BLK = "_blk"


def rank_block(position: Column, rows: int = BLOCK_ROWS) -> Column:
    return F.floor(position / F.lit(rows)).cast("long")


def with_blocks(df: DataFrame, block: Column) -> DataFrame:
    """Fix the blocks once for several steps over the same order.

    The steps then share one partitioning by (key, block), so only the first
    one shuffles the rows. Undo with :func:`without_blocks`.
    """
    return df.withColumn(_BLK, block)


def without_blocks(df: DataFrame) -> DataFrame:
    return df.drop(_BLK)


def _blocked(df: DataFrame, block: Column | None) -> tuple[DataFrame, list[str]]:
    """The frame with its block column, and what to drop afterwards."""
    return (df, []) if _BLK in df.columns else (df.withColumn(_BLK, block), [_BLK])


def _attach(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(carry, [*keys, _BLK], "left")


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    sums: dict[str, Column],
    block: Column | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Prefix sums along ``order`` within ``keys``; exclusive leaves the own row out."""
    end = -1 if exclusive else 0
    df, own = _blocked(df, block)
    inside = (
        Window.partitionBy(*keys, _BLK).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    )
    before = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({name: F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()})
    totals = df.groupBy(*keys, _BLK).agg(
        *[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()]
    )
    carry = totals.select(
        *keys, _BLK, F.row_number().over(Window.partitionBy(*keys).orderBy(_BLK)).alias("_nth"),
        *[F.sum(f"_t_{name}").over(before).alias(f"_c_{name}") for name in sums],
    ).filter("_nth > 1").drop("_nth")
    out = _attach(rows, carry, keys)
    return out.withColumns(
        {name: F.col(name) + F.coalesce(F.col(f"_c_{name}"), F.lit(0)) for name in sums}
    ).drop(*own, *[f"_c_{name}" for name in sums])


def running_count(
    df: DataFrame, keys: list[str], order: list[Column], name: str, block: Column | None = None,
    when: Column | None = None, exclusive: bool = False,
) -> DataFrame:
    one = F.lit(1).cast("long") if when is None else F.when(when, 1).otherwise(0).cast("long")
    return running_sums(df, keys, order, {name: one}, block, exclusive)


def dense_index(df: DataFrame, keys: list[str], order: list[Column], name: str, block: Column | None = None) -> DataFrame:
    """0-based position of each row inside its key."""
    return running_count(df, keys, order, name, block, exclusive=True)


def previous_row(
    df: DataFrame, keys: list[str], order: list[Column], cols: list[str], name: str, block: Column | None = None
) -> DataFrame:
    """The row before this one as struct ``name`` (null on the first row of a key)."""
    df, own = _blocked(df, block)
    packed = F.struct(*cols)
    rows = df.withColumn(name, F.lag(packed).over(Window.partitionBy(*keys, _BLK).orderBy(*order)))
    lasts = df.groupBy(*keys, _BLK).agg(F.max_by(packed, F.struct(*order)).alias("_last"))
    carry = lasts.select(
        *keys, _BLK, F.lag("_last").over(Window.partitionBy(*keys).orderBy(_BLK)).alias("_c")
    ).filter("_c IS NOT NULL")
    return _attach(rows, carry, keys).withColumn(name, F.coalesce(name, "_c")).drop(*own, "_c")


def nearest(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, when: Column,
    name: str, block: Column | None = None, ahead: bool = False, inclusive: bool = False,
) -> DataFrame:
    """Last ``value`` before (or first after) the row among rows where ``when`` holds."""
    df, added = _blocked(df, block)
    df = df.withColumn("_v", F.when(when, F.struct(value.alias("v"))))
    step = 0 if inclusive else (1 if ahead else -1)
    inside = Window.partitionBy(*keys, _BLK).orderBy(*order)
    blocks = Window.partitionBy(*keys).orderBy(_BLK)
    if ahead:
        own = F.first("_v", ignorenulls=True).over(inside.rowsBetween(step, Window.unboundedFollowing))
        edge = F.min_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
        far = F.first("_e", ignorenulls=True).over(blocks.rowsBetween(1, Window.unboundedFollowing))
    else:
        own = F.last("_v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, step))
        edge = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
        far = F.last("_e", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_own", own)
    carry = (
        df.groupBy(*keys, _BLK).agg(edge.alias("_e"))
        .select(*keys, _BLK, far.alias("_c")).filter("_c IS NOT NULL")
    )
    out = _attach(rows, carry, keys).withColumn("_hit", F.coalesce("_own", "_c"))
    return out.withColumn(name, F.col("_hit.v")).drop(*added, "_v", "_own", "_c", "_hit")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row per key, the first along ``order``; combined before the shuffle."""
    row = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(row).select("_row.*")


def top_by(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark prunes to ``k`` per key on the map side."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def preceding_rows(
    df: DataFrame, keys: list[str], position: str, n: int, cols: list[str], name: str,
    rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """Array of the up to ``n`` rows before each row, oldest first.

    ``position`` is dense (see :func:`dense_index`). The last ``n`` rows of a
    block are repeated at the head of the next one, so one shuffle is enough.
    """
    pos = F.col(position)
    own = rank_block(pos, rows_per_block)
    spill = (pos % rows_per_block) >= rows_per_block - n
    df = df.withColumn("_in", F.explode_outer(F.when(spill, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "_in").orderBy(position).rowsBetween(-n, -1)
    return df.withColumn(name, F.collect_list(F.struct(*cols)).over(w)).filter(F.col("_in") == own).drop("_in")


def as_of(
    facts: DataFrame, probes: DataFrame, keys: list[str], fact_time: str, probe_time: Column,
    cols: list[str], tie: str, name: str, block_seconds: int = 3600,
) -> DataFrame:
    """For each probe the last fact at or before ``probe_time`` in the same key.

    ``tie`` orders facts that share a time. Facts sort before probes of equal time.
    """
    probe_cols = probes.columns
    f = facts.select(*keys, F.col(fact_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"),
                     F.struct(*cols).alias("_fact"))
    p = probes.select(*keys, probe_time.alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_tie"),
                      F.struct(*probe_cols).alias("_probe"))
    both = f.unionByName(p, allowMissingColumns=True)
    found = nearest(both, keys, [F.col("_t"), F.col("_side"), F.col("_tie")], F.col("_fact"), F.col("_side") == 0,
                    name, F.floor(F.col("_t") / block_seconds).cast("long"))
    return found.filter(F.col("_side") == 1).select("_probe.*", name)
