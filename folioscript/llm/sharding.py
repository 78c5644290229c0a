"""Weighted rendezvous hashing of stable record keys over shards.

Every shard draws a pseudo-random number from (record key, shard); the record
goes to the shard with the best draw. A draw depends on nothing else, so a new
shard only wins records for itself, a removed one only gives its own away, and a
changed weight moves just the difference. No shuffle is needed to place a record.

Defined cases: a null key is placed by its text's CRC (records without any key
still spread); a null text has size 8 and the CRC of the empty string; equal
records get the same shard and different slots; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscript.llm.common import table

SHARDS = 24
# Slots are numbered in blocks of about this many distinct records.
BLOCK_RECORDS = 250_000


def draw(key: Column, shard: int, weight: float) -> Column:
    """Score of a shard for a record: -weight / ln(u), u uniform in (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard), F.lit("shard")), 11).cast("double")
    return -F.lit(float(weight)) / F.log((bits + 0.5) / float(1 << 53))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard of ``key``: the best draw; on equal draws the lower shard. A shard of weight 0 gets nothing."""
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    best = F.array_max(F.array(*[F.struct(draw(key, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in live]))
    return (-best["i"]).cast("int")


def record_key(key: Column, text: Column) -> Column:
    return F.when(key.isNotNull(), F.concat(F.lit("k"), key.cast("string"))).otherwise(
        F.concat(F.lit("t"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("string")))


def place(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", out: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row in ``out``; all other columns stay (one called ``out`` is replaced)."""
    return docs.withColumn(out, rendezvous(record_key(F.col(key), F.col(text)), weights))


def write_shards(placed: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard; tasks write side by side, so no shard passes through one task."""
    placed.write.partitionBy(shard).mode("overwrite").parquet(path)


def slots(placed: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """``slot`` counts from 0 without gaps inside each shard, by a hash of ``order``.

    Equal rows are counted first and only expanded at the end, so a record that is
    repeated very often is no load. Distinct rows are cut into blocks by hash; a
    window runs inside a block, and block totals carry the count across blocks.
    """
    keys = placed.groupBy(*placed.columns).agg(F.count("*").alias("_n")).withColumn("_h", F.xxhash64(*order))
    blocks = max(1, -(-placed.count() // BLOCK_RECORDS))
    keys = keys.withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(blocks)))
    inside = Window.partitionBy(shard, "_b").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    rows = keys.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    carry = keys.groupBy(shard, "_b").agg(F.sum("_n").alias("_t")).select(
        shard, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_c"))
    first = (F.col("_at") + F.col("_c")).cast("long")
    at = rows.join(carry, [shard, "_b"])
    return at.select(*placed.columns, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("slot"))


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Digest of the placement of ``docs`` over equally weighted shards, and over one shard more."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = place(place(docs.select("doc_id", "text"), [1.0] * shards), [1.0] * (shards + 1), out="grown_shard").select(
        F.col("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "grown_shard")
    return slots(rows, "shard", ["doc_id", "text_crc32", "size"])


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(table(spark, sf_dir, "documents"))
