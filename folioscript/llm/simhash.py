"""SimHash near-duplicate classes by multi-index hashing.

A fingerprint is cut into segments, each with a table from the segment's value to the
fingerprints that have it. Two fingerprints within DISTANCE bits agree up to a few
bits in at least one segment: of m segments the first DISTANCE mod m + 1 need a ball of
radius floor(DISTANCE / m), the others one less, and none at all below zero. So with
two segments the first is probed with radius 1 and the second with radius 0: if both of
two bits lie in the first, the second is untouched. A probe enumerates the ball around
its own segment value, fetches what the table holds there, and verifies complete
distances. Of two values a bit apart only the one without the bit probes, by setting it.

A table value that more than HOT fingerprints share (a large group of near copies) is
not compared pair by pair: all that meet there are looked up by the whole word, each
with one bit flipped, so that two of them at distance 1 or 2 meet at a word that can
hold at most 65. No link is lost, and no bucket grows with a group.

Defined cases: null and blank texts have fingerprint 0 and link like any other; a text
of one or two words has one shingle; equal texts collapse to one fingerprint before the
search; rows of a null doc_id link like any other and get the smallest id of their
component, null if it has none; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscript.llm.common import components, table, travels
from folioscript.session import cut_lineage

travels(__name__)
BITS, SEGMENTS, WORDS, DISTANCE, SEED = 64, 2, 3, 2, 42
HOT = 64
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half the hashes of the word shingles, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    votes, n = np.zeros(BITS, np.int64), max(1, len(w) - words + 1)
    for at in range(0, n, CHUNK):  # a very long text never becomes one large array
        part = w[at : at + CHUNK + words - 1]
        grams = map(b" ".join, zip(*[part[i:] for i in range(words)], strict=False)) if n > 1 or len(w) == words else [b" ".join(w)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def radii(segments: int, distance: int = DISTANCE) -> list[int]:
    """The radius each segment is probed with; -1: it needs no table."""
    return [distance // segments - (k > distance % segments) for k in range(segments)]


def segment_values(fp: Column, segments: int) -> list[tuple[int, Column]]:
    """(width, value) of each segment."""
    edges = [BITS * k // segments for k in range(segments + 1)]
    return [(hi - lo, F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << hi - lo) - 1))) for lo, hi in zip(edges, edges[1:], strict=False)]


def links(fps: DataFrame, segments: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """(u, v) between fingerprints of ``fps(fp)``, all different, that differ in at most DISTANCE bits; enough of them to connect all that link."""
    if segments < 2:
        raise ValueError("at least two segments")
    entry, probe = [], []
    for seg, ((width, value), radius) in enumerate(zip(segment_values(F.col("fp"), segments), radii(segments), strict=True)):
        if radius < 0:
            continue
        entry.append(F.struct(F.lit(seg).alias("seg"), value.alias("value")))
        points = F.array(value)
        if radius:
            bits = F.array(*[F.lit(1 << k).cast("long") for k in range(width)])
            points = F.concat(points, F.transform(F.filter(bits, lambda b: value.bitwiseAND(b) == 0), lambda b: value.bitwiseOR(b)))  # noqa: B023
        probe.append(F.transform(points, lambda x: F.struct(F.lit(seg).alias("seg"), x.alias("value"))))  # noqa: B023
    table = fps.select("fp", F.explode(F.array(*entry)).alias("at")).select("at.seg", "at.value", "fp")
    probes = fps.select(F.col("fp").alias("u"), F.explode(F.concat(*probe)).alias("at")).select("at.seg", "at.value", "u")
    crowded = cut_lineage(table.groupBy("seg", "value").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("seg", "value"), "crowded")
    met = probes.join(crowded, ["seg", "value"], "left_anti").join(table.withColumnRenamed("fp", "v"), ["seg", "value"])
    near = (F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)
    # A crowded value: whoever is there or probes it.
    many = probes.join(crowded, ["seg", "value"], "left_semi").select(F.col("u").alias("fp")).distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), k) for k in range(BITS)])
    words = many.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    same = words.groupBy("word").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    star = same.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v"))  # two at one word differ in at most two bits
    return met.filter(near).select("u", "v").unionByName(star.filter("u <> v"))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp, component_id) per row of ``docs``; component_id is the smallest key reachable over links."""
    rows = cut_lineage(fingerprints(docs, key, text, words), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min(key).alias("id"))
    roots = components(cut_lineage(links(cut_lineage(classes.select("fp"), "classes")), "links"))
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.join(named.select("fp", "root"), "fp").join(least, "root").select(key, "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
