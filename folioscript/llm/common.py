"""What the operators of this package share: session settings, table access, worker code, components."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscript.session import cut_lineage, tune

# Sizes of the Arrow batches that reach Python: rows, and bytes for very long texts.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def travels(name: str) -> None:
    """Pickle the functions of module ``name`` by value, so that workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def ship(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object with its class, so that a worker without this package can rebuild it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unship(shared: Broadcast) -> object:
    return cloudpickle.loads(shared.value)


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches that fit a worker even where texts are long."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception:  # noqa: BLE001  this Spark has no such setting; the row bound stays
        pass
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def key_hash(*cols: Column | str) -> Column:
    """64-bit hash of a stable record key."""
    return F.xxhash64(*cols)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def components(edges: DataFrame, max_rounds: int = 80) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root is the component's smallest node.

    Alternating star contraction. In each round every larger neighbour of a node
    is linked to the smallest node it knows, then every node to its smallest
    smaller neighbour. Edges never multiply, a hub's edges are spread by the
    joins (split further when skewed), and each round ends in a written table,
    so nothing is recomputed when an executor is lost. Null ends and loops are
    ignored; an empty input gives an empty result.
    """
    edges = cut_lineage(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _state(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut_lineage(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        before, seen = seen, _state(edges)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    own = edges.select(F.col("v").alias("node")).distinct().join(roots, "node", "left_anti")
    return roots.unionByName(own.select("node", F.col("node").alias("root")))


def _state(edges: DataFrame) -> tuple:
    """Row count and order-free hash of an edge set: two numbers."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

travels(__name__)
