"""Session settings and the shared scratch location."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Arrow batches that reach Python: rows, and bytes where texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def travels(name: str) -> None:
    """Pickle the functions of module ``name`` by value: executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def tune(spark: SparkSession) -> SparkSession:
    """Turn on the runtime re-planning every operator here relies on.

    Joins never carry a blind broadcast hint: Spark broadcasts a side only when
    its measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and falls
    back to a shuffle join, split on skewed partitions, above it.
    """
    conf = spark.conf
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names that folder. Where it is unset, the warehouse is
    used: every executor writes tables there, so all of them can read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later steps that use it several times do not repeat the work before it, they
    read only the columns they need, and the files outlive any lost executor.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over the shuffle partitions.

    A file of few row groups is read by as few tasks, however many cores there are.
    Heavy work per row goes behind this, so that it does not stay in those tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
