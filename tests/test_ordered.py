"""Blockwise operators against plain windows, with one key holding a third of the rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscript.operators import ordered as O

@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.34 else f"k{rng.randrange(6)}", i, rng.randrange(5) or None, rng.random() < 0.3) for i in range(160)]
    return spark.createDataFrame(data, "k string, i long, v long, hit boolean").cache()


@pytest.fixture(autouse=True)
def shapes(spark):
    global W, ORDER, BLOCK
    W, ORDER, BLOCK = Window.partitionBy("k").orderBy("i"), [F.col("i")], O.rank_block(F.col("i"), 4)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("exclusive", [False, True])
def test_running_sums(rows, exclusive):
    got = O.running_sums(rows, ["k"], ORDER, {"s": F.coalesce("v", F.lit(0))}, BLOCK, exclusive)
    frame = W.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    want = rows.withColumn("s", F.coalesce(F.sum(F.coalesce("v", F.lit(0))).over(frame), F.lit(0)))
    same(got.select("k", "i", "s"), want.select("k", "i", "s"))


def test_previous_row_keeps_nulls_apart_from_the_start(rows):
    got = O.previous_row(rows, ["k"], ORDER, ["v"], "prev", BLOCK)
    same(got.select("k", "i", "prev"), rows.select("k", "i", F.lag(F.struct("v")).over(W).alias("prev")))


@pytest.mark.parametrize("ahead,inclusive", [(False, False), (True, False), (False, True), (True, True)])
def test_nearest(rows, ahead, inclusive):
    got = O.nearest(rows, ["k"], ORDER, F.col("i"), F.col("hit"), "n", BLOCK, ahead, inclusive)
    step = 0 if inclusive else (1 if ahead else -1)
    hit = F.when(F.col("hit"), F.col("i"))
    want = (F.first(hit, True).over(W.rowsBetween(step, Window.unboundedFollowing)) if ahead
            else F.last(hit, True).over(W.rowsBetween(Window.unboundedPreceding, step)))
    same(got.select("k", "i", "n"), rows.select("k", "i", want.alias("n")))


def test_dense_index_and_preceding_rows(rows):
    df = O.dense_index(rows, ["k"], ORDER, "pos", BLOCK)
    same(df.select("k", "i", "pos"), rows.select("k", "i", (F.row_number().over(W) - 1).cast("long").alias("pos")))
    got = O.preceding_rows(df, ["k"], "pos", 3, ["i"], "last", 4)
    want = rows.select("k", "i", F.collect_list(F.struct("i")).over(W.rowsBetween(-3, -1)).alias("last"))
    same(got.select("k", "i", "last"), want)


def test_as_of_matches_brute_force(spark, rows):
    facts = rows.select("k", (F.col("i") * 10.0).alias("t"), "i")
    probes = spark.createDataFrame([(k, p, float(p * 37 % 1700)) for p, k in enumerate(["hot", "k1", "none"] * 20)], "k string, p long, at double")
    got = O.as_of(facts, probes, ["k"], "t", F.col("at"), ["i"], "i", "hit", block_seconds=50)
    want = probes.join(facts, (probes.k == facts.k) & (facts.t <= probes.at), "left").groupBy("p").agg(F.max("i").alias("i"))
    same(got.select("p", F.col("hit.i")), want)


def test_first_and_top(rows):
    got = O.first_by(rows, ["k"], [F.col("i")]).select("k", "i")
    same(got, rows.groupBy("k").agg(F.min("i").alias("i")))
    assert O.top_by(rows, ["k"], [F.col("i")], 2).count() == 2 * rows.select("k").distinct().count()
