import random

from pyspark.sql import functions as F

from folioscript.operators import cost as C


def test_probe_moves_each_line_once_and_the_first_of_a_new_key_is_rendered(spark):
    rng = random.Random(3)
    lines = [(rng.choice(["a", "b", "c", "d", None]), rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1, 2])) for _ in range(60)] + [("e", 1, 0), ("e", 1, 0), ("f", None, 0)]
    plan, clips = spark.createDataFrame(lines, "cache_key string, chapter_id long, idx long"), spark.createDataFrame([("b",), (None,)], "cache_key string")
    low = lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or 0)
    first = {k: min((x for x in lines if x[0] == k), key=low) for k, _, _ in lines if k is not None}
    want = [(*x, x[0] == "b" or x[0] is None or None in x or x != first[x[0]]) for x in lines]
    at = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(at)
    spark.conf.set(at, "-1")
    try:
        probed = C.probe_cache(plan, clips.filter(F.col("cache_key").isNotNull()))
        shuffles = probed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        got = [tuple(r) for r in probed.select("cache_key", "chapter_id", "idx", "is_cached").collect()]
    finally:
        spark.conf.set(at, before)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert shuffles == 3  # keys, known clips, and the lines once
