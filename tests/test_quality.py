from pyspark.sql import functions as F

from folioscript.functions.assemble import tiles
from folioscript.operators import cost as C
from folioscript.operators import quality as Q
from folioscript.operators import status as S


def _span(start, end, text):
    return {"start": start, "end": end, "text": text}


def test_spans_must_hold_their_own_slices():
    assert tiles("abcdef", [_span(0, 3, "abc"), _span(3, 6, "def")]) and tiles("", [])
    assert not tiles("abcdef", [_span(0, 3, "xyz"), _span(3, 6, "qqq")])
    assert not tiles("abcdef", [_span(0, 4, "abcd"), _span(3, 5, "de"), _span(5, 6, "f")])
    assert not tiles("abcdef", [_span(0, 2, "ab"), _span(3, 6, "def")]) and not tiles("abc", [_span(0, 2, "ab")])


def test_doubled_positions_are_no_dense_index(spark):
    rows = [(1, i) for i in (0, 0, 3, 3)] + [(2, i) for i in (0, 1, 2)] + [(3, i) for i in (1, 2)]
    got = Q.index_gaps(spark.createDataFrame(rows, "chapter_id long, idx long")).collect()
    assert sorted(r.chapter_id for r in got) == [1, 3]


def test_stored_duration_is_compared(spark):
    have = spark.createDataFrame([(1, 2.5), (2, 3.0), (3, 1.0)], "chapter_id long, duration_sec double")
    stored = spark.createDataFrame([(1, 2.5), (2, 3.5)], "chapter_id long, stored_sec double")  # chapter 3 was never rendered
    assert list(map(tuple, Q.duration_mismatch(have, stored).collect())) == [(2, -0.5)]


def test_title_lines_left(spark):
    rows = [(1, "Chapter I\n\nText", "CHAPTER I. The Road"), (2, "Text of it\nmore", "Chapter I"), (3, " the road \nText", "Chapter I: The Road"), (4, "", "Any"), (5, None, "Any"),
            (6, "x" * 61 + "\n", "a" + "x" * 61)]
    got = Q.title_lines_left(spark.createDataFrame(rows, "id long, text string, title string"))
    assert sorted(r.id for r in got.collect()) == [1, 3, 4]


def test_cache_keys_tell_unlike_tuples_apart(spark):
    rows = [("a", "b"), ("a\x1fb", None), (None, "a\x1fb"), ("", "ab"), ("ab", ""), ("ab", None), (None, None), ("1:a", ""), ("a1:", ""), ("~", "~"), ("0.5001", "x"), ("0.5", "x")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(C.content_key(F.col("x"), F.col("y")).alias("k")).distinct().count() == len(rows)
    near = spark.createDataFrame([(0.5001,), (0.5002,), (0.5,)], "x double")
    assert near.select(C.content_key(C._canon(F.col("x"))).alias("k")).distinct().count() == 3


def test_admission_counts_what_runs(spark):
    jobs = spark.createDataFrame([(1, "generate", "running", 0), (2, "generate", "queued", 9), (3, "generate", "queued", 5), (4, "script", "queued", 1), (5, "cast", "queued", 1)]
                                 + [(10 + i, "script", "running", 0) for i in range(3)], "id long, type string, status string, created_s long")
    got = S.admission(jobs, S.admission_caps(spark))
    assert [(r.type, r.id, r["rank"]) for r in got.collect()] == [("generate", 3, 1)]
