"""Heavy work per document leaves the few tasks that read a file of few row groups; its cheaper rules say the same."""

import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from folioscript.functions import js
from folioscript.operators import quotes as QT
from folioscript.operators import timeline as T
from folioscript.sources.derived import line_segments
from folioscript.sources.model import Model

OPENER_BEFORE = rf"(?<![^{js.WS}(\[{{—–\-\"“])[‘']"
TEXTS = ["One two three. Four, five six seven, eight nine ten eleven twelve, and so on and on. Hi.", "no end", "a. b. c. d", "  x﻿"]


def _documents(path):
    rows = [(i, f"line {i}, one.\nline two — {i}.") for i in range(400)]
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}), path / "documents.parquet")
    return str(path)


def test_one_row_group_feeds_all_tasks(spark, tmp_path):
    m = Model(spark, _documents(tmp_path))
    for rows, n in [(m.quoted_chapters, 400), (line_segments(m), 800)]:
        tasks = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(tasks) == n and len(tasks) > 1 and max(tasks) < n / 2


def _strings(spark, letters, n=3000):
    deal = random.Random(5)
    return spark.createDataFrame([("".join(deal.choice(letters) for _ in range(deal.randint(0, 12))),) for _ in range(n)] + [(None,), ("",)], "t string")


def test_trims_take_the_whole_set_and_no_more(spark):
    c = F.col("t")
    df = _strings(spark, js.WS_CHARS + "\x85\x1c\x1f᠎​⁠ab é“\U0001F600")
    assert re.fullmatch(f"[{js.WS}]+", js.WS_CHARS) and len(set(js.WS_CHARS)) == 25
    both, right = F.regexp_replace(c, rf"^[{js.WS}]+|[{js.WS}]+\z", ""), F.regexp_replace(c, rf"[{js.WS}]+\z", "")
    assert df.filter(~js.trim_ws(c).eqNullSafe(both) | ~js.rtrim_ws(c).eqNullSafe(right)).count() == 0


def test_quote_style_counts_as_before(spark):
    df = _strings(spark, "“”\"'‘’ a(— \U0001F600")
    c = F.col("t")
    count = lambda p: F.regexp_count(c, F.lit(p))
    curly, straight, singles = count("“"), count('"'), count(OPENER_BEFORE)
    want = (F.when(curly >= 2, "curly").when(straight >= 2, "straight")
            .when((curly == 0) & (straight == 0) & (singles >= 4), "single").otherwise("none"))
    assert df.filter(~QT.quote_style(c).eqNullSafe(want)).count() == 0
    assert df.filter(~count(QT.SINGLE_OPENER).eqNullSafe(singles)).count() == 0 and df.filter(singles > 0).count() > 100


def test_phrase_rows_are_those_of_the_timed_phrases(spark):
    df = spark.createDataFrame([(1, i, t, 0.0, 1.0) for i, t in enumerate(TEXTS)], "chapter_id long, idx long, text string, start_sec double, duration_sec double")
    columns = ["chapter_id", "idx", "phrase_idx", "phrase"]
    got = T.phrase_rows(df, ["chapter_id", "idx"])
    assert got.columns == columns and sorted(got.collect()) == sorted(T.timed_phrases(df).select(*columns).collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "greatest" not in plan  # no weights where none are asked for
