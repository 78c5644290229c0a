import pytest
from pyspark.sql import functions as F

from folioscript.functions import domains as D
from folioscript.operators import reader as R
from folioscript.operators import timeline as T

PAUSES = [  # prev kind, prev text, prev speaker, prev is title, kind, speaker, paragraph break, seconds
    (None, None, None, False, "dialogue", 1, False, 0.0), ("narration", "Chapter 1.", None, True, "narration", None, False, 0.0),
    ("sfx", "door slam", None, False, "narration", None, True, 0.6), ("narration", "He waited.", None, False, "dialogue", 1, True, 0.7),
    ("narration", "He waited.", None, False, "dialogue", 1, False, 0.45), ("narration", "He waited.", None, False, "narration", None, False, 0.35),
    ("dialogue", "“Who are you?”", 1, False, "narration", None, False, 0.45), ("dialogue", "“Well now,”", 1, False, "narration", None, False, 0.18),
    ("narration", "he said", None, False, "dialogue", 1, False, 0.08), ("dialogue", "“But—”", 1, False, "narration", None, False, 0.08)]


def test_pause_policy(spark):
    df = spark.createDataFrame(PAUSES, "pk string, pt string, ps long, ti boolean, k string, s long, para boolean, want double")
    got = df.select("want", D.target_pause(*[F.col(c) for c in ["pk", "pt", "ps", "ti", "k", "s", "para"]]).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_inserted_pause_is_whole_frames(spark):
    df = spark.createDataFrame([(0.0,), (-0.2,), (0.7,), (9.0,)], "t double")
    got = [r[0] for r in df.select(D.inserted_pause(F.col("t"))).collect()]
    frame = 1152 / 44100
    assert got == pytest.approx([0, 0, round(0.7 / frame) * frame, round(1.5 / frame) * frame])


def test_age_accent_stability(spark):
    v = lambda value, f: spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]
    assert [v(x, D.age_bucket_of_text) for x in ["8 years old", "30s", "60s", "45", "40s", "teen", "12"]] == ["old", None, "old", None, "middle", "young", "young"]
    assert [v(x, D.accent_family) for x in ["West Indian", "English", "U.S.", "Indian", "", None, "Kiwi"]] == ["caribbean", "british", "american", "indian", None, None, "australian"]
    df = spark.createDataFrame([(0.24,), (0.25,), (0.75,)], "x double")
    assert [r[0] for r in df.select(D.snapped_stability(F.col("x"))).collect()] == [0.0, 0.5, 1.0]


def test_boundaries(spark):
    text = 'You were smiling. "Who are you?" You walked over.\n\nAnother paragraph.'
    segs = [("narration", "Chapter 1. Test."), ("narration", "You were smiling."), ("dialogue", '"Who are you?"'), ("narration", "You walked over."),
            ("sfx", "door"), ("narration", "Another paragraph."), ("dialogue", "missing"), ("narration", "missing")]
    df = spark.createDataFrame([(1, text, "Chapter 1. Test.", segs)], "chapter_id long, clean_text string, announcement string, script array<struct<kind:string,text:string>>")
    got = R.boundary_rows(R.bounded_script(df)).orderBy("idx").collect()
    assert [r["is_title"] for r in got] == [True] + [False] * 7
    assert [i for i, r in enumerate(got) if r["para_break_before"]] == [0, 1, 4, 5, 7]
    assert [i for i, r in enumerate(got) if r["space_before"]] == [2, 3, 6]


def test_boundaries_from_rows_agree(spark):
    segs = spark.createDataFrame([(1, 0, "narration", "A b."), (1, 1, "dialogue", '"c"'), (1, 2, "sfx", "bang")], "chapter_id long, idx long, kind string, text string")
    ch = spark.createDataFrame([(1, 'A b. "c"', None)], "chapter_id long, clean_text string, announcement string")
    rows = R.boundaries(segs, ch).orderBy("idx").select("para_break_before", "space_before").collect()
    assert [tuple(r) for r in rows] == [(True, False), (False, True), (True, False)]


def test_phrases_tile_the_text(spark):
    texts = ["One two three. Four, five six seven, eight nine ten eleven twelve thirteen, and so on and on and on, ok. Hi.", "", "no end", "a. b. c. d e f g. x", "word " * 30 + ", tail"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.split_phrases(F.col("t")).alias("p")).collect():
        assert "".join(r["p"]) == r["t"]
    pieces = {r["t"]: r["p"] for r in df.select("t", T.split_phrases(F.col("t")).alias("p")).collect()}
    assert pieces[""] == [""] and pieces["no end"] == ["no end"]
    # A remainder under six characters joins the piece before it.
    assert pieces["a. b. c. d e f g. x"] == ["a. b. c. d e f g. x"]
    assert pieces["word " * 30 + ", tail"] == ["word " * 30 + ", tail"]
