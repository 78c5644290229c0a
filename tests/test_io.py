import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from folioscript.functions import mp3
from folioscript.functions.annotate import annotate
from folioscript.sources import files, sinks
from folioscript.streaming.ingest import start_ingest, upload_stream

FRAME = bytes([0xFF, 0xFB, 0x90, 0xC0]) + b"\0" * 413  # MPEG1 layer III, 128 kbit/s, 44.1 kHz: 417 bytes


def test_mp3_inventory(spark, tmp_path):
    xing = FRAME[:36] + b"Xing" + FRAME[40:]
    (tmp_path / "a.mp3").write_bytes(b"ID3\3\0\0\0\0\1\2" + b"x" * 130 + xing + FRAME * 5 + b"junk")
    (tmp_path / "b.mp3").write_bytes(FRAME * 3)
    (tmp_path / "c.mp3").write_bytes(b"\0")
    got = {r["path"][-5:]: (r["frames"], r["audio_bytes"]) for r in files.clip_inventory(files.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.mp3": (5, 5 * 417 + 4), "b.mp3": (3, 3 * 417), "c.mp3": (0, 1)}
    assert mp3.frame_bytes(FRAME, 0) == 417


def _write(folder, name, body):
    (folder / name).write_bytes(body)


def test_ingest_and_quarantine(spark, tmp_path):
    _write(tmp_path, "good_one.txt", ("CHAPTER I\n\n" + "word " * 400 + "\n\nCHAPTER II\n\n" + "more " * 400).encode())
    _write(tmp_path, "short.md", b"tiny")
    _write(tmp_path, "old.doc", b"x" * 500)
    _write(tmp_path, "what.xyz", b"x" * 500)
    _write(tmp_path, "bad.TXT", b"\xff\xfe" + b"ok " * 100)
    chapters, bad = files.ingest(files.read_files(spark, str(tmp_path)))
    assert {r["path"].rsplit("/", 1)[1]: r["reject_reason"] for r in bad.collect()} == {
        "short.md": "empty_extraction", "old.doc": "legacy_doc", "what.xyz": "unsupported_file"}
    assert [(r["title"], r["method"]) for r in chapters.filter("method = 'heuristic'").orderBy("idx").collect()] == [("CHAPTER I", "heuristic"), ("CHAPTER II", "heuristic")]
    assert chapters.filter("method = 'single'").first()["text"].startswith("��ok")


def test_stream_ingest_picks_up_new_files_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for n in range(2):
        _write(src, f"book{n}.txt", (f"text {n} " * 60).encode())
        _write(src, f"no{n}.bin", b"?")
        start_ingest(upload_stream(spark, str(src)), out).awaitTermination()
    read = lambda name: spark.read.parquet(f"{out}/{name}/batch=*")
    assert read("chapters").count() == 2 and read("quarantine").count() == 2


SCRIPT = "book_id long, chapter_id long, idx long, text string"


def _scripts(spark, path):
    return sinks.StoredTable(spark, path, SCRIPT, ["book_id"], 4)


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_replaced_and_emptied_chapters(spark, tmp_path):
    table = _scripts(spark, str(tmp_path / "segments"))
    assert table.read().count() == 0 and table.manifest() == (-1, {})
    old = [(b, b * 10 + c, i, "old") for b in range(6) for c in range(2) for i in range(2)]
    keys = lambda pairs: spark.createDataFrame(pairs, "book_id long, chapter_id long")
    frame = lambda rows: spark.createDataFrame(rows, SCRIPT)
    sinks.replace_scripts(table, keys([r[:2] for r in old]), frame(old))
    assert sinks.replace_scripts(table, keys([(1, 10), (2, 21)]), frame([(1, 10, 0, "new")])) == 1
    want = sorted([r for r in old if r[1] not in (10, 21)] + [(1, 10, 0, "new")])
    assert _rows(table.read()) == want and _rows(table.read(0)) == sorted(old)
    held = table.manifest()[1]
    assert {v for v, _ in held.values()} == {0, 1} or len(held) <= 2  # untouched buckets stay where they were
    sinks.replace_scripts(table, keys([r[:2] for r in want]), frame([]))
    assert table.read().count() == 0 and _rows(table.read(1)) == want
    sinks.replace_scripts(table, keys([(7, 70)]), frame([(7, 70, 0, "again")]))
    assert _rows(table.read()) == [(7, 70, 0, "again")]


def test_a_writer_that_dies_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    import pytest

    table = _scripts(spark, str(tmp_path / "segments"))
    keys = spark.createDataFrame([(1, 10), (2, 20)], "book_id long, chapter_id long")
    frame = lambda t: spark.createDataFrame([(1, 10, 0, t), (2, 20, 0, t)], SCRIPT)
    sinks.replace_scripts(table, keys, frame("old"))

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "switch", dies)
        with pytest.raises(RuntimeError):
            sinks.replace_scripts(table, keys, frame("half"))
    assert _rows(table.read()) == [(1, 10, 0, "old"), (2, 20, 0, "old")]
    assert sinks.replace_scripts(table, keys, frame("new")) == 1
    assert _rows(table.read()) == [(1, 10, 0, "new"), (2, 20, 0, "new")]


def test_scripted_chapters_lose_audio_and_error(spark):
    chapters = spark.createDataFrame([(1, "ready", "a.mp3", 3.0, None), (2, "error", None, None, "bad"), (3, "ready", "c.mp3", 1.0, None)],
                                     "id long, status string, audio_path string, duration_sec double, error string")
    got = sinks.scripted(chapters, spark.createDataFrame([(0, 1), (0, 2), (0, 9)], "book_id long, chapter_id long"))
    assert sorted(map(tuple, got.collect())) == [(1, "scripted", None, None, None), (2, "scripted", None, None, None), (3, "ready", "c.mp3", 1.0, None)]


def test_upserts_rewrite_only_their_buckets(spark, tmp_path):
    table = sinks.StoredTable(spark, str(tmp_path / "t"), "k long, v long, s string", ["k"], 8)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v long, s string")
    grow = {"v": F.max("v")}
    table.upsert(frame([(k, k, "a") for k in range(40)]), grow)
    table.upsert(frame([(3, 1, "b"), (99, 5, "c")]), grow)
    want = {k: (k, "a") for k in range(40)} | {3: (3, "b"), 99: (5, "c")}
    assert {r.k: (r.v, r.s) for r in table.read().collect()} == want
    assert sum(v == 1 for v, _ in table.manifest()[1].values()) <= 2
    before = table.manifest()
    table.upsert(frame([(3, 1, "b"), (99, 5, "c")]), grow, version=1)  # a repeated batch
    assert table.manifest() == before and {r.k: (r.v, r.s) for r in table.read().collect()} == want


def test_snapshots(spark, tmp_path):
    table = sinks.StoredTable(spark, str(tmp_path / "snap"), "id string, name string, fetched_at_s long", ["id"], 2)
    sinks.write_snapshot(table, spark.createDataFrame([("v", "x"), ("w", "y")], "id string, name string"), 1_000)
    due = lambda t: sorted((r["id"], r["needs_refresh"]) for r in sinks.read_snapshot(table, t).collect())
    assert due(1_000 + 3600) == [("v", False), ("w", False)] and due(1_000 + 3601)[0] == ("v", True) and due(1_000 + 86_400) == []
    sinks.write_snapshot(table, spark.createDataFrame([("v", "z")], "id string, name string"), 90_000)
    assert due(90_000) == [("v", False)]  # a voice that the new catalogue lacks is gone


def test_annotate_isolates_failures(spark):
    schema = StructType([StructField("id", LongType()), StructField("note", StringType())])

    def fn(rows: pd.DataFrame) -> pd.DataFrame:
        if (rows["id"] == 3).any():
            raise ValueError("three")
        return pd.DataFrame({"id": rows["id"], "note": "n" + rows["id"].astype(str)})

    got = {r["id"]: (r["note"], r["error"]) for r in annotate(spark.range(6), fn, schema).collect()}
    assert got[3] == (None, "ValueError: three") and all(got[i] == (f"n{i}", None) for i in (0, 1, 2, 4, 5))
