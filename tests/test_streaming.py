import random

import pytest
from pyspark.sql import functions as F

from folioscript.operators import status as S
from folioscript.streaming import jobs as J

LATE = 1_000


@pytest.fixture(scope="module")
def log():
    rng = random.Random(2)
    states = ["queued", "running", "running", "completed", "failed", "cancelled"]
    return [(0 if rng.random() < 0.4 else rng.randrange(1, 6), i, i * 20 + rng.randrange(15), rng.choice(states), rng.randrange(100), rng.randrange(50), f"n{i}") for i in range(150)]


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def clock(ts):
    return (None, None, ts, None, None, None, None)


def waves(spark, log, path, seed=3, n=4):
    """The log in n waves: any order within LATE seconds, one row in three once more, and a clock row behind the end."""
    rng = random.Random(seed)
    arrivals = [(e[2] + rng.randrange(LATE // 2), e) for e in log] + [(e[2] + rng.randrange(LATE // 2), e) for e in log[::3]]
    arrivals = [e for _, e in sorted(arrivals)]
    step = -(-len(arrivals) // n)
    for k in range(0, len(arrivals), step):
        spark.createDataFrame(arrivals[k : k + step], J.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        yield k // step
    spark.createDataFrame([clock(log[-1][2] + LATE + 500)], J.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    yield n


def test_facts_of_late_and_replayed_waves_equal_the_batch_operators(spark, log, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for _ in waves(spark, log, src):  # a fresh query each time: everything known is in the checkpoint
        J.start_facts(spark.readStream.schema(J.EVENT_SCHEMA).parquet(src), root, LATE).awaitTermination()
        seen.append(J.facts(spark, root).count())
    assert seen == sorted(seen) and seen[-2] < seen[-1] and 0 < seen[2]
    events, found, end = spark.createDataFrame(log, J.EVENT_SCHEMA), J.facts(spark, root), log[-1][2] + 500
    assert rows(J.status_changes(found)) == rows(S.status_changes(events))
    assert rows(J.job_outcome(found)) == rows(S.job_outcome(events))
    assert rows(J.silent(found).select("job_id", "seq")) == rows(S.silent_gaps(events, end).select("job_id", "seq"))
    lost = rows(J.lost(found))
    assert lost == rows(S.lost_jobs(events, end)) and lost


def test_a_timer_reports_silence_without_another_update(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda *e: spark.createDataFrame(list(e), J.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    facts = lambda: {(r.job_id, r.fact, r.ts_s) for r in J.facts(spark, root).collect() if r.fact in ("silent", "lost")}

    def run():
        J.start_facts(spark.readStream.schema(J.EVENT_SCHEMA).parquet(src), root, 10).awaitTermination()

    put((1, 1, 100, "running", 0, 0, ""), (2, 2, 100, "running", 0, 0, ""), (3, 3, 100, "queued", 0, 0, ""))
    run()
    put((2, 4, 180, "running", 1, 0, ""))
    run()
    assert facts() == set()
    put((2, 5, 260, "completed", 1, 0, ""))  # only job 2 speaks; the watermark passes 190
    run()
    assert facts() == {(1, "silent", 100), (1, "lost", 190)}
    put(clock(1_000))
    run()
    assert facts() == {(1, "silent", 100), (1, "lost", 190)}


def test_progress_and_latest_rows_rewrite_only_touched_buckets(spark, log, tmp_path):
    src, a, b = (str(tmp_path / x) for x in ("in", "progress", "latest"))
    for _ in waves(spark, log, src):
        stream = spark.readStream.schema(J.EVENT_SCHEMA).parquet(src)
        J.start_progress(stream, a).awaitTermination()
        J.start_latest(stream, b, LATE).awaitTermination()
    events = spark.createDataFrame(log, J.EVENT_SCHEMA)
    table = J.progress_table(spark, a)
    assert rows(table.read().select("job_id", "done", "chars_used", "note")) == rows(S.job_progress(events))
    assert rows(J.latest_table(spark, b).read()) == rows(S.latest_per_job(events))
    spark.createDataFrame([(5, 999, 9_999, "running", 1_000, 1_000, "more")], J.EVENT_SCHEMA).write.mode("append").parquet(src)
    before = table.manifest()[1]
    J.start_progress(spark.readStream.schema(J.EVENT_SCHEMA).parquet(src), a).awaitTermination()
    after = table.manifest()[1]
    assert sum(before[k] != after[k] for k in after) == 1 and len(after) > 1


def test_reconcile_stream_equals_its_batch_twin(spark, log, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    books = spark.createDataFrame([(1, "generating"), (2, "casting"), (3, "analyzing"), (4, "ready")], "id long, status string")
    chapters = spark.createDataFrame([(10, 1, "generating"), (11, 1, "scripting"), (20, 2, "ready"), (30, 3, "scripting")], "id long, book_id long, status string")
    segments = spark.createDataFrame([(10, 0)], "chapter_id long, idx long")
    cast = spark.createDataFrame([(1, 2)], "id long, book_id long")
    jobs = spark.createDataFrame([(0, 1, 10, "running"), (1, 1, 11, "running"), (2, 2, 20, "running"), (3, 3, 30, "running"), (4, 3, None, "running"), (5, 4, None, "running")],
                                 "id long, book_id long, chapter_id long, status string").withColumns({"note": F.lit("n"), "error": F.lit(None).cast("string"), "updated_s": F.lit(0).cast("long")})
    for _ in waves(spark, log, src):
        J.start_reconcile(spark.readStream.schema(J.EVENT_SCHEMA).parquet(src), root, LATE, books, chapters, segments, cast, jobs).awaitTermination()
    lost = S.lost_jobs(spark.createDataFrame(log, J.EVENT_SCHEMA), log[-1][2] + 500)
    now, ch, bk = S.reconcile(books, chapters, segments, cast, jobs, lost)
    hit = jobs.join(lost, "id", "left_semi")
    failed, chapter_rows, book_rows = (t.read() for t in J.reconcile_tables(spark, root))
    assert rows(failed.select("id", "status", "note", "error", "updated_s")) == rows(now.join(lost.select("id"), "id", "left_semi").select("id", "status", "note", "error", "updated_s"))
    assert rows(chapter_rows) == rows(ch.join(hit.select("chapter_id"), "chapter_id", "left_semi"))
    assert rows(book_rows) == rows(bk.join(hit.select("book_id"), "book_id", "left_semi"))
    assert failed.count() > 1


def test_stale_jobs_need_silence_and_a_dead_run(spark):
    jobs = spark.createDataFrame([(1, "running", "a", 0), (2, "running", "b", 0), (3, "running", None, 0), (4, "running", "c", 0), (5, "running", None, 50), (6, "queued", None, 0), (7, "running", "d", 9)],
                                 "id long, status string, run_id string, updated_s long")
    runs = spark.createDataFrame([("a", "running"), ("b", "completed"), ("d", "pending")], "run_id string, state string")
    assert rows(S.stale_jobs(jobs, runs, 100).select("id")) == ["(2,)", "(3,)", "(4,)"]
    assert S.stale_jobs(jobs, runs, 90).count() == 0  # exactly 90 seconds are not too long


def test_updates_of_all_jobs_are_applied_without_a_python_call_per_job(spark, tmp_path):
    put = lambda *e: spark.createDataFrame(list(e), J.EVENT_SCHEMA)
    first = put((1, 1, 100, "queued", 0, 0, ""), (1, 2, 110, "running", 0, 0, ""), (1, 2, 110, "running", 0, 0, ""), (2, 3, 190, "running", 0, 0, ""), clock(195))
    after = J.advance(J.known_before(spark, str(tmp_path), 0), first, 10, 90)
    assert "Python" not in after._jdf.queryExecution().toString() and "Pandas" not in after._jdf.queryExecution().toString()
    after.write.parquet(str(tmp_path / "known" / "0"))
    facts = lambda df: sorted(tuple(r) for r in df.select("job_id", F.inline("facts")).select("job_id", "fact", "seq", "ts_s", "status").collect())
    assert facts(after) == [(1, "change", 1, 100, "queued"), (1, "change", 2, 110, "running"), (1, "seen", 1, 100, "queued"), (1, "started", 2, 110, "running")]
    known = J.known_before(spark, str(tmp_path), 1)
    second = put((1, 2, 110, "running", 0, 0, ""), (1, 4, 220, "completed", 1, 0, ""), (3, 5, 185, "running", 0, 0, ""), clock(290))  # the first is a replay, that of job 3 too late
    assert facts(J.advance(known, second, 10, 90)) == [
        (1, "change", 4, 220, "completed"), (1, "ended", 4, 220, "completed"), (1, "lost", 2, 200, "failed"), (1, "silent", 2, 110, "running"),
        (2, "change", 3, 190, "running"), (2, "lost", 3, 280, "failed"), (2, "seen", 3, 190, "running"), (2, "silent", 3, 190, "running"), (2, "started", 3, 190, "running")]
