"""Streaming queries over the whole event log, late and replayed; SQL twins are the batch forms.

The log arrives in waves. An update comes up to DELAY_S after its time, one in seven once
more half as long after that, so that most updates of a wave are older than some of the
wave before. A last row without a job is the clock: it moves the watermark past the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscript.operators import status as S
from folioscript.plans import status_queries as SQ
from folioscript.plans.status_queries import EVENTS_AS_OF, GAP_SEC, events_as_updates
from folioscript.session import cut_lineage, shared_dir
from folioscript.sources.model import Model
from folioscript.sources.sql_model import with_model
from folioscript.streaming import jobs as J

WAVES = 4
DELAY_S = 2 * 86_400
ROWS_PER_FILE = 1_000_000


def scattered(m: Model, waves: int = WAVES) -> tuple[DataFrame, int]:
    """The log as a stream in the order of its arrival, a wave per micro-batch, and how late updates may be."""
    log = m.table("events")
    size = log.agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("lo"), F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("hi"), F.count("*").alias("n")).first()
    lo, hi, files = size["lo"] or 0, size["hi"] or 0, 1 + (size["n"] or 0) // (waves * ROWS_PER_FILE)
    step = (hi - lo + 2 * DELAY_S) // waves + 1
    luck = F.pmod(F.xxhash64("event_id"), F.lit(DELAY_S))
    at = F.unix_seconds(F.col("ts").cast("timestamp")) + luck
    again = F.when(luck % 7 == 0, F.array(at, at + DELAY_S // 2)).otherwise(F.array(at))
    arrivals = log.select("*", F.explode(again).alias("_at")).withColumn("_wave", F.floor((F.col("_at") - lo) / step))
    late = DELAY_S + DELAY_S // 2 + step
    source = shared_dir(m.spark, "arrivals")
    for nth in range(waves):
        arrivals.filter(F.col("_wave") == nth).select(log.columns).repartition(files, "event_id").write.mode("append").parquet(source)
    clock = (F.lit(EVENTS_AS_OF + late) + 0.001).cast("timestamp")
    end = m.spark.range(1).select(*[(clock if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in log.schema.fields])
    end.write.mode("append").parquet(source)
    stream = m.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(source)
    return events_as_updates(stream), late


def _facts(spark, d) -> DataFrame:
    root = shared_dir(spark, "facts")
    stream, late = scattered(Model(spark, d))
    J.start_facts(stream, root, late, GAP_SEC).awaitTermination()
    return J.facts(spark, root)


def stream_status_changes(spark, d):
    return J.status_changes(_facts(spark, d))


def stream_job_outcome(spark, d):
    return J.job_outcome(_facts(spark, d))


def stream_silent_jobs(spark, d):
    """Running updates that stayed without a successor, found by the timer."""
    return J.silent(_facts(spark, d))


def stream_job_progress(spark, d):
    root = shared_dir(spark, "progress")
    stream, _ = scattered(Model(spark, d))
    J.start_progress(stream, root).awaitTermination()
    return J.progress_table(spark, root).read().select("job_id", "done", "chars_used", "note")


def stream_latest_job_rows(spark, d):
    root = shared_dir(spark, "latest")
    stream, late = scattered(Model(spark, d))
    J.start_latest(stream, root, late).awaitTermination()
    return J.latest_table(spark, root).read()


def logged_jobs(m: Model) -> DataFrame:
    """The jobs whose updates are in the log, all of them running as far as the job table knows."""
    ids = m.table("events").select(F.col("user_id").alias("id")).distinct()
    return m.jobs.join(ids, "id", "left_semi").withColumn("status", F.lit("running"))


def stream_reconcile(spark, d):
    """Jobs that the timer finds silent fail, chapter and book are rolled back, batch by batch."""
    m = Model(spark, d)
    root = shared_dir(spark, "reconcile")
    stream, late = scattered(m)
    jobs = cut_lineage(logged_jobs(m), "jobs")
    J.start_reconcile(stream, root, late, m.books, m.chapters, m.segments, m.characters, jobs, GAP_SEC).awaitTermination()
    failed, chapters, books = (t.read() for t in J.reconcile_tables(spark, root))
    return SQ.reconciled_rows(failed, chapters, books)


RECONCILE_SQL = with_model(f"""SELECT 'job' AS kind, id, 'failed' AS status, CAST(NULL AS VARCHAR) AS note, '{S.INTERRUPTED}' AS error FROM hit
    UNION ALL SELECT 'chapter', id, CASE WHEN status IN ('scripting', 'generating') THEN CASE WHEN id IN (SELECT chapter_id FROM segments) THEN 'scripted' ELSE 'pending' END ELSE status END, NULL, NULL
      FROM chapters WHERE id IN (SELECT chapter_id FROM hit WHERE chapter_id IS NOT NULL)
    UNION ALL SELECT 'book', id, CASE WHEN status IN ('analyzing', 'casting', 'generating') AND id NOT IN (SELECT book_id FROM live WHERE NOT dead)
      THEN CASE WHEN status = 'generating' THEN 'cast' WHEN id IN (SELECT book_id FROM characters) THEN 'analyzed' ELSE 'parsed' END ELSE status END, NULL, NULL
      FROM books WHERE id IN (SELECT book_id FROM hit)""", {
    **SQ.EX, "lost": SQ.LOST_SQL,
    "live": "SELECT j.*, l.id IS NOT NULL AS dead FROM jobs j LEFT JOIN lost l ON l.id = j.id WHERE j.id IN (SELECT user_id FROM events)",
    "hit": "SELECT * FROM live WHERE dead"})

QUERIES = {
    "stream_status_changes": (stream_status_changes, SQ.QUERIES["status_changes"][1]),
    "stream_job_outcome": (stream_job_outcome, SQ.QUERIES["job_outcome"][1]),
    "stream_silent_jobs": (stream_silent_jobs, SQ.W(f"""SELECT job_id, seq, ts_s FROM (SELECT *, coalesce(lead(ts_s) OVER (PARTITION BY job_id ORDER BY seq), {EVENTS_AS_OF}) - ts_s AS gap_sec FROM ev)
        WHERE status = 'running' AND gap_sec >= {GAP_SEC}""")),
    "stream_job_progress": (stream_job_progress, SQ.QUERIES["job_progress"][1]),
    "stream_latest_job_rows": (stream_latest_job_rows, SQ.QUERIES["latest_job_rows"][1]),
    "stream_reconcile": (stream_reconcile, RECONCILE_SQL),
}
