"""Job update log as a stream: lifecycle, silence and status changes, progress, latest rows.

:func:`follow` holds a job's updates until the watermark has passed them, then applies
them in the order of the log, so that late and replayed updates end in what the batch
operators of :mod:`folioscript.operators.status` give for the whole log. What may still
be late bounds the state of a job. Silence is reported without any further update of
that job: the watermark alone, moved on by other jobs, fires it.

Updates later than the watermark allows are dropped. ``seq`` is the place of an update
in its job's log and never falls as time goes on; a second update of one place is a
replay. Progress never goes back, so for it order does not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscript.operators import status as S
from folioscript.session import cut_lineage
from folioscript.sources.sinks import StoredTable

EVENT_SCHEMA = "job_id long, seq long, ts_s long, status string, done long, chars_used long, note string"
FACTS = "job_id long, fact string, seq long, ts_s long, from_status string, status string"
KNOWN = ("job_id long, seq long, ts_s long, status string, origin int, started long, ended long, lost boolean, quiet boolean, "
         "facts array<struct<fact: string, seq: long, ts_s: long, from_status: string, status: string>>")
PROGRESS = "job_id long, done long, chars_used long, note string, note_seq long"
LATEST = "job_id long, seq long, status string, done long"
TERMINAL = ("completed", "failed", "cancelled")


def with_watermark(stream: DataFrame, lateness_s: int) -> DataFrame:
    return stream.withColumn("at", F.timestamp_seconds("ts_s")).withWatermark("at", f"{lateness_s} seconds")


def known_before(spark, root: str, n: int) -> DataFrame:
    """What batch ``n`` starts from: held updates, the last applied one of each job, and the clock (a row without a job)."""
    return spark.read.schema(KNOWN).parquet(f"{root}/known/{(n - 1) % 2}") if n else spark.createDataFrame([], KNOWN)


def advance(known: DataFrame, batch: DataFrame, lateness_s: int, timeout: int) -> DataFrame:
    """``known`` after the updates in ``batch``, with the facts that follow, by one sort of (job, place).

    Of a job, first comes what is known of it, then its updates in the order of their places. Up to the first one
    that the watermark has not passed they are applied; that one and those behind it stay held.
    """
    clock = known.filter("job_id IS NULL").agg(F.max("ts_s")).first()[0]
    latest = max((t for t in (clock, batch.agg(F.max("ts_s")).first()[0]) if t is not None), default=None)
    mark, late = (F.lit(None if t is None else t - lateness_s).cast("long") for t in (latest, clock))
    new = batch.filter("job_id IS NOT NULL").filter(F.coalesce(F.col("ts_s") > late, F.lit(True))).select("job_id", "seq", "ts_s", "status", F.lit(2).alias("origin"))
    rows = known.filter("job_id IS NOT NULL AND origin IS NOT NULL").drop("facts").unionByName(new, allowMissingColumns=True)

    order = Window.partitionBy("job_id").orderBy(F.col("origin") > 0, "seq", "origin")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    update = F.col("origin") > 0
    rows = rows.withColumns({"_at": F.first(F.when(~update, F.col("seq")), ignorenulls=True).over(so_far), "_last": F.lag(F.when(update, F.col("seq"))).over(order)})
    rows = rows.filter(~update | (F.coalesce(F.col("seq") > F.col("_at"), F.lit(True)) & ~F.coalesce(F.col("seq") == F.col("_last"), F.lit(False))))

    ahead = F.coalesce(update & (F.col("ts_s") > mark), F.lit(False))
    begun = F.when(update, F.when(F.col("status") == "running", F.col("seq"))).otherwise(F.col("started"))
    rows = rows.withColumns({"held": F.max(ahead).over(so_far), "started": F.min(begun).over(so_far),
                             "_from": F.lag("status").over(order), "_seen": F.lag(F.lit(True)).over(order).isNull()})
    over = (F.col("status") == "cancelled") | (F.col("status").isin(*TERMINAL) & (F.col("seq") > F.col("started")))
    rows = rows.withColumns({"ended": F.min(F.when(update, F.when(over, F.col("seq"))).otherwise(F.col("ended"))).over(so_far),
                             "_newest": F.coalesce(F.lead("held").over(order), F.lit(True)), "_next": F.lead("ts_s").over(order)})
    silence = F.coalesce(F.when(F.col("_newest"), mark).otherwise(F.col("_next")) - F.col("ts_s") >= timeout, F.lit(False))
    rows = rows.withColumn("_quiet", ~F.col("held") & silence).withColumn("_falls", F.col("_quiet") & ~(~update & F.coalesce("quiet", F.lit(False))))
    gone = F.col("_falls") & F.col("started").isNotNull() & F.col("ended").isNull()
    known_lost = ~update & F.coalesce("lost", F.lit(False))
    rows = rows.withColumn("_lost", gone | known_lost)
    dies = gone & ~known_lost & ~F.coalesce(F.max("_lost").over(before), F.lit(False))

    applied = update & ~F.col("held")
    fact = lambda when, name, came, status, ts=F.col("ts_s"): F.when(when, F.struct(F.lit(name).alias("fact"), F.col("seq"), ts.alias("ts_s"), came.alias("from_status"), status.alias("status")))
    none, running = F.lit(None).cast("string"), F.lit("running")
    found = F.filter(F.array(
        fact(applied & ~F.col("_from").eqNullSafe(F.col("status")), "change", F.col("_from"), F.col("status")),
        fact(applied & (F.col("started") == F.col("seq")), "started", none, running),
        fact(applied & (F.col("ended") == F.col("seq")), "ended", none, F.col("status")),
        fact(applied & F.col("_seen"), "seen", none, F.col("status")),
        fact(F.col("_falls") & (F.col("status") == "running"), "silent", none, running),
        fact(dies, "lost", running, F.lit("failed"), F.col("ts_s") + timeout)), lambda x: x.isNotNull())
    out = rows.withColumns({"lost": F.max("_lost").over(so_far), "facts": found})
    keeps = F.when(F.col("held"), 1).when(F.col("_newest"), 0)  # others are applied and followed by another applied one: only their facts remain
    blank = lambda c: F.when(keeps == 0, F.col(c))
    out = out.select("job_id", "seq", "ts_s", "status", keeps.alias("origin"), blank("started").alias("started"), blank("ended").alias("ended"),
                     blank("lost").alias("lost"), blank("_quiet").alias("quiet"), "facts").filter(F.col("origin").isNotNull() | (F.size("facts") > 0))
    time = known.sparkSession.range(1).select(F.lit(latest).cast("long").alias("ts_s"))
    return out.unionByName(time, allowMissingColumns=True)


def follow(stream: DataFrame, root: str, lateness_s: int, handle: Callable[[DataFrame, int], None], timeout: int = S.STALE_AFTER_SEC) -> StreamingQuery:
    """Give ``handle`` the facts about every job, each once, as soon as the watermark allows: (job_id, fact, seq, ts_s, from_status, status).

    ``seen``: its first update. ``change``: a status unlike the one before. ``started``, ``ended``: first running and first
    accepted terminal update. ``silent``: a running update followed by ``timeout`` seconds without another. ``lost``: a started job
    that has not ended falls silent and fails, at ts_s. Rows without a job_id only move the watermark on, like a clock.

    What is known lies below ``root`` in two places that batches use in turn, so a repeated batch starts from what the one before it left.
    """
    spark = stream.sparkSession

    def run(batch: DataFrame, n: int) -> None:
        place = f"{root}/known/{n % 2}"
        advance(known_before(spark, root, n), batch, lateness_s, timeout).write.mode("overwrite").option("compression", "zstd").parquet(place)
        handle(spark.read.schema(KNOWN).parquet(place).select("job_id", F.inline("facts")), n)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def start_facts(stream: DataFrame, root: str, lateness_s: int, timeout: int = S.STALE_AFTER_SEC) -> StreamingQuery:
    """Keep the facts of ``stream`` below ``root``, those of a batch in a place of its own, so each is kept once however often a batch is run."""
    return follow(stream, root, lateness_s, lambda found, n: found.write.mode("overwrite").parquet(f"{root}/facts/batch={n}"), timeout)


def facts(spark, root: str) -> DataFrame:
    return spark.read.schema(FACTS).parquet(f"{root}/facts").drop("batch")


def status_changes(found: DataFrame) -> DataFrame:
    return found.filter("fact = 'change'").select("job_id", "seq", "from_status", "status")


def job_outcome(found: DataFrame) -> DataFrame:
    """Status and end of each job: the first accepted terminal update, else whether it has started."""
    rank = F.when(F.col("fact") == "ended", 2).when(F.col("fact") == "started", 1).otherwise(0)
    last = found.filter("fact IN ('seen', 'started', 'ended')").groupBy("job_id").agg(F.max_by(F.struct("fact", "status", "seq"), rank).alias("r"))
    return last.select("job_id", F.when(F.col("r.fact") == "seen", "queued").otherwise(F.col("r.status")).alias("status"),
                       F.when(F.col("r.fact") == "ended", F.col("r.seq")).alias("end_seq"))


def silent(found: DataFrame) -> DataFrame:
    return found.filter("fact = 'silent'").select("job_id", "seq", "ts_s")


def lost(found: DataFrame) -> DataFrame:
    """Jobs that fell silent while they ran: (id, failed_s)."""
    return found.filter("fact = 'lost'").select(F.col("job_id").alias("id"), F.col("ts_s").alias("failed_s"))


def start_reconcile(stream: DataFrame, root: str, lateness_s: int, books: DataFrame, chapters: DataFrame, segments: DataFrame, cast: DataFrame,
                    jobs: DataFrame, timeout: int = S.STALE_AFTER_SEC, alive: DataFrame | None = None) -> StreamingQuery:
    """Fail jobs as they fall silent, roll their chapters and books back, and keep both as stored tables below ``root``.

    Each batch stores the jobs it failed and rewrites the chapters and books these touch; a repeated batch ends in the same tables.
    """
    spark = books.sparkSession
    failed, chapter_table, book_table = reconcile_tables(spark, root)

    def handle(found: DataFrame, n: int) -> None:
        dead = lost(found)
        if alive is not None:
            dead = dead.join(alive, "id", "left_anti")
        if dead.isEmpty():
            return
        failed.upsert(S.failed_jobs(jobs, dead), version=n)
        hit = cut_lineage(jobs.join(dead.select("id"), "id", "left_semi").select("book_id", "chapter_id"), "hit")
        all_failed = failed.read()
        ch, bk = S.roll_back(
            books.join(hit.select(F.col("book_id").alias("id")), "id", "left_semi"), chapters.join(hit.select(F.col("chapter_id").alias("id")), "id", "left_semi"),
            segments.join(hit.select("chapter_id"), "chapter_id", "left_semi"), cast, S.overlay(jobs, all_failed, "id", ["status", "note", "error"]), all_failed.select("id"))
        chapter_table.upsert(ch, version=n)
        book_table.upsert(bk, version=n)

    return follow(stream, root, lateness_s, handle, timeout)


def reconcile_tables(spark, root: str) -> tuple[StoredTable, StoredTable, StoredTable]:
    return (StoredTable(spark, f"{root}/failed", S.FAILED, ["id"]), StoredTable(spark, f"{root}/chapters", "chapter_id long, status string", ["chapter_id"]),
            StoredTable(spark, f"{root}/books", "book_id long, status string", ["book_id"]))


def progress_stream(stream: DataFrame) -> DataFrame:
    """Monotone progress as a streaming aggregate; partials combine before the shuffle."""
    latest = F.max(F.struct("seq", "note"))
    return stream.groupBy("job_id").agg(F.max("done").alias("done"), F.max("chars_used").alias("chars_used"), latest.alias("l")).select(
        "job_id", "done", "chars_used", F.col("l.note").alias("note"), F.col("l.seq").alias("note_seq"))


def progress_table(spark, root: str) -> StoredTable:
    return StoredTable(spark, f"{root}/rows", PROGRESS, ["job_id"])


def start_progress(stream: DataFrame, root: str) -> StreamingQuery:
    """Keep the progress of every job in a stored table; a batch sends the jobs it changed and rewrites their buckets."""
    table = progress_table(stream.sparkSession, root)
    return (progress_stream(stream.filter("job_id IS NOT NULL")).writeStream.outputMode("update").foreachBatch(lambda df, n: table.upsert(df, version=n))
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())


def latest_stream(stream: DataFrame, lateness_s: int) -> DataFrame:
    """Updates without their replays."""
    rows = with_watermark(stream.filter("job_id IS NOT NULL"), lateness_s)
    return rows.dropDuplicatesWithinWatermark(["job_id", "seq"]).select("job_id", "seq", "status", "done")


def latest_table(spark, root: str) -> StoredTable:
    return StoredTable(spark, f"{root}/rows", LATEST, ["job_id"])


def start_latest(stream: DataFrame, root: str, lateness_s: int) -> StreamingQuery:
    """Keep the latest row of every job, whatever order and however often updates arrive."""
    table = latest_table(stream.sparkSession, root)
    newest = F.max(F.struct("seq", "status", "done"))

    def handle(batch: DataFrame, n: int) -> None:
        rows = batch.groupBy("job_id").agg(newest.alias("r")).select("job_id", "r.*")
        table.upsert(rows, {c: F.max_by(c, "seq") for c in ("seq", "status", "done")}, version=n)

    return (latest_stream(stream, lateness_s).writeStream.outputMode("append").foreachBatch(handle)
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
