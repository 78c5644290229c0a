"""Roll-ups of book, chapter and job state, and state transitions as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscript.functions.text import safe_file_name, title_announcement
from folioscript.operators import ordered as O

# Live states, busy states, caps and time limits.
LIVE = ["queued", "running"]
BUSY_CHAPTER = ["scripting", "generating"]
ADMISSION_CAPS = {"generate": 2, "script": 3}
STALE_AFTER_SEC = 90
INTERRUPTED = "Interrupted — retry it"
JOBS_PER_BOOK = 25
PAGE_ROWS = 1000
FRONT_MATTER = "Front Matter"
AUDIO_PREFIXES = ["segments/", "chapters/", "previews/", "intro/"]
STAGE_JOBS = {"analyzing": "analyze", "casting": "cast", "scripting_sample": "script", "generating_sample": "generate"}

n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
rename = lambda df, old, new: df.withColumnRenamed(old, new)


def library_summary(books: DataFrame, chapters: DataFrame, cast: DataFrame) -> DataFrame:
    """Chapters, characters of text and cast size per book; children are reduced first."""
    per_ch = chapters.groupBy("book_id").agg(F.count("*").alias("chapter_count"), F.sum("char_count").alias("char_count"))
    per_c = cast.groupBy("book_id").agg(F.count("*").alias("character_count"))
    keys = books.select(F.col("id").alias("book_id"), "title")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return keys.join(per_ch, "book_id", "left").join(per_c, "book_id", "left").select(
        "book_id", "title", zero("chapter_count"), zero("char_count"), zero("character_count"))


def book_status(books: DataFrame, chapters: DataFrame, jobs: DataFrame) -> DataFrame:
    """Status each book settles on from its chapters and live generate jobs."""
    live = jobs.filter((F.col("type") == "generate") & F.col("status").isin(LIVE)).groupBy("book_id").agg(F.lit(True).alias("_live"))
    ch = chapters.groupBy("book_id").agg(
        F.bool_and(F.col("status") == "ready").alias("_ready"), F.bool_or(F.col("status").isin(BUSY_CHAPTER)).alias("_busy"))
    df = rename(books, "id", "book_id").join(live, "book_id", "left").join(ch, "book_id", "left")
    new = (F.when(F.col("_live"), "generating").when(F.col("_ready").isNull(), F.col("status")).when(F.col("_ready"), "ready")
           .when(F.col("_busy"), "generating").when(F.col("status") == "generating", "cast").otherwise(F.col("status")))
    return df.select("book_id", F.col("status").alias("old_status"), new.alias("status"))


def job_counts(jobs: DataFrame) -> DataFrame:
    states = ["queued", "running", "completed", "failed", "cancelled"]
    return jobs.groupBy("type").agg(*[n(F.col("status") == s).alias(s) for s in states], n(F.col("status").isin(LIVE)).alias("active"))


def chapter_narrator(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """The one character narrating a chapter, or null for the book narrator.

    Minimum and maximum of the distinct narrating ids decide it; no set is built.
    """
    ch = chapters.select(F.col("id").alias("chapter_id"), title_announcement(F.col("title")).alias("_announce"))
    rows = segments.filter("kind = 'narration'").join(ch, "chapter_id").filter(
        ~((F.col("idx") == 0) & F.coalesce(F.col("text") == F.col("_announce"), F.lit(False))))
    who = F.coalesce("character_id", F.lit(-1))
    agg = rows.groupBy("chapter_id").agg(F.min(who).alias("lo"), F.max(who).alias("hi"))
    single = agg.filter("lo = hi AND lo >= 0").select("chapter_id", F.col("lo").alias("narrator_id"))
    return ch.select("chapter_id").join(single, "chapter_id", "left")


def stale_chapters(chapters: DataFrame, segments: DataFrame, changed: DataFrame) -> DataFrame:
    """Ready chapters holding a line of a changed character (null id = book narrator).

    ``changed``: (book_id, character_id, is_narrator).
    """
    ready = chapters.filter("status = 'ready'").select(F.col("id").alias("chapter_id"), "book_id")
    used = segments.select("chapter_id", F.coalesce("character_id", F.lit(-1)).alias("who")).distinct()
    target = changed.select("book_id", F.when(F.col("is_narrator"), -1).otherwise(F.col("character_id")).alias("who")).distinct()
    return used.join(ready, "chapter_id").join(target, ["book_id", "who"], "left_semi").select("chapter_id").distinct()


def first_real_chapter(chapters: DataFrame) -> DataFrame:
    rank = F.struct(F.col("title") == FRONT_MATTER, F.col("idx"))
    return chapters.groupBy("book_id").agg(F.min_by(F.struct("id", "status", "error"), rank).alias("sample"))


def setup_stage(books: DataFrame, cast: DataFrame, assignments: DataFrame) -> DataFrame:
    """Where guided setup resumes: analyze, cast review or voice review."""
    has = assignments.select(F.col("character_id").alias("id"), F.lit(True).alias("_has"))
    per = cast.join(has, "id", "left").groupBy("book_id").agg(
        F.count("*").alias("cast_size"), n(F.col("_has").isNull()).alias("missing_voices"))
    df = books.select(F.col("id").alias("book_id")).join(per, "book_id", "left")
    stage = F.when(F.col("cast_size").isNull(), "analyze").when(F.col("missing_voices") == 0, "voice_review").otherwise("cast_review")
    return df.select("book_id", stage.alias("stage"), F.coalesce("missing_voices", F.lit(0)).cast("long").alias("missing_voices"))


def stage_health(books: DataFrame, chapters: DataFrame, jobs: DataFrame) -> DataFrame:
    """Failed or orphaned setup stages and the message to show, by precedence.

    A stage is alive if any job of the book is, however old.
    """
    stage = F.col("pipeline_stage")
    job_type = None
    for s, t in STAGE_JOBS.items():
        job_type = F.when(stage == s, t) if job_type is None else job_type.when(stage == s, t)
    base = rename(books, "id", "book_id").withColumn("_job_type", job_type).join(first_real_chapter(chapters), "book_id", "left")
    live = jobs.filter(F.col("status").isin(LIVE)).select("book_id", "type", "chapter_id").distinct()
    on_book = live.select("book_id", F.col("type").alias("_job_type")).distinct().withColumn("_on_book", F.lit(True))
    on_chapter = live.select("book_id", F.col("type").alias("_job_type"), F.col("chapter_id").alias("_sample_id")).withColumn("_on_chapter", F.lit(True))
    failed_job = jobs.filter("status = 'failed'").groupBy("book_id").agg(
        F.max_by("error", F.struct("created_s", "id")).alias("_job_error"))
    df = (base.withColumn("_sample_id", F.col("sample.id")).join(on_book, ["book_id", "_job_type"], "left")
          .join(on_chapter, ["book_id", "_job_type", "_sample_id"], "left").join(failed_job, "book_id", "left"))
    alive = F.coalesce(F.when(F.col("_job_type").isin("script", "generate"), F.col("_on_chapter")).otherwise(F.col("_on_book")), F.lit(False))
    book_failed = stage.isin("analyzing", "casting") & (F.col("status") == "error")
    sample_failed = F.coalesce(stage.isin("scripting_sample", "generating_sample") & (F.col("sample.status") == "error"), F.lit(False))
    orphaned = F.col("_job_type").isNotNull() & ~alive & ~book_failed & ~sample_failed
    own = F.when(book_failed, F.col("error")).when(sample_failed, F.col("sample.error"))
    failed = F.coalesce(book_failed | sample_failed | orphaned, F.lit(False))
    return df.select(
        "book_id", "pipeline_stage", failed.alias("failed"), F.coalesce(orphaned, F.lit(False)).alias("orphaned"),
        F.when(failed, F.coalesce(own, F.col("_job_error"), F.lit("The step failed."))).alias("message"))


def live_job_per_chapter(jobs: DataFrame) -> DataFrame:
    """The oldest live job of each chapter."""
    live = jobs.filter(F.col("status").isin(LIVE) & F.col("chapter_id").isNotNull())
    return live.groupBy("chapter_id").agg(F.min_by("id", F.struct("created_s", "id")).alias("job_id"))


def chapter_flags(chapters: DataFrame, jobs: DataFrame) -> DataFrame:
    df = chapters.select(F.col("id").alias("chapter_id"), "status").join(live_job_per_chapter(jobs), "chapter_id", "left")
    return df.select(
        "chapter_id", "job_id", (F.col("status").isin(BUSY_CHAPTER) | F.col("job_id").isNotNull()).alias("busy"),
        (~F.col("status").isin("pending", "scripting")).alias("has_script"))


def to_enqueue(chapters: DataFrame, segments: DataFrame, jobs: DataFrame) -> DataFrame:
    """Chapters to queue: not ready and without a live generate job; unscripted ones first get a script."""
    active = jobs.filter((F.col("type") == "generate") & F.col("status").isin(LIVE) & F.col("chapter_id").isNotNull()).select("chapter_id").distinct()
    scripted = segments.select("chapter_id").distinct().withColumn("_scripted", F.lit(True))
    rows = chapters.filter("status <> 'ready'").select(F.col("id").alias("chapter_id"), "book_id", "status")
    rows = rows.join(active, "chapter_id", "left_anti").join(scripted, "chapter_id", "left")
    return rows.select("book_id", "chapter_id", (F.col("_scripted").isNull() | (F.col("status") == "pending")).alias("script_first"))


def admission(jobs: DataFrame, caps: DataFrame) -> DataFrame:
    """Oldest queued jobs that fit under each type's cap right now; ``caps(type, cap)`` has one row per type that is capped."""
    typed = jobs.join(caps, "type").select("id", "type", "status", "created_s", "cap")
    running = typed.groupBy("type").agg((F.max("cap") - n(F.col("status") == "running")).alias("free"))
    place = F.row_number().over(Window.partitionBy("type").orderBy("created_s", "id"))
    head = typed.filter("status = 'queued'").join(running.filter("free > 0"), "type").withColumn("rank", place)
    return head.filter("rank <= free").select("type", "id", "rank")


def admission_caps(spark, caps: dict[str, int] = ADMISSION_CAPS) -> DataFrame:
    return spark.createDataFrame(sorted(caps.items()), "type string, cap long")


def recent_jobs(jobs: DataFrame, k: int = JOBS_PER_BOOK) -> DataFrame:
    return O.top_by(jobs, ["book_id"], [F.col("created_s").desc(), F.col("id").desc()], k)


def job_timing(jobs: DataFrame, as_of_s: int) -> DataFrame:
    """Elapsed seconds, percent and remaining seconds at a given time."""
    elapsed = F.greatest(F.lit(0), F.lit(as_of_s) - F.col("created_s")).cast("double")
    moving = (F.col("total") > 0) & (F.col("done") > 0) & (F.col("done") < F.col("total")) & (elapsed > 2)
    return jobs.select(
        "id", elapsed.alias("elapsed_sec"),
        F.when((F.col("status") == "running") & (F.col("total") > 0), F.col("done") / F.col("total") * 100).alias("percent"),
        F.when(moving, elapsed / F.col("done") * (F.col("total") - F.col("done"))).alias("eta_sec"))


def roll_back(books: DataFrame, chapters: DataFrame, segments: DataFrame, cast: DataFrame, jobs: DataFrame,
              dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chapters and books after the jobs in ``dead`` (id) were found lifeless."""
    hit = jobs.join(dead, "id", "left_semi")
    scripted = segments.select(F.col("chapter_id").alias("id")).distinct().withColumn("_scripted", F.lit(True))
    lost = hit.filter("chapter_id IS NOT NULL").select(F.col("chapter_id").alias("id")).distinct().withColumn("_lost", F.lit(True))
    back = F.when(F.col("_lost") & F.col("status").isin(BUSY_CHAPTER), F.when(F.col("_scripted"), "scripted").otherwise("pending")).otherwise(F.col("status"))
    ch = chapters.join(lost, "id", "left").join(scripted, "id", "left").select(F.col("id").alias("chapter_id"), back.alias("status"))
    still = jobs.filter("status = 'running'").join(dead, "id", "left_anti").select(F.col("book_id").alias("id")).distinct().withColumn("_live", F.lit(True))
    mine = hit.select(F.col("book_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    peopled = cast.select(F.col("book_id").alias("id")).distinct().withColumn("_cast", F.lit(True))
    b = books.join(mine, "id", "left").join(still, "id", "left").join(peopled, "id", "left")
    applies = F.col("_hit") & F.col("_live").isNull() & F.col("status").isin("analyzing", "casting", "generating")
    new = F.when(applies, F.when(F.col("status") == "generating", "cast").when(F.col("_cast"), "analyzed").otherwise("parsed")).otherwise(F.col("status"))
    return ch, b.select(F.col("id").alias("book_id"), new.alias("status"))


FAILED = "id long, status string, note string, error string, updated_s long"


def failed_jobs(jobs: DataFrame, lost: DataFrame) -> DataFrame:
    """What reconciling writes to the jobs in ``lost(id, failed_s)``: failed, their note cleared."""
    return jobs.select("id").join(lost, "id").select(
        "id", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("note"), F.lit(INTERRUPTED).alias("error"), F.col("failed_s").alias("updated_s"))


def stale_jobs(jobs: DataFrame, runs: DataFrame, as_of_s: int, timeout: int = STALE_AFTER_SEC) -> DataFrame:
    """Running jobs without a word for more than ``timeout`` seconds whose run is gone: (id, failed_s).

    ``runs(run_id, state)`` is what the run backend says; a job without a run, or with a run it does not know, is dead.
    """
    going = runs.filter(F.col("state").isin("running", "pending")).select("run_id").distinct()
    quiet = jobs.filter((F.col("status") == "running") & (F.col("updated_s") < as_of_s - timeout)).select("id", "run_id")
    return quiet.join(going, "run_id", "left_anti").select("id", F.lit(as_of_s).cast("long").alias("failed_s"))


def reconcile(books: DataFrame, chapters: DataFrame, segments: DataFrame, cast: DataFrame, jobs: DataFrame,
              lost: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs, chapters and books after the jobs in ``lost(id, failed_s)`` were failed and what they held was rolled back."""
    now = overlay(jobs, failed_jobs(jobs, lost), "id", ["status", "note", "error", "updated_s"])
    ch, bk = roll_back(books, chapters, segments, cast, now, lost.select("id"))
    return now, ch, bk


def set_if(df: DataFrame, column: str, condition: Column, new: Column) -> DataFrame:
    """Guarded update: change rows meeting ``condition`` and mark them in ``changed``."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumn("changed", hit).withColumn(column, F.when(F.col("changed"), new).otherwise(F.col(column)))


def cascade_delete(deleted_books: DataFrame, chapters: DataFrame, segments: DataFrame, cast: DataFrame,
                   assignments: DataFrame) -> dict[str, DataFrame]:
    """Surviving rows of every table below the deleted books (id)."""
    gone = deleted_books.select(F.col("id").alias("book_id"))
    gone_ch = chapters.join(gone, "book_id", "left_semi").select(F.col("id").alias("chapter_id"))
    gone_c = cast.join(gone, "book_id", "left_semi").select(F.col("id").alias("character_id"))
    return {
        "chapters": chapters.join(gone, "book_id", "left_anti"), "segments": segments.join(gone_ch, "chapter_id", "left_anti"),
        "characters": cast.join(gone, "book_id", "left_anti"), "assignments": assignments.join(gone_c, "character_id", "left_anti")}


def null_missing_speakers(segments: DataFrame, cast: DataFrame) -> DataFrame:
    """Clear speakers that no longer exist and flag the lines that lost one."""
    alive = cast.select(F.col("id").alias("_who"), F.lit(True).alias("_ok"))
    who = F.coalesce("character_id", -F.abs(F.xxhash64("chapter_id", "idx")) - 1)  # lines without a speaker are spread
    df = segments.withColumn("_who", who).join(alive, "_who", "left").drop("_who")
    lost = F.col("character_id").isNotNull() & F.col("_ok").isNull()
    return df.withColumns({"flagged": F.col("flagged") | lost, "character_id": F.when(F.col("_ok"), F.col("character_id"))}).drop("_ok")


def overlay(base: DataFrame, live: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rows of ``base`` with ``cols`` taken from ``live`` where it has the key, nulls included."""
    packed = live.select(key, F.struct(*cols).alias("_l"))
    df = base.join(packed, key, "left")
    return df.withColumns({c: F.when(F.col("_l").isNotNull(), F.col(f"_l.{c}")).otherwise(F.col(c)) for c in cols}).drop("_l")


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Next version of a table: incoming rows replace or extend the current ones."""
    cols = [c for c in current.columns if c != key]
    a = current.select(key, F.struct(*cols).alias("_a"))
    b = incoming.select(key, F.struct(*cols).alias("_b"))
    return a.join(b, key, "full").select(key, F.coalesce("_b", "_a").alias("_r")).select(key, "_r.*")


def book_pages(books: DataFrame, chapters: DataFrame, jobs: DataFrame, cast: DataFrame, assignments: DataFrame) -> DataFrame:
    """One nested document per book, in pages of at most 1000 chapters and 1000 characters.

    Page 0 also carries the newest jobs. Paging keeps every array bounded; a page
    that only one of the two lists reaches has null for the other.
    """
    def paged(df: DataFrame, order: list, block, item, name: str) -> DataFrame:
        pos = O.dense_index(df, ["book_id"], order, "_pos", block)
        return pos.groupBy("book_id", F.floor(F.col("_pos") / PAGE_ROWS).cast("long").alias("page")).agg(F.array_sort(F.collect_list(item)).alias(name))

    ch = F.struct("idx", "id", "title", "status", F.col("audio_path").isNotNull().alias("has_audio"))
    pages = paged(chapters, [F.col("idx"), F.col("id")], O.rank_block(F.col("idx")), ch, "chapters")
    voiced = cast.join(assignments.select(F.col("character_id").alias("id"), "voice_id", "voice_name"), "id", "left")
    people = paged(voiced, [F.col("id")], O.rank_block(F.col("id")), F.struct("id", "name", "role", "is_narrator", "voice_id", "voice_name"), "characters")
    last = recent_jobs(jobs).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "type", "status"))).alias("jobs"))
    df = rename(books, "id", "book_id").join(pages.join(people, ["book_id", "page"], "full"), "book_id", "left").withColumn("page", F.coalesce("page", F.lit(0)))
    return df.join(last.withColumn("page", F.lit(0).cast("long")), ["book_id", "page"], "left")


def export_manifest(chapters: DataFrame) -> DataFrame:
    """Playable chapters with their file name in the exported archive."""
    no = F.col("idx") + 1
    name = safe_file_name(F.col("title"), F.concat(F.lit("Chapter "), no.cast("string")))
    padded = F.when(no < 10, F.concat(F.lit("0"), no.cast("string"))).otherwise(no.cast("string"))
    return chapters.filter(F.col("audio_path").isNotNull() & F.col("status").isin("ready", "stale")).select(
        "book_id", F.col("id").alias("chapter_id"), "idx", "audio_path", F.concat(padded, F.lit(" - "), name, F.lit(".mp3")).alias("file_name"))


def segment_audio_path(book: Column, key: Column) -> Column:
    return F.format_string("segments/%s/%s.mp3", book.cast("string"), key)


def chapter_audio_path(book: Column, idx: Column, content_hash: Column) -> Column:
    return F.format_string("chapters/%s/chapter-%03d-%s.mp3", book.cast("string"), idx, content_hash)


def preview_audio_path(key: Column) -> Column:
    return F.format_string("previews/%s.mp3", key)


def intro_audio_path(book: Column, key: Column) -> Column:
    return F.format_string("intro/%s/%s.mp3", book.cast("string"), key)


def is_audio_path(path: Column) -> Column:
    known = F.lit(False)
    for prefix in AUDIO_PREFIXES:
        known = known | path.startswith(prefix)
    return known & path.endswith(".mp3") & ~F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))


# ---- job update log (batch form of the streaming operators) ---------------

def job_progress(events: DataFrame) -> DataFrame:
    """Monotone progress per job; replays change nothing."""
    return events.groupBy("job_id").agg(
        F.max("done").alias("done"), F.max("chars_used").alias("chars_used"), F.max_by("note", "seq").alias("note"))


def job_outcome(events: DataFrame) -> DataFrame:
    """First accepted terminal event per job.

    Completed and failed need an earlier running event; cancelled needs none.
    Both steps are plain aggregates, so a job with very many events is fine.
    """
    started = events.filter("status = 'running'").groupBy("job_id").agg(F.min("seq").alias("started_seq"))
    ends = events.filter(F.col("status").isin("completed", "failed", "cancelled")).join(started, "job_id", "left")
    valid = ends.filter((F.col("status") == "cancelled") | (F.col("seq") > F.col("started_seq")))
    final = valid.groupBy("job_id").agg(F.min_by(F.struct("seq", "status"), "seq").alias("e"))
    jobs = events.select("job_id").distinct()
    return jobs.join(started, "job_id", "left").join(final, "job_id", "left").select(
        "job_id", F.coalesce("e.status", F.when(F.col("started_seq").isNotNull(), "running").otherwise("queued")).alias("status"), F.col("e.seq").alias("end_seq"))


def silent_gaps(events: DataFrame, as_of_s: int, timeout: int = STALE_AFTER_SEC) -> DataFrame:
    """Running updates followed by silence of at least ``timeout`` seconds."""
    after = O.nearest(events, ["job_id"], [F.col("seq")], F.col("ts_s"), F.lit(True), "next_s", O.rank_block(F.col("seq")), ahead=True)
    gap = F.coalesce("next_s", F.lit(as_of_s)) - F.col("ts_s")
    return after.withColumn("gap_sec", gap).filter((F.col("status") == "running") & (F.col("gap_sec") >= timeout)).select("job_id", "seq", "gap_sec")


def lost_jobs(events: DataFrame, as_of_s: int, timeout: int = STALE_AFTER_SEC) -> DataFrame:
    """Jobs that fell silent for ``timeout`` seconds after they had started and before they ended: (id, failed_s)."""
    after = O.nearest(events, ["job_id"], [F.col("seq")], F.col("ts_s"), F.lit(True), "next_s", O.rank_block(F.col("seq")), ahead=True)
    quiet = after.filter(F.coalesce("next_s", F.lit(as_of_s)) - F.col("ts_s") >= timeout)
    begun = events.filter("status = 'running'").groupBy("job_id").agg(F.min("seq").alias("started_seq"))
    span = begun.join(job_outcome(events).select("job_id", "end_seq"), "job_id")
    first = quiet.join(span, "job_id").filter("seq >= started_seq AND (end_seq IS NULL OR seq < end_seq)").groupBy("job_id").agg(F.min("ts_s").alias("t"))
    return first.select(F.col("job_id").alias("id"), (F.col("t") + timeout).alias("failed_s"))


def status_changes(events: DataFrame) -> DataFrame:
    """Updates whose status differs from the one before (the first always counts)."""
    df = O.previous_row(events, ["job_id"], [F.col("seq")], ["status"], "prev", O.rank_block(F.col("seq")))
    return df.filter(F.col("prev").isNull() | (F.col("prev.status") != F.col("status"))).select(
        "job_id", "seq", F.col("prev.status").alias("from_status"), "status")


def latest_per_job(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").agg(F.max_by(F.struct("seq", "status", "done"), "seq").alias("_r")).select("job_id", "_r.*")
