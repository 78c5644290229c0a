"""Queries over status, edits and checks, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscript.operators import edits as E
from folioscript.operators import ordered as O
from folioscript.operators import quality as Q
from folioscript.operators import script as SC
from folioscript.operators import status as S
from folioscript.operators import voices as V
from folioscript.plans.cast_queries import _override_commands, OVERRIDES
from folioscript.plans.text_queries import ANNOUNCE_SQL
from folioscript.session import shared_dir
from folioscript.sources import samples as SM
from folioscript.sources import sinks as SK
from folioscript.sources.model import Model, pick
from folioscript.sources.sql_model import pick as spick
from folioscript.sources.sql_model import WS, trim_ws, with_model

AS_OF = 915_148_800  # fixed value: 1999-01-01T00:00:00Z
EVENTS_AS_OF = 1_706_745_600  # fixed value: 2024-02-01T00:00:00Z
GAP_SEC = 4 * 3600
STATUS_OF_EVENT = {"signup": "queued", "view": "running", "click": "cancelled", "purchase": "completed", "error": "failed"}


def events_as_updates(events):
    """The event log in the columns of a job update log."""
    status = None
    for k, v in STATUS_OF_EVENT.items():
        status = F.when(F.col("event_type") == k, v) if status is None else status.when(F.col("event_type") == k, v)
    return events.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_s"),
        status.alias("status"), F.floor("value").cast("long").alias("done"),
        F.get_json_object("props", "$.k").cast("long").alias("chars_used"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"))


def job_events(m: Model):
    return events_as_updates(m.table("events"))


EVENTS_CTE = {"ev": "SELECT user_id AS job_id, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, CASE event_type "
              + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_OF_EVENT.items())
              + " END AS status, CAST(floor(value) AS BIGINT) AS done, CAST(json_extract_string(props, '$.k') AS BIGINT) AS chars_used, 'note ' || event_id AS note FROM events"}


def library_summary(spark, d):
    m = Model(spark, d)
    return S.library_summary(m.books, m.chapters, m.characters)


def book_status_rollup(spark, d):
    m = Model(spark, d)
    return S.book_status(m.books, m.chapters, m.jobs)


def job_counts(spark, d):
    return S.job_counts(Model(spark, d).jobs)


def chapter_narrator(spark, d):
    m = Model(spark, d)
    return S.chapter_narrator(m.segments, m.chapters)


def stale_chapters(spark, d):
    m = Model(spark, d)
    cmds = V.voice_overrides(_override_commands(m), m.characters, m.assignments, m.voices).filter("reject_reason IS NULL")
    return S.stale_chapters(m.chapters, m.segments, cmds.select("book_id", "character_id", "is_narrator"))


def sample_chapter(spark, d):
    return S.first_real_chapter(Model(spark, d).chapters).select("book_id", F.col("sample.id").alias("chapter_id"))


def setup_stage(spark, d):
    m = Model(spark, d)
    return S.setup_stage(m.books, m.characters, m.assignments)


def stage_health(spark, d):
    m = Model(spark, d)
    return S.stage_health(m.books, m.chapters, m.jobs)


def chapter_flags(spark, d):
    m = Model(spark, d)
    return S.chapter_flags(m.chapters, m.jobs)


def chapters_to_enqueue(spark, d):
    m = Model(spark, d)
    return S.to_enqueue(m.chapters, m.segments, m.jobs)


def admission_snapshot(spark, d):
    """Admission over the jobs as they are, where the pools have grown so that each has its usual cap free."""
    jobs = Model(spark, d).jobs
    running = jobs.filter("status = 'running'").groupBy("type").agg(F.count("*").alias("running"))
    caps = S.admission_caps(spark).join(running, "type", "left").select("type", (F.col("cap") + F.coalesce("running", F.lit(0))).alias("cap"))
    return S.admission(jobs, caps).select("type", "id", F.col("rank").cast("long"))


def recent_jobs(spark, d):
    return S.recent_jobs(Model(spark, d).jobs).select("book_id", "id", F.col("rank").cast("long"))


def job_timing(spark, d):
    t = S.job_timing(Model(spark, d).jobs, AS_OF)
    return t.select("id", "elapsed_sec", F.round("percent", 6).alias("percent"), F.round("eta_sec", 3).alias("eta_sec"))


def _dead(m):
    return m.jobs.filter((F.col("status") == "running") & F.col("run_id").isNull()).select("id")


def rollback_chapters(spark, d):
    m = Model(spark, d)
    return S.roll_back(m.books, m.chapters, m.segments, m.characters, m.jobs, _dead(m))[0]


def rollback_books(spark, d):
    """Books after every running job was found dead."""
    m = Model(spark, d)
    return S.roll_back(m.books, m.chapters, m.segments, m.characters, m.jobs, m.jobs.filter("status = 'running'").select("id"))[1]


RECONCILE_AT = 788_918_400  # fixed value: 1995-01-01T00:00:00Z


def run_states(m):
    """What the run backend knows: two runs in seven are gone, one in seven has ended."""
    runs = m.jobs.filter("run_id IS NOT NULL").select("run_id").distinct()
    nth = F.substring("run_id", 5, 9).cast("long") % 7
    return runs.filter(nth < 5).select("run_id", F.when(nth == 0, "completed").when(nth == 1, "pending").otherwise("running").alias("state"))


def reconciled_rows(now, ch, bk):
    """The three tables of a reconcile as one: kind, id, status, note, error."""
    none = F.lit(None).cast("string")
    return (now.select(F.lit("job").alias("kind"), "id", "status", "note", "error")
            .unionByName(ch.select(F.lit("chapter").alias("kind"), F.col("chapter_id").alias("id"), "status", none.alias("note"), none.alias("error")))
            .unionByName(bk.select(F.lit("book").alias("kind"), F.col("book_id").alias("id"), "status", none.alias("note"), none.alias("error"))))


def reconcile_stale_jobs(spark, d):
    """Silent jobs whose run is gone fail; their chapters and books go back to the last stable status."""
    m = Model(spark, d)
    lost = S.stale_jobs(m.jobs, run_states(m), RECONCILE_AT)
    return reconciled_rows(*S.reconcile(m.books, m.chapters, m.segments, m.characters, m.jobs, lost))


def guarded_stage_update(spark, d):
    jobs = S.set_if(Model(spark, d).jobs, "status", (F.col("status") == "running") & (F.col("id") % 2 == 0), F.lit("completed"))
    return jobs.groupBy("type", "status").agg(S.n(F.col("changed")).alias("changed"), F.count("*").alias("n"))


def cancel_book_jobs(spark, d):
    """Jobs that a cancel request for the even books flips, with a run to stop."""
    jobs = Model(spark, d).jobs
    hit = jobs.filter((F.col("book_id") % 2 == 0) & F.col("status").isin(S.LIVE))
    return hit.select("id", "book_id", "status", F.when((F.col("status") == "running") & F.col("run_id").isNotNull(), F.col("run_id")).alias("run_to_stop"))


def cascade_delete(spark, d):
    m = Model(spark, d)
    left = S.cascade_delete(m.books.filter("id % 3 = 0"), m.chapters, m.segments, m.characters, m.assignments)
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def speakers_set_null(spark, d):
    m = Model(spark, d)
    return S.null_missing_speakers(m.segments, m.characters.filter("id % 2 = 0")).select("chapter_id", "idx", "character_id", "flagged")


def live_overlay(spark, d):
    m = Model(spark, d)
    live = m.jobs.filter("chapter_id IS NOT NULL AND id = chapter_id").select(
        F.col("id"), F.when(F.col("status") == "queued", None).otherwise(F.concat(F.lit("live "), "status")).alias("status"), F.col("error"))
    return S.overlay(m.chapters.select("id", "status", "error"), live, "id", ["status", "error"])


def upsert_clips(spark, d):
    m = Model(spark, d)
    cur = m.assignments.select("character_id", "voice_id", "voice_name")
    new = m.characters.filter("id % 4 = 0").select((F.col("id") + 7).alias("character_id"), F.lit("v1-1").alias("voice_id"), F.lit(None).cast("string").alias("voice_name"))
    return S.upsert(cur, new, "character_id")


def nested_book_pages(spark, d):
    m = Model(spark, d)
    flat = lambda c: F.md5(F.array_join(F.transform(c, lambda x: F.concat_ws("~", x["idx"], x["id"], x["title"], x["status"], x["has_audio"].cast("string"))), "|"))
    jobs = F.array_join(F.transform("jobs", lambda x: F.concat_ws("~", x["id"], x["type"], x["status"])), "|")
    people = F.array_join(F.transform("characters", lambda x: F.concat_ws("~", x["id"], x["name"], x["role"], x["voice_id"], x["voice_name"])), "|")
    return S.book_pages(m.books, m.chapters, m.jobs, m.characters, m.assignments).select(
        "book_id", "page", F.when(F.col("chapters").isNotNull(), F.size("chapters")).cast("long").alias("n_chapters"), flat(F.col("chapters")).alias("chapters_hash"),
        F.when(F.col("characters").isNotNull(), F.size("characters")).cast("long").alias("n_characters"), F.md5(people).alias("characters_hash"), F.md5(jobs).alias("jobs_hash"))


def export_manifest(spark, d):
    return S.export_manifest(Model(spark, d).chapters)


def output_paths(spark, d):
    m = Model(spark, d)
    h = F.substring(F.sha2(F.col("title"), 256), 1, 12)
    return m.chapters.select("id", S.chapter_audio_path(F.col("book_id"), F.col("idx"), h).alias("chapter_path"),
                             S.segment_audio_path(F.col("book_id"), h).alias("segment_path"), S.preview_audio_path(h).alias("preview_path"),
                             S.intro_audio_path(F.col("book_id"), h).alias("intro_path"))


def valid_audio_paths(spark, d):
    path = F.concat(pick(["segments/", "chapters", "other/", "intro/./", "previews/"], F.col("page_id")), F.col("url"), pick([".mp3", "/", ".mp3"], F.col("page_id")))
    clean = F.regexp_replace(path, "://", "/")
    return Model(spark, d).table("pages").select("page_id", S.is_audio_path(clean).alias("ok"))


def snapshot_freshness(spark, d):
    age = F.lit(AS_OF) - F.col("updated_s")
    return Model(spark, d).jobs.select("id", (age < V.SNAPSHOT_USABLE_SEC).alias("usable"), (age > V.SNAPSHOT_REFRESH_SEC).alias("needs_refresh"))


STORED = "book_id long, chapter_id long, idx long, kind string, text string"
NEW_SCRIPTS = 64


def replaced_scripts(spark, d):
    """All scripts stored, then those of one chapter in four replaced: every other one of these by its speech alone, the rest by nothing."""
    m = Model(spark, d)
    rows = m.segments.join(m.chapters.select(F.col("id").alias("chapter_id"), "book_id"), "chapter_id").select("book_id", "chapter_id", "idx", "kind", "text")
    table = SK.StoredTable(spark, shared_dir(spark, "scripts"), STORED, ["chapter_id"], NEW_SCRIPTS)
    keys = rows.select("book_id", "chapter_id").distinct()
    SK.replace_scripts(table, keys, rows)
    SK.replace_scripts(table, keys.filter("chapter_id % 4 = 1"), rows.filter("chapter_id % 8 = 1 AND kind <> 'sfx'"))
    return table.read().groupBy("book_id", "chapter_id").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("text").alias("last_text"))


def rescripted_chapters(spark, d):
    """Chapters after their scripts were replaced."""
    m = Model(spark, d)
    hit = m.segments.filter("chapter_id % 4 = 1").select("chapter_id").distinct()
    return SK.scripted(m.timed_chapters.select("id", "status", "audio_path", "duration_sec", "error"), hit)


FETCHED = (AS_OF - 90_000, AS_OF - 7_200)


def voice_snapshot(spark, d):
    """The catalogue stored twice, the second time without its first voices, and read back: usable, with a refresh due."""
    m = Model(spark, d)
    voices = m.voices.select("id", "name", "accent")
    table = SK.StoredTable(spark, shared_dir(spark, "catalogue"), "id string, name string, accent string, fetched_at_s long", ["id"], NEW_SCRIPTS)
    SK.write_snapshot(table, voices, FETCHED[0])
    stale = SK.read_snapshot(table, AS_OF).agg(F.count("*").alias("n")).select(F.lit("old").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("accent"),
                                                                               F.col("n").alias("fetched_at_s"), F.lit(None).cast("boolean").alias("needs_refresh"))
    SK.write_snapshot(table, m.voices.filter("ordinal > 10").select("id", "name", "accent"), FETCHED[1])
    return SK.read_snapshot(table, AS_OF).unionByName(stale)


def book_chapter_rollup(spark, d):
    """Left join of books to chapters with a per-status count."""
    m = Model(spark, d)
    per = m.chapters.groupBy("book_id", "status").agg(F.count("*").alias("n"))
    return m.books.select(F.col("id").alias("book_id"), "title").join(per, "book_id", "left")


def scripted_chapter_segments(spark, d):
    """Inner join of segments and chapters, reduced to counts per book and kind."""
    m = Model(spark, d)
    return m.segments.join(m.chapters.select(F.col("id").alias("chapter_id"), "book_id"), "chapter_id").groupBy("book_id", "kind").agg(F.count("*").alias("n"))


def chapters_with_script(spark, d):
    m = Model(spark, d)
    return m.chapters.join(m.segments.select(F.col("chapter_id").alias("id")), "id", "left_semi").select("id", "status")


def evidenced_cues(spark, d):
    """Cues whose evidence occurs in their document."""
    m = Model(spark, d)
    cues = m.table("labels").select("doc_id", F.when(F.col("quality") == 1, "en ").otherwise("zq").alias("evidence"))
    return SC.evidenced(cues, m.table("documents"), ["doc_id"], "text").select("doc_id", "evidence")


def speaker_check(spark, d):
    m = Model(spark, d)
    pairs = m.segments.filter("character_id IS NOT NULL").select("chapter_id", "character_id").distinct()
    return E.check_speakers(pairs, m.chapters, m.characters)


def cast_complete(spark, d):
    """Per book: all voices assigned, any variants, any dialogue share."""
    m = Model(spark, d)
    has = m.assignments.select(F.col("character_id").alias("id"), F.lit(True).alias("a"))
    return m.characters.join(has, "id", "left").groupBy("book_id").agg(
        F.bool_and(F.col("a").isNotNull()).alias("all_assigned"), F.bool_or(F.col("variant_group").isNotNull()).alias("has_variants"),
        F.bool_or(F.col("dialogue_share") > 10000).alias("has_major"))


def distinct_live_chapters(spark, d):
    return Model(spark, d).jobs.filter(F.col("status").isin(S.LIVE) & F.col("chapter_id").isNotNull()).select("chapter_id").distinct()


def page_scan(spark, d):
    """Chapters of one book, projected."""
    return Model(spark, d).chapters.filter("book_id = 7").select("id", "idx", "title", "status", "audio_path", "error")


def _edit_commands(m):
    i = F.col("id")
    return m.segments.filter((i % 3 == 0)).select(
        F.when(i % 31 == 0, -i).otherwise(i).alias("segment_id"), F.when(i % 4 == 0, "delete").otherwise("patch").alias("op"),
        (i % 5 < 3).alias("set_speaker"), F.when(i % 5 < 2, i % 1600).alias("speaker"), (i % 7 < 3).alias("set_delivery"),
        F.when(i % 7 < 2, pick([*SM.DELIVERIES, "mumbled"], F.floor(i / 8))).alias("new_delivery"))


def segment_edits(spark, d):
    m = Model(spark, d)
    return E.edit_segments(m.segments, m.chapters, m.characters, _edit_commands(m))


def stale_after_edits(spark, d):
    m = Model(spark, d)
    return E.chapters_made_stale(E.edit_segments(m.segments, m.chapters, m.characters, _edit_commands(m)), m.chapters)


def chapter_narrator_edit(spark, d):
    m = Model(spark, d)
    cmds = m.chapters.select(F.col("id").alias("chapter_id"), F.when(F.col("id") % 3 != 0, F.col("id") % 1500).alias("narrator"))
    return E.set_chapter_narrator(m.segments, m.chapters, m.characters, cmds)


def _profile_patches(m):
    i = F.col("id")
    put = lambda k, v, n: F.when(i % n == 0, F.struct(F.lit(k).alias("k"), v.alias("v")))
    return m.characters.filter("id % 2 = 1").select(i.alias("character_id"), F.map_from_entries(F.filter(F.array(
        put("gender", pick(["male", "robot", "female"], i), 3), put("accent_hint", F.lit("Welsh"), 5), put("height", F.lit("tall"), 11)), lambda x: x.isNotNull())).alias("fields"))


def profile_patches(spark, d):
    m = Model(spark, d)
    return E.patch_profiles(m.characters, _profile_patches(m))


def book_patches(spark, d):
    m = Model(spark, d)
    i = F.col("c_custkey")
    cmds = m.table("customer").select((i % 25).alias("book_id"), i.alias("cmd"),
                                      F.when(i % 3 == 0, pick([" New ", "  ", "Title"], F.floor(i / 3))).alias("new_title"), F.when(i % 4 == 0, pick(["", " A. B. ", "C"], F.floor(i / 4))).alias("new_author"),
                                      F.when(i % 5 == 0, pick(["eleven_v3", "bad", ""], F.floor(i / 5))).alias("new_model"))
    out = E.patch_books(m.books, cmds.drop("cmd"))
    return out.groupBy("id", "reject_reason", "title", "author", "render_model").agg(F.count("*").alias("n"))


def job_progress(spark, d):
    return S.job_progress(job_events(Model(spark, d)))


def job_outcome(spark, d):
    return S.job_outcome(job_events(Model(spark, d)))


def silent_jobs(spark, d):
    return S.silent_gaps(job_events(Model(spark, d)), EVENTS_AS_OF, GAP_SEC)


def status_changes(spark, d):
    return S.status_changes(job_events(Model(spark, d)))


def latest_job_rows(spark, d):
    return S.latest_per_job(job_events(Model(spark, d)))


def duplicate_assignments(spark, d):
    """Characters cast twice, where every ninth has been given a second row."""
    a = Model(spark, d).assignments.select("character_id", "voice_id")
    return Q.duplicate_keys(a.unionByName(a.filter("character_id % 9 = 0")), ["character_id"])


def duplicate_labels(spark, d):
    return Q.duplicate_labels(Model(spark, d).characters)


def index_gaps(spark, d):
    """Chapters with broken numbering: a doubled position in one of five, a gap in another."""
    c, i = F.col("chapter_id"), F.col("idx")
    seeded = F.when((c % 5 == 1) & (i == 1), 0).when((c % 5 == 2) & (i >= 2), i + 1).when((c % 5 == 3) & (i % 3 == 1), i - 1).otherwise(i)
    return Q.index_gaps(Model(spark, d).segments.select("chapter_id", seeded.alias("idx")))


def orphan_speakers(spark, d):
    m = Model(spark, d)
    return Q.orphans(m.segments.select("chapter_id", "idx", "character_id"), "character_id", m.characters, "id")


def domain_violations(spark, d):
    return Q.domain_violations(Model(spark, d).segments).select("chapter_id", "idx", "kind", "delivery")


def setting_violations(spark, d):
    wild = Model(spark, d).assignments.withColumn("speed", F.col("speed") + (F.col("character_id") % 3) / 10.0)
    return Q.setting_violations(wild).select("character_id", F.round("speed", 4).alias("speed"))


def unclipped_segments(spark, d):
    m = Model(spark, d)
    return Q.unclipped_segments(m.segments, m.chapters).select("chapter_id", "idx")


def flagged_report(spark, d):
    return Q.flagged_segments(Model(spark, d).segments)


def dense_renumbering(spark, d):
    """Dense positions after a cue row was put behind every fourth line."""
    m = Model(spark, d)
    cues = m.segments.filter("id % 4 = 0").select("chapter_id", "idx", F.lit(1).alias("is_cue"))
    rows = m.segments.select("chapter_id", "idx", F.lit(0).alias("is_cue")).unionByName(cues)
    return O.dense_index(rows, ["chapter_id"], [F.col("idx"), F.col("is_cue")], "new_idx", O.rank_block(F.col("idx")))


def lost_jobs(spark, d):
    """Jobs of the update log that fell silent while they ran, and when they count as failed."""
    return S.lost_jobs(job_events(Model(spark, d)), EVENTS_AS_OF, GAP_SEC)


LOST_SQL = f"""SELECT job_id AS id, min(ts_s) + {GAP_SEC} AS failed_s FROM (SELECT *, min(seq) FILTER (WHERE status = 'cancelled' OR (status IN ('completed', 'failed') AND seq > s0)) OVER (PARTITION BY job_id) AS e0 FROM (
        SELECT *, min(seq) FILTER (WHERE status = 'running') OVER (PARTITION BY job_id) AS s0, coalesce(lead(ts_s) OVER (PARTITION BY job_id ORDER BY seq), {EVENTS_AS_OF}) - ts_s AS gap FROM ev))
        WHERE gap >= {GAP_SEC} AND seq >= s0 AND (e0 IS NULL OR seq < e0) GROUP BY 1"""
SAFE = lambda e, fb: f"coalesce(nullif(substring({trim_ws(f'''regexp_replace({e}, '[^0-9A-Za-z_{WS}-]', '', 'g')''')}, 1, 80), ''), {fb})"
LIVE = "status IN ('queued', 'running')"
EX = {
    "announced": ANNOUNCE_SQL, **OVERRIDES, **EVENTS_CTE,
    "recent": "SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY created_s DESC, id DESC) AS rank FROM jobs QUALIFY rank <= 25",
    "samples": "SELECT book_id, arg_min(id, (CAST(title = 'Front Matter' AS INT), idx)) AS id FROM chapters GROUP BY 1",
    "edit_cmds": f"""SELECT CASE WHEN id % 31 = 0 THEN -id ELSE id END AS segment_id, CASE WHEN id % 4 = 0 THEN 'delete' ELSE 'patch' END AS op, id % 5 < 3 AS set_speaker,
        CASE WHEN id % 5 < 2 THEN id % 1600 END AS speaker, id % 7 < 3 AS set_delivery, CASE WHEN id % 7 < 2 THEN {spick([*SM.DELIVERIES, "mumbled"], 'id // 8')} END AS new_delivery
        FROM segments WHERE id % 3 = 0""",
    "edits": f"""SELECT *, CASE WHEN op = 'patch' AND NOT set_speaker AND NOT set_delivery THEN 'nothing_to_update' WHEN op = 'patch' AND set_delivery AND new_delivery = 'mumbled' THEN 'bad_request'
          WHEN kind IS NULL THEN 'not_found' WHEN op = 'patch' AND kind = 'sfx' THEN 'sfx_immutable' WHEN op = 'delete' AND kind <> 'sfx' THEN 'not_sfx'
          WHEN op = 'patch' AND set_speaker AND speaker IS NOT NULL AND sbook IS DISTINCT FROM book_id THEN 'not_found'
          WHEN op = 'patch' AND set_delivery AND new_delivery IS NOT NULL AND kind <> 'dialogue' THEN 'bad_delivery' END AS reject_reason
        FROM (SELECT e.*, s.chapter_id, s.kind, s.character_id, s.delivery, s.flagged, s.audio_path, c.book_id, p.book_id AS sbook
              FROM edit_cmds e LEFT JOIN segments s ON s.id = e.segment_id LEFT JOIN chapters c ON c.id = s.chapter_id LEFT JOIN characters p ON p.id = e.speaker)""",
    "judged_edits": """SELECT *, reject_reason IS NULL AND op = 'patch' AS act, reject_reason IS NULL AND op = 'patch' AND set_speaker AND speaker IS NULL AS to_narr FROM edits""",
    "stale": f"""SELECT id FROM jobs WHERE status = 'running' AND updated_s < {RECONCILE_AT - S.STALE_AFTER_SEC}
        AND NOT coalesce(CAST(substring(run_id, 5) AS BIGINT) % 7 IN (1, 2, 3, 4), false)""",
    "dead": "SELECT * FROM jobs WHERE status = 'running' AND run_id IS NULL",
}
W = lambda sql: with_model(sql, EX)

QUERIES = {
    "library_summary": (library_summary, W("""SELECT b.id AS book_id, b.title, coalesce(k, 0) AS chapter_count, CAST(coalesce(s, 0) AS BIGINT) AS char_count, coalesce(p, 0) AS character_count FROM books b
        LEFT JOIN (SELECT book_id, count(*) AS k, sum(char_count) AS s FROM chapters GROUP BY 1) c ON c.book_id = b.id LEFT JOIN (SELECT book_id, count(*) AS p FROM characters GROUP BY 1) d ON d.book_id = b.id""")),
    "book_status_rollup": (book_status_rollup, W(f"""SELECT b.id AS book_id, b.status AS old_status, CASE WHEN b.id IN (SELECT book_id FROM jobs WHERE type = 'generate' AND {LIVE}) THEN 'generating'
        WHEN c.r IS NULL THEN b.status WHEN c.r THEN 'ready' WHEN c.z THEN 'generating' WHEN b.status = 'generating' THEN 'cast' ELSE b.status END AS status FROM books b
        LEFT JOIN (SELECT book_id, bool_and(status = 'ready') AS r, bool_or(status IN ('scripting', 'generating')) AS z FROM chapters GROUP BY 1) c ON c.book_id = b.id""")),
    "job_counts": (job_counts, W("SELECT type, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ["queued", "running", "completed", "failed", "cancelled"]) + f", count(*) FILTER (WHERE {LIVE}) AS active FROM jobs GROUP BY 1")),
    "chapter_narrator": (chapter_narrator, W("""SELECT c.id AS chapter_id, CASE WHEN count(DISTINCT coalesce(s.character_id, -1)) FILTER (WHERE s.chapter_id IS NOT NULL) = 1 THEN max(s.character_id) END AS narrator_id
        FROM chapters c JOIN announced a ON a.id = c.id LEFT JOIN segments s ON s.chapter_id = c.id AND s.kind = 'narration' AND NOT (s.idx = 0 AND coalesce(s.text = a.announcement, false)) GROUP BY 1""")),
    "stale_chapters": (stale_chapters, W("""SELECT DISTINCT c.id AS chapter_id FROM chapters c JOIN segments s ON s.chapter_id = c.id JOIN (SELECT k.book_id, k.id, k.is_narrator
          FROM cmds m JOIN characters k ON k.id = m.character_id LEFT JOIN assignments a ON a.character_id = m.character_id LEFT JOIN voices v ON v.id = m.new_voice_id
          WHERE NOT (new_voice_id IS NULL AND new_speed IS NULL) AND coalesce(new_voice_id, a.voice_id) IS NOT NULL AND NOT (new_voice_id IS NOT NULL AND v.id IS NULL)) t
        ON t.book_id = c.book_id AND ((t.is_narrator AND s.character_id IS NULL) OR (NOT t.is_narrator AND s.character_id = t.id)) WHERE c.status = 'ready'""")),
    "sample_chapter": (sample_chapter, W("SELECT book_id, id AS chapter_id FROM samples")),
    "setup_stage": (setup_stage, W("""SELECT b.id AS book_id, CASE WHEN count(c.id) = 0 THEN 'analyze' WHEN count(c.id) = count(a.character_id) THEN 'voice_review' ELSE 'cast_review' END AS stage,
        count(c.id) - count(a.character_id) AS missing_voices FROM books b LEFT JOIN characters c ON c.book_id = b.id LEFT JOIN assignments a ON a.character_id = c.id GROUP BY 1""")),
    "stage_health": (stage_health, W(f"""SELECT book_id, pipeline_stage, failed, orphaned, CASE WHEN failed THEN coalesce(own, (SELECT arg_max(error, (created_s, id)) FROM jobs r WHERE r.book_id = z.book_id AND r.status = 'failed'), 'The step failed.') END AS message FROM (
        SELECT *, bf OR sf OR orphaned AS failed, CASE WHEN bf THEN berr WHEN sf THEN serr END AS own FROM (
        SELECT *, jt IS NOT NULL AND NOT alive AND NOT bf AND NOT sf AS orphaned FROM (
        SELECT b.id AS book_id, pipeline_stage, b.error AS berr, c.error AS serr, jt, pipeline_stage IN ('analyzing', 'casting') AND b.status = 'error' AS bf,
          coalesce(pipeline_stage IN ('scripting_sample', 'generating_sample') AND c.status = 'error', false) AS sf,
          EXISTS (SELECT 1 FROM jobs r WHERE r.book_id = b.id AND r.type = jt AND {LIVE} AND (jt NOT IN ('script', 'generate') OR r.chapter_id = s.id)) AS alive
        FROM (SELECT *, CASE pipeline_stage WHEN 'analyzing' THEN 'analyze' WHEN 'casting' THEN 'cast' WHEN 'scripting_sample' THEN 'script' WHEN 'generating_sample' THEN 'generate' END AS jt FROM books) b
        LEFT JOIN samples s ON s.book_id = b.id LEFT JOIN chapters c ON c.id = s.id))) z""")),
    "chapter_flags": (chapter_flags, W(f"""SELECT c.id AS chapter_id, j.id AS job_id, c.status IN ('scripting', 'generating') OR j.id IS NOT NULL AS busy, c.status NOT IN ('pending', 'scripting') AS has_script
        FROM chapters c LEFT JOIN (SELECT chapter_id, arg_min(id, (created_s, id)) AS id FROM jobs WHERE {LIVE} AND chapter_id IS NOT NULL GROUP BY 1) j ON j.chapter_id = c.id""")),
    "chapters_to_enqueue": (chapters_to_enqueue, W(f"""SELECT book_id, id AS chapter_id, id NOT IN (SELECT chapter_id FROM segments) OR status = 'pending' AS script_first FROM chapters
        WHERE status <> 'ready' AND id NOT IN (SELECT chapter_id FROM jobs WHERE type = 'generate' AND {LIVE} AND chapter_id IS NOT NULL)""")),
    "admission_snapshot": (admission_snapshot, W("""SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY created_s, id) AS rank FROM jobs WHERE status = 'queued'
        QUALIFY rank <= CASE type WHEN 'generate' THEN 2 WHEN 'script' THEN 3 ELSE 0 END""")),
    "recent_jobs": (recent_jobs, W("SELECT book_id, id, rank FROM recent")),
    "job_timing": (job_timing, W(f"""SELECT id, e AS elapsed_sec, round(CASE WHEN status = 'running' AND total > 0 THEN done / total * 100 END, 6) AS percent,
        round(CASE WHEN total > 0 AND done > 0 AND done < total AND e > 2 THEN e / done * (total - done) END, 3) AS eta_sec FROM (SELECT *, CAST(greatest(0, {AS_OF} - created_s) AS DOUBLE) AS e FROM jobs)""")),
    "rollback_chapters": (rollback_chapters, W("""SELECT id AS chapter_id, CASE WHEN status IN ('scripting', 'generating') AND id IN (SELECT chapter_id FROM dead WHERE chapter_id IS NOT NULL)
        THEN CASE WHEN id IN (SELECT chapter_id FROM segments) THEN 'scripted' ELSE 'pending' END ELSE status END AS status FROM chapters""")),
    "rollback_books": (rollback_books, W("""SELECT id AS book_id, CASE WHEN status IN ('analyzing', 'casting', 'generating') AND id IN (SELECT book_id FROM jobs WHERE status = 'running')
        THEN CASE WHEN status = 'generating' THEN 'cast' WHEN id IN (SELECT book_id FROM characters) THEN 'analyzed' ELSE 'parsed' END ELSE status END AS status FROM books""")),
    "reconcile_stale_jobs": (reconcile_stale_jobs, W(f"""SELECT 'job' AS kind, id, CASE WHEN id IN (FROM stale) THEN 'failed' ELSE status END AS status, CASE WHEN id NOT IN (FROM stale) THEN note END AS note,
          CASE WHEN id IN (FROM stale) THEN '{S.INTERRUPTED}' ELSE error END AS error FROM jobs
        UNION ALL SELECT 'chapter', id, CASE WHEN status IN ('scripting', 'generating') AND id IN (SELECT chapter_id FROM jobs WHERE id IN (FROM stale) AND chapter_id IS NOT NULL)
          THEN CASE WHEN id IN (SELECT chapter_id FROM segments) THEN 'scripted' ELSE 'pending' END ELSE status END, NULL, NULL FROM chapters
        UNION ALL SELECT 'book', id, CASE WHEN status IN ('analyzing', 'casting', 'generating') AND id IN (SELECT book_id FROM jobs WHERE id IN (FROM stale))
            AND id NOT IN (SELECT book_id FROM jobs WHERE status = 'running' AND id NOT IN (FROM stale))
          THEN CASE WHEN status = 'generating' THEN 'cast' WHEN id IN (SELECT book_id FROM characters) THEN 'analyzed' ELSE 'parsed' END ELSE status END, NULL, NULL FROM books""")),
    "guarded_stage_update": (guarded_stage_update, W("""SELECT type, CASE WHEN c THEN 'completed' ELSE status END AS status, count(*) FILTER (WHERE c) AS changed, count(*) AS n
        FROM (SELECT *, status = 'running' AND id % 2 = 0 AS c FROM jobs) GROUP BY 1, 2""")),
    "cancel_book_jobs": (cancel_book_jobs, W(f"SELECT id, book_id, status, CASE WHEN status = 'running' THEN run_id END AS run_to_stop FROM jobs WHERE book_id % 2 = 0 AND {LIVE}")),
    "cascade_delete": (cascade_delete, W("""SELECT 'chapters' AS table_name, count(*) AS n FROM chapters WHERE book_id % 3 <> 0
        UNION ALL SELECT 'segments', count(*) FROM segments WHERE chapter_id NOT IN (SELECT id FROM chapters WHERE book_id % 3 = 0)
        UNION ALL SELECT 'characters', count(*) FROM characters WHERE book_id % 3 <> 0
        UNION ALL SELECT 'assignments', count(*) FROM assignments WHERE character_id NOT IN (SELECT id FROM characters WHERE book_id % 3 = 0)""")),
    "speakers_set_null": (speakers_set_null, W("""SELECT chapter_id, idx, CASE WHEN c.id IS NOT NULL THEN character_id END AS character_id, flagged OR (character_id IS NOT NULL AND c.id IS NULL) AS flagged
        FROM segments s LEFT JOIN (SELECT id FROM characters WHERE id % 2 = 0) c ON c.id = s.character_id""")),
    "live_overlay": (live_overlay, W("""SELECT c.id, CASE WHEN j.id IS NOT NULL THEN CASE WHEN j.status <> 'queued' THEN 'live ' || j.status END ELSE c.status END AS status, CASE WHEN j.id IS NOT NULL THEN j.error ELSE c.error END AS error
        FROM chapters c LEFT JOIN jobs j ON j.id = c.id AND j.chapter_id = j.id""")),
    "upsert_clips": (upsert_clips, W("""SELECT character_id, voice_id, voice_name FROM assignments WHERE character_id NOT IN (SELECT id + 7 FROM characters WHERE id % 4 = 0)
        UNION ALL SELECT id + 7, 'v1-1', NULL FROM characters WHERE id % 4 = 0""")),
    "nested_book_pages": (nested_book_pages, W("""SELECT b.id AS book_id, coalesce(c.page, 0) AS page, c.n_chapters, c.chapters_hash, c.n_characters, c.characters_hash, j.jobs_hash FROM books b
        LEFT JOIN (SELECT * FROM (SELECT book_id, p // 1000 AS page, count(*) AS n_chapters, md5(string_agg(idx || '~' || id || '~' || title || '~' || status || '~' || CASE WHEN audio_path IS NOT NULL THEN 'true' ELSE 'false' END, '|' ORDER BY idx)) AS chapters_hash
           FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY idx) - 1 AS p FROM chapters) GROUP BY 1, 2)
           FULL JOIN (SELECT book_id, p // 1000 AS page, count(*) AS n_characters, md5(string_agg(concat_ws('~', id, name, role, voice_id, voice_name), '|' ORDER BY id)) AS characters_hash
           FROM (SELECT c.*, a.voice_id, a.voice_name, row_number() OVER (PARTITION BY c.book_id ORDER BY c.id) - 1 AS p FROM characters c LEFT JOIN assignments a ON a.character_id = c.id) GROUP BY 1, 2) USING (book_id, page)) c ON c.book_id = b.id
        LEFT JOIN (SELECT book_id, 0 AS page, md5(string_agg(id || '~' || type || '~' || status, '|' ORDER BY rank)) AS jobs_hash FROM recent GROUP BY 1) j ON j.book_id = b.id AND j.page = coalesce(c.page, 0)""")),
    "export_manifest": (export_manifest, W(f"""SELECT book_id, id AS chapter_id, idx, audio_path, CASE WHEN idx + 1 < 10 THEN '0' ELSE '' END || (idx + 1) || ' - ' || {SAFE('title', "'Chapter ' || (idx + 1)")} || '.mp3' AS file_name
        FROM chapters WHERE audio_path IS NOT NULL AND status IN ('ready', 'stale')""")),
    "output_paths": (output_paths, W("""SELECT id, 'chapters/' || book_id || '/chapter-' || CASE WHEN idx < 10 THEN '00' WHEN idx < 100 THEN '0' ELSE '' END || idx || '-' || h || '.mp3' AS chapter_path,
        'segments/' || book_id || '/' || h || '.mp3' AS segment_path, 'previews/' || h || '.mp3' AS preview_path, 'intro/' || book_id || '/' || h || '.mp3' AS intro_path FROM (SELECT *, left(sha256(title), 12) AS h FROM chapters)""")),
    "valid_audio_paths": (valid_audio_paths, f"""SELECT page_id, regexp_matches(p, '^(segments/|chapters/|previews/|intro/)') AND p LIKE '%.mp3' AND NOT list_has_any(string_split(p, '/'), ['', '.', '..']) AS ok
        FROM (SELECT page_id, replace({spick(["segments/", "chapters", "other/", "intro/./", "previews/"], 'page_id')} || url || {spick([".mp3", "/", ".mp3"], 'page_id')}, '://', '/') AS p FROM pages)"""),
    "snapshot_freshness": (snapshot_freshness, W(f"SELECT id, {AS_OF} - updated_s < 86400 AS usable, {AS_OF} - updated_s > 3600 AS needs_refresh FROM jobs")),
    "replaced_scripts": (replaced_scripts, W("""SELECT book_id, chapter_id, count(*) AS n, min(s.idx) AS first_idx, max(text) AS last_text FROM segments s JOIN chapters c ON c.id = s.chapter_id
        WHERE chapter_id % 4 <> 1 OR (chapter_id % 8 = 1 AND kind <> 'sfx') GROUP BY 1, 2""")),
    "rescripted_chapters": (rescripted_chapters, W("""SELECT id, CASE WHEN id % 4 = 1 THEN 'scripted' ELSE status END AS status, CASE WHEN id % 4 <> 1 THEN audio_path END AS audio_path,
        CASE WHEN id % 4 <> 1 THEN duration_sec END AS duration_sec, CASE WHEN id % 4 <> 1 THEN error END AS error FROM timed_chapters""")),
    "voice_snapshot": (voice_snapshot, W(f"SELECT id, name, accent, {FETCHED[1]} AS fetched_at_s, true AS needs_refresh FROM voices WHERE ordinal > 10 UNION ALL SELECT 'old', NULL, NULL, 0, NULL")),
    "book_chapter_rollup": (book_chapter_rollup, W("SELECT b.id AS book_id, b.title, c.status, CASE WHEN count(c.id) > 0 THEN count(c.id) END AS n FROM books b LEFT JOIN chapters c ON c.book_id = b.id GROUP BY 1, 2, 3")),
    "scripted_chapter_segments": (scripted_chapter_segments, W("SELECT book_id, kind, count(*) AS n FROM segments s JOIN chapters c ON c.id = s.chapter_id GROUP BY 1, 2")),
    "chapters_with_script": (chapters_with_script, W("SELECT id, status FROM chapters WHERE id IN (SELECT chapter_id FROM segments)")),
    "evidenced_cues": (evidenced_cues, "SELECT l.doc_id, CASE WHEN quality = 1 THEN 'en ' ELSE 'zq' END AS evidence FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE contains(text, trim(CASE WHEN quality = 1 THEN 'en ' ELSE 'zq' END))"),
    "speaker_check": (speaker_check, W("""SELECT s.chapter_id, s.character_id, CASE WHEN p.id IS NULL THEN 'no_such_character' WHEN p.book_id IS DISTINCT FROM c.book_id THEN 'other_book' END AS reject_reason
        FROM (SELECT DISTINCT chapter_id, character_id FROM segments WHERE character_id IS NOT NULL) s LEFT JOIN chapters c ON c.id = s.chapter_id LEFT JOIN characters p ON p.id = s.character_id""")),
    "cast_complete": (cast_complete, W("SELECT book_id, bool_and(a.character_id IS NOT NULL) AS all_assigned, bool_or(variant_group IS NOT NULL) AS has_variants, bool_or(dialogue_share > 10000) AS has_major FROM characters c LEFT JOIN assignments a ON a.character_id = c.id GROUP BY 1")),
    "distinct_live_chapters": (distinct_live_chapters, W(f"SELECT DISTINCT chapter_id FROM jobs WHERE {LIVE} AND chapter_id IS NOT NULL")),
    "page_scan": (page_scan, W("SELECT id, idx, title, status, audio_path, error FROM chapters WHERE book_id = 7")),
    "segment_edits": (segment_edits, W("""SELECT segment_id, chapter_id, op, reject_reason, CASE WHEN act AND set_speaker THEN speaker ELSE character_id END AS character_id, CASE WHEN to_narr THEN 'narration' ELSE kind END AS kind,
        CASE WHEN act AND set_speaker THEN false ELSE flagged END AS flagged, CASE WHEN act AND set_delivery THEN new_delivery WHEN NOT to_narr THEN delivery END AS delivery, CASE WHEN NOT act THEN audio_path END AS audio_path FROM judged_edits""")),
    "stale_after_edits": (stale_after_edits, W("SELECT id AS chapter_id FROM chapters WHERE status = 'ready' AND id IN (SELECT chapter_id FROM edits WHERE reject_reason IS NULL)")),
    "chapter_narrator_edit": (chapter_narrator_edit, W("""SELECT chapter_id, idx, r AS reject_reason, CASE WHEN r IS NULL THEN narrator ELSE character_id END AS character_id, CASE WHEN r IS NOT NULL THEN audio_path END AS audio_path FROM (
        SELECT s.*, c.narrator, CASE WHEN c.narrator IS NOT NULL AND p.book_id IS DISTINCT FROM c.book_id THEN 'not_found' WHEN p.is_narrator THEN 'bad_request' END AS r
        FROM segments s JOIN (SELECT *, CASE WHEN id % 3 <> 0 THEN id % 1500 END AS narrator FROM chapters) c ON c.id = s.chapter_id JOIN announced a ON a.id = c.id LEFT JOIN characters p ON p.id = c.narrator
        WHERE s.kind = 'narration' AND NOT (s.idx = 0 AND coalesce(s.text = a.announcement, false)))""")),
    "profile_patches": (profile_patches, W(f"""SELECT id, r AS reject_reason, CASE WHEN r IS NULL THEN coalesce(g, gender) ELSE gender END AS gender, age_range, CASE WHEN r IS NULL AND id % 5 = 0 THEN 'Welsh' ELSE accent_hint END AS accent_hint, heritage, profile_edited OR r IS NULL AS profile_edited
        FROM (SELECT *, CASE WHEN id % 3 <> 0 AND id % 5 <> 0 AND id % 11 <> 0 THEN 'no_fields' WHEN id % 11 = 0 THEN 'unknown_field' WHEN g = 'robot' THEN 'bad_gender' END AS r
          FROM (SELECT *, CASE WHEN id % 3 = 0 THEN {spick(["male", "robot", "female"], 'id')} END AS g FROM characters WHERE id % 2 = 1))""")),
    "book_patches": (book_patches, W(f"""SELECT id, r AS reject_reason, CASE WHEN r IS NULL AND t IS NOT NULL THEN trim(t) ELSE title END AS title, CASE WHEN r IS NULL AND a IS NOT NULL THEN nullif(trim(a), '') ELSE author END AS author,
          CASE WHEN r IS NULL AND coalesce(mo, '') <> '' THEN mo ELSE render_model END AS render_model, count(*) AS n
        FROM (SELECT b.*, t, a, mo, CASE WHEN mo = 'bad' THEN 'bad_model' WHEN trim(t) = '' THEN 'bad_title' END AS r FROM books b JOIN (SELECT c_custkey % 25 AS book_id,
            CASE WHEN c_custkey % 3 = 0 THEN {spick([" New ", "  ", "Title"], 'c_custkey // 3')} END AS t, CASE WHEN c_custkey % 4 = 0 THEN {spick(["", " A. B. ", "C"], 'c_custkey // 4')} END AS a,
            CASE WHEN c_custkey % 5 = 0 THEN {spick(["eleven_v3", "bad", ""], 'c_custkey // 5')} END AS mo FROM customer) k ON k.book_id = b.id) GROUP BY 1, 2, 3, 4, 5""")),
    "job_progress": (job_progress, W("SELECT job_id, max(done) AS done, max(chars_used) AS chars_used, arg_max(note, seq) AS note FROM ev GROUP BY 1")),
    "job_outcome": (job_outcome, W("""SELECT job_id, coalesce(arg_min(status, seq) FILTER (WHERE status IN ('completed', 'failed') AND seq > s0 OR status = 'cancelled'), CASE WHEN s0 IS NOT NULL THEN 'running' ELSE 'queued' END) AS status,
        min(seq) FILTER (WHERE status IN ('completed', 'failed') AND seq > s0 OR status = 'cancelled') AS end_seq FROM (SELECT *, min(seq) FILTER (WHERE status = 'running') OVER (PARTITION BY job_id) AS s0 FROM ev) GROUP BY job_id, s0""")),
    "silent_jobs": (silent_jobs, W(f"""SELECT job_id, seq, gap_sec FROM (SELECT *, coalesce(lead(ts_s) OVER (PARTITION BY job_id ORDER BY seq), {EVENTS_AS_OF}) - ts_s AS gap_sec FROM ev) WHERE status = 'running' AND gap_sec >= {GAP_SEC}""")),
    "status_changes": (status_changes, W("SELECT job_id, seq, p AS from_status, status FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS p FROM ev) WHERE p IS NULL OR p <> status")),
    "lost_jobs": (lost_jobs, W(LOST_SQL)),
    "latest_job_rows": (latest_job_rows, W("SELECT job_id, seq, status, done FROM ev QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1")),
    "duplicate_assignments": (duplicate_assignments, W("""SELECT character_id, 2 * count(*) AS n FROM assignments WHERE character_id % 9 = 0 GROUP BY 1""")),
    "duplicate_labels": (duplicate_labels, W("""SELECT DISTINCT book_id, variant_group, variant_label, count(*) OVER w AS n FROM characters
        WHERE variant_group IS NOT NULL AND variant_label IS NOT NULL WINDOW w AS (PARTITION BY book_id, variant_group, variant_label) QUALIFY count(*) OVER w > 1""")),
    "index_gaps": (index_gaps, W("""SELECT chapter_id, count(*) AS n, min(idx) AS lo, max(idx) AS hi FROM (
        SELECT chapter_id, idx, idx - lag(idx) OVER (PARTITION BY chapter_id ORDER BY idx) AS step FROM (
          SELECT chapter_id, CASE WHEN chapter_id % 5 = 1 AND idx = 1 THEN 0 WHEN chapter_id % 5 = 2 AND idx >= 2 THEN idx + 1
            WHEN chapter_id % 5 = 3 AND idx % 3 = 1 THEN idx - 1 ELSE idx END AS idx FROM segments)) GROUP BY 1
        HAVING min(idx) <> 0 OR bool_or(step <> 1)""")),
    "orphan_speakers": (orphan_speakers, W("SELECT chapter_id, idx, character_id FROM segments WHERE character_id IS NOT NULL AND character_id NOT IN (SELECT id FROM characters)")),
    "domain_violations": (domain_violations, W("SELECT chapter_id, idx, kind, delivery FROM segments WHERE delivery = 'mumbled'")),
    "setting_violations": (setting_violations, W("SELECT character_id, round((speed + (character_id % 3) / 10.0)::DOUBLE, 4) AS speed FROM assignments WHERE speed::DOUBLE + ((character_id % 3) / 10.0)::DOUBLE > 1.2")),
    "unclipped_segments": (unclipped_segments, W("SELECT chapter_id, idx FROM segments WHERE (audio_path IS NULL OR duration_sec IS NULL) AND chapter_id IN (SELECT id FROM chapters WHERE status IN ('ready', 'stale'))")),
    "flagged_report": (flagged_report, W("SELECT chapter_id, kind, count(*) AS n FROM segments WHERE flagged GROUP BY 1, 2")),
    "dense_renumbering": (dense_renumbering, W("""SELECT chapter_id, idx, is_cue, row_number() OVER (PARTITION BY chapter_id ORDER BY idx, is_cue) - 1 AS new_idx
        FROM (SELECT chapter_id, idx, 0 AS is_cue FROM segments UNION ALL SELECT chapter_id, idx, 1 FROM segments WHERE id % 4 = 0)""")),
}
