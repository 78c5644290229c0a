"""Queries over quotes, scripts, the reading view and render cost, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscript.functions import domains as D
from folioscript.operators import cast as CA
from folioscript.operators import cost as C
from folioscript.operators import quality as QA
from folioscript.operators import quotes as QT
from folioscript.operators import reader as R
from folioscript.operators import script as SC
from folioscript.operators import timeline as T
from folioscript.operators import voices as V
from folioscript.plans.cast_queries import DICT
from folioscript.plans.text_queries import _W, PARAS, pack_sql, _worth
from folioscript.operators.pack import NARRATION
from folioscript.plans.timeline_queries import HARD, PHRASE_CTES, SOFT
from folioscript.session import cut_lineage
from folioscript.sources import samples as S
from folioscript.sources.derived import LINE_SEGMENTS_SQL, line_segments
from folioscript.sources.model import Model, pick
from folioscript.sources.sql_model import WS, key, trim_ws, with_model
from folioscript.sources.sql_model import pick as spick

# ---- Spark side -------------------------------------------------------------


def spanned(m: Model):
    """Chapters with their spans, written once because several steps read them."""
    if "spanned" not in m.shared:
        m.shared["spanned"] = cut_lineage(SC.prepared_chapters(m.quoted_chapters), "spans")
    return m.shared["spanned"]


def _spans(m: Model):
    return QT.span_rows(spanned(m), ["chapter_id", "book_id"])


def attributions(spans):
    """Speaker answers for the quotes of a corpus: some missing, doubled or out of range."""
    c, q = F.col("chapter_id"), F.col("q")
    base = spans.filter("kind = 'quote' AND (chapter_id + q) % 11 <> 5").select(
        "chapter_id", F.when((c + q) % 17 == 3, -1 - q).otherwise(q).alias("quote_id"), (c + q).alias("h"),
        F.explode_outer(F.sequence(F.lit(0), F.when((c + q) % 13 == 0, 1).otherwise(0))).alias("ord"))
    h = F.floor((F.col("h") + F.col("ord")) / 3)
    who = F.concat(pick(["Hero ", "hero ", "ALIAS ", "narrator", "Stranger "], h), F.when(h % 5 == 3, "").otherwise((h % 30).cast("string")))
    return base.select("chapter_id", "quote_id", "ord", who.alias("speaker"), (F.col("h") % 7 != 0).alias("is_dialogue"),
                       pick(["high", "medium", "low", "high"], F.col("h") + F.col("ord")).alias("confidence"))


def _pov(m: Model):
    return m.table("documents").filter("doc_id % 6 = 0").select(F.col("doc_id").alias("chapter_id"), (F.col("doc_id") % 1500).alias("pov_character_id"))


def scripted(m: Model):
    ch = spanned(m)
    answers = SC.resolved_attributions(ch, attributions(_spans(m)), CA.name_dictionary(m.characters))
    return SC.with_script(ch, answers, _pov(m))


def assembled(m: Model):
    return SC.script_rows(scripted(m))


def _notes(script):
    c, i = F.col("chapter_id"), F.col("idx")
    return script.filter((c + i) % 3 == 0).select(
        "chapter_id", F.when((c + i) % 10 == 9, i + 9999).otherwise(i).alias("line"),
        F.explode_outer(F.array(F.struct(F.lit(0).alias("ord"), pick([*S.DELIVERIES, "mumbled"], c + i).alias("delivery")),
                                F.struct(F.lit(1).alias("ord"), F.lit("sad").alias("delivery")))).alias("n")).select("chapter_id", "line", "n.*")


def _cues(script):
    c, i = F.col("chapter_id"), F.col("idx")
    return script.filter((c + i) % 4 == 1).select(
        "chapter_id", i.alias("after_line"), i.alias("ord"),
        F.when((c + i) % 3 == 0, " zzqq ").otherwise(F.substring("text", 1, 6)).alias("evidence"),
        pick([" a door ", "  ", "glass"], F.floor((c + i) / 4)).alias("prompt"), ((c + i) % 80 / 10.0 - 0.04).alias("seconds"))


def quote_styles(spark, d):
    return Model(spark, d).quoted_chapters.select("chapter_id", QT.quote_style(F.col("text")).alias("style"))


def quote_spans(spark, d):
    ch = SC.prepared_chapters(Model(spark, d).quoted_chapters)
    return QT.span_rows(ch, ["chapter_id"]).select("chapter_id", "span_idx", "kind", "start", "end", F.md5("text").alias("text_hash"), "flagged", "q")


def span_tiling_breaks(spark, d):
    """Per quote style: chapters, and chapters whose spans do not tile their text, three in seven being damaged."""
    ch = spanned(Model(spark, d)).select("chapter_id", "style", "clean_text", "spans")
    first = lambda change: F.transform("spans", lambda s, i: F.when(i == 0, change(s)).otherwise(s))
    kind = F.col("chapter_id") % 7
    damaged = (F.when(kind == 1, first(lambda s: s.withField("text", F.repeat(F.lit("\u0000"), F.length(s["text"])))))
               .when(kind == 2, first(lambda s: s.withField("end", s["end"] + 1)))
               .when(kind == 3, F.slice("spans", 2, F.greatest(F.size("spans") - 1, F.lit(0)))).otherwise(F.col("spans")))
    seeded = ch.withColumn("spans", damaged)
    broken = QA.broken_spans(seeded, "clean_text").groupBy("style").agg(F.count("*").alias("broken"))
    return ch.groupBy("style").agg(F.count("*").alias("chapters")).join(broken, "style", "left").select(
        "style", "chapters", F.coalesce("broken", F.lit(0)).cast("long").alias("broken"))


def attribution_chunks(spark, d):
    return QT.attribution_chunks(SC.prepared_chapters(Model(spark, d).quoted_chapters), ["chapter_id"])


def marked_passages(spark, d):
    return QT.passages(SC.prepared_chapters(Model(spark, d).quoted_chapters), ["chapter_id"], "clean_text").select("chapter_id", "chunk", F.md5("passage").alias("passage_hash"), F.length("passage").cast("long").alias("n"))


def rolling_context(spark, d):
    m = Model(spark, d)
    ch = spanned(m)
    return SC.recent_attributions(QT.attribution_chunks(ch, ["chapter_id"]), attributions(QT.span_rows(ch, ["chapter_id"])))


def assembled_script(spark, d):
    return assembled(Model(spark, d)).select("chapter_id", "idx", "character_id", "kind", F.md5("text").alias("text_hash"), F.length("text").cast("long").alias("n"), "flagged")


def _written_script(m: Model):
    return cut_lineage(assembled(m), "script")


def delivery_notes(spark, d):
    script = _written_script(Model(spark, d))
    return SC.valid_delivery_notes(script, _notes(script))


def sound_cues(spark, d):
    m = Model(spark, d)
    script = _written_script(m)
    return SC.valid_cues(script, spanned(m), m.books, _cues(script)).withColumn("seconds", F.round("seconds", 4))


def final_script(spark, d):
    m = Model(spark, d)
    script = _written_script(m)
    out = SC.final_script(script, SC.valid_delivery_notes(script, _notes(script)), SC.valid_cues(script, spanned(m), m.books, _cues(script)))
    return out.select("chapter_id", "idx", "kind", "character_id", "delivery", "text_hash", F.round("sfx_duration_sec", 4).alias("sfx_duration_sec"))


def script_lines(spark, d):
    m = Model(spark, d)
    return SC.script_lines(assembled(m), m.characters).select("chapter_id", "idx", F.md5("line").alias("line_hash"))


def script_chunks(spark, d):
    m = Model(spark, d)
    return SC.script_chunks(SC.script_lines(assembled(m), m.characters))


def segment_boundaries(spark, d):
    m = Model(spark, d)
    return R.boundary_rows(R.bounded_script(scripted(m))).select("chapter_id", "idx", "para_break_before", "space_before", "is_title")


def reader_blocks(spark, d):
    m = Model(spark, d)
    return R.page_blocks(R.bounded_script(scripted(m))).select("chapter_id", "block_idx", "kind", F.md5("text").alias("text_hash"), F.length("text").cast("long").alias("n"))


def _plan(m: Model):
    lines = m.segments.join(m.chapters.select(F.col("id").alias("chapter_id"), "book_id"), "chapter_id").join(
        m.books.select(F.col("id").alias("book_id"), "render_model"), "book_id")
    return C.with_cache_key(C.render_plan(V.resolve_segment_voices(lines, m.characters, m.assignments)))


def _probed(m: Model):
    narrow = ["chapter_id", "idx", "kind", "cache_key", "render_model", "sfx_duration_sec", "rendered_chars", "voice"]
    plan = cut_lineage(_plan(m).select(*narrow), "plan")
    clips = plan.select("cache_key").distinct().filter(F.substring("cache_key", 1, 1) < "6")
    return C.probe_cache(plan, clips)


def render_plan(spark, d):
    r = lambda c: F.round(c, 4).alias(c)
    return _plan(Model(spark, d)).select("chapter_id", "idx", F.md5("rendered_text").alias("text_hash"), r("r_stability"), r("r_style"), r("r_speed"))


def cache_keys(spark, d):
    return _plan(Model(spark, d)).select("chapter_id", "idx", "cache_key", F.sha2("text", 256).alias("text_hash"))


def cache_probe(spark, d):
    return _probed(Model(spark, d)).select("chapter_id", "idx", "is_cached")


def fresh_cost(spark, d):
    return C.fresh_cost(_probed(Model(spark, d)))


def stitch_chains(spark, d):
    return C.stitch_chains(cut_lineage(_probed(Model(spark, d)).drop("cache_key"), "probed")).select("chapter_id", "idx", "chain", F.array_join("follows", ",").alias("follows"))


def render_batches(spark, d):
    return C.batches(Model(spark, d).segments, 4).groupBy("chapter_id", "batch").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


def render_waves(spark, d):
    """Batches of 25 lines and waves of three batches, over every document line."""
    rows = C.batches(line_segments(Model(spark, d)), 25).groupBy("chapter_id", "batch").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
    return rows.withColumn("wave", F.floor(F.col("batch") / 3).cast("long"))


def preview_and_intro_keys(spark, d):
    m = Model(spark, d)
    s = [F.col(c) for c in C.SETTINGS]
    return m.assignments.select(
        "character_id", C.preview_key(F.col("voice_id"), F.repeat("rationale", 40), s).alias("preview_key"),
        C.intro_key(F.col("voice_name"), F.col("rationale"), F.col("voice_id"), s, F.lit("eleven_v3")).alias("intro_key"))


def clip_durations(spark, d):
    """Clip seconds from a byte count."""
    return Model(spark, d).table("lineitem").groupBy("l_orderkey").agg(
        F.sum(F.floor("l_extendedprice")).cast("long").alias("n_bytes")).select(
        "l_orderkey", "n_bytes", D.bytes_to_seconds(F.col("n_bytes")).alias("duration_sec"))


# ---- SQL side ---------------------------------------------------------------
_OPEN = lambda e, p: f"({e} IN ('‘', '''') AND ({p} IS NULL OR regexp_matches({p}, '[{WS}(\\[{{—–\\-\"“]')))"
_IS_OPEN = f"CASE style WHEN 'curly' THEN ch = '“' WHEN 'straight' THEN ch = '\"' ELSE {_OPEN('ch', 'prev')} END"
_IS_CLOSE = f"""CASE style WHEN 'curly' THEN ch = '”' WHEN 'straight' THEN ch = '"' ELSE ch IN ('’', '''')
   AND NOT (regexp_matches(coalesce(prev, ''), '[A-Za-z]') AND regexp_matches(coalesce(nxt, ''), '[A-Za-z]')) AND (nxt IS NULL OR regexp_matches(nxt, '[{WS}.,;:!?)\\]}}—–\\-"”]')) END"""
_FORM = lambda e: f"trim(regexp_replace(lower({e}), '[^a-z0-9]+', ' ', 'g'))"
_CLEAN = f"""{trim_ws(f"CASE WHEN {_FORM('f')} <> '' AND length(f) <= 60 AND ends_with({_FORM('title')}, {_FORM('f')}) THEN regexp_replace(text, '^[{WS}]*[^\\n]*(?:\\n|$)', '') ELSE text END")}"""

SPAN_CTES = {
    "clean": f"""SELECT chapter_id, book_id, title, {_CLEAN} AS text FROM (SELECT *, {trim_ws(f"regexp_extract(text, '^[{WS}]*([^\\n]*)', 1)")} AS f FROM quoted)""",
    "allch": """SELECT chapter_id, i - 1 AS i, ch, lag(ch) OVER w AS prev, lead(ch) OVER w AS nxt FROM (
        SELECT chapter_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM clean) WINDOW w AS (PARTITION BY chapter_id ORDER BY i)""",
    "styles": f"""SELECT chapter_id, CASE WHEN count(*) FILTER (WHERE ch = '“') >= 2 THEN 'curly' WHEN count(*) FILTER (WHERE ch = '"') >= 2 THEN 'straight'
          WHEN count(*) FILTER (WHERE ch IN ('“', '"')) = 0 AND count(*) FILTER (WHERE {_OPEN('ch', 'prev')}) >= 4 THEN 'single' ELSE 'none' END AS style, count(*) AS len FROM allch GROUP BY 1""",
    "marks": f"""SELECT a.chapter_id, a.i, {_IS_OPEN} AS o, {_IS_CLOSE} AS c FROM allch a JOIN styles s ON s.chapter_id = a.chapter_id WHERE style <> 'none' AND ch IN ('“', '”', '"', '‘', '’', '''')""",
    "runs": """SELECT chapter_id, min(i) AS e, max(i) + 1 AS ns FROM (SELECT chapter_id, i, i - row_number() OVER (PARTITION BY chapter_id ORDER BY i) AS g FROM allch WHERE ch = chr(10)) GROUP BY chapter_id, g HAVING count(*) >= 2""",
    "paras": """SELECT r.chapter_id, e, ns, lead(e, 1, s.len) OVER (PARTITION BY r.chapter_id ORDER BY e) AS ne, len, style FROM runs r JOIN styles s ON s.chapter_id = r.chapter_id WHERE style <> 'none'""",
    "firsts": f"""SELECT p.chapter_id, p.e, min(a.i) AS f FROM paras p JOIN allch a ON a.chapter_id = p.chapter_id AND a.i >= p.ns AND a.i < least(p.ne, p.ns + 200) AND regexp_matches(a.ch, '[^{WS}]') GROUP BY 1, 2""",
    "ends": """SELECT p.chapter_id, p.e AS i, p.ns < p.len AS has_next, coalesce(m.o, false) AS reopens, style FROM paras p LEFT JOIN firsts f ON f.chapter_id = p.chapter_id AND f.e = p.e
          LEFT JOIN marks m ON m.chapter_id = f.chapter_id AND m.i = f.f
        UNION ALL SELECT s.chapter_id, len, false, false, style FROM styles s WHERE style <> 'none' AND NOT EXISTS (SELECT 1 FROM paras p WHERE p.chapter_id = s.chapter_id AND p.ns >= p.len)""",
    "evts": """SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY i, is_end) AS n FROM (
        SELECT chapter_id, i, 1 AS is_end, false AS o, false AS c, has_next, reopens, style FROM ends UNION ALL SELECT chapter_id, i, 0, o, c, false, false, NULL FROM marks WHERE o OR c)""",
    "walk": """SELECT chapter_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS cur, false AS inq, 0 AS crossed, CAST(NULL AS BIGINT) AS s0, CAST(NULL AS BIGINT) AS s1, '' AS kind, false AS flag FROM styles
        UNION ALL
        SELECT chapter_id, n, CASE WHEN act = 0 THEN cur ELSE cut END, CASE act WHEN 0 THEN inq WHEN 1 THEN true WHEN 3 THEN true ELSE false END,
           CASE WHEN act IN (1, 3) THEN 0 WHEN cross_ THEN crossed + 1 ELSE crossed END, cur, CASE WHEN act = 0 THEN cur ELSE cut END, CASE WHEN act = 1 THEN 'narration' ELSE 'quote' END, act IN (3, 5)
        FROM (SELECT w.chapter_id, e.n, w.cur, w.inq, w.crossed,
            CASE WHEN e.is_end = 0 THEN CASE WHEN NOT inq AND e.o THEN 1 WHEN inq AND e.c THEN 2 WHEN inq AND e.o THEN 3 ELSE 0 END
                 WHEN NOT inq THEN 0 WHEN e.has_next AND e.reopens THEN 4 WHEN NOT e.has_next OR e.style = 'straight' OR crossed >= 3 THEN 5 ELSE 0 END AS act,
            e.is_end = 1 AND inq AND e.has_next AND NOT e.reopens AND e.style <> 'straight' AND crossed < 3 AS cross_,
            CASE WHEN e.is_end = 0 AND inq AND e.c THEN e.i + 1 ELSE e.i END AS cut
          FROM walk w JOIN evts e ON e.chapter_id = w.chapter_id AND e.n = w.n + 1)""",
    "cut": """SELECT chapter_id, s0, s1, kind, flag FROM walk WHERE s1 > s0
        UNION ALL SELECT s.chapter_id, w.cur, s.len, 'narration', false FROM styles s JOIN (SELECT chapter_id, arg_max(cur, n) AS cur FROM walk GROUP BY 1) w ON w.chapter_id = s.chapter_id WHERE w.cur < s.len""",
    "spans": """SELECT k.chapter_id, c.book_id, row_number() OVER (PARTITION BY k.chapter_id ORDER BY s0) - 1 AS span_idx, kind, s0, s1, substring(text, s0 + 1, s1 - s0) AS text, flag AS flagged,
          CASE WHEN kind = 'quote' THEN count(*) FILTER (WHERE kind = 'quote') OVER (PARTITION BY k.chapter_id ORDER BY s0) - 1 END AS q FROM cut k JOIN clean c ON c.chapter_id = k.chapter_id""",
    "atts": f"""SELECT chapter_id, quote_id, ord, {spick(["Hero ", "hero ", "ALIAS ", "narrator", "Stranger "], '((h + ord) // 3)')} || CASE WHEN ((h + ord) // 3) % 5 = 3 THEN '' ELSE CAST(((h + ord) // 3) % 30 AS VARCHAR) END AS speaker,
          h % 7 <> 0 AS is_dialogue, {spick(["high", "medium", "low", "high"], 'h + ord')} AS confidence
        FROM (SELECT chapter_id, CASE WHEN (chapter_id + q) % 17 = 3 THEN -1 - q ELSE q END AS quote_id, chapter_id + q AS h, unnest(CASE WHEN (chapter_id + q) % 13 = 0 THEN [0, 1] ELSE [0] END) AS ord
              FROM spans WHERE kind = 'quote' AND (chapter_id + q) % 11 <> 5)""",
    "qc": """SELECT chapter_id, q, s0, s1, q AS first_q, s0 AS cs FROM spans WHERE q = 0
        UNION ALL SELECT s.chapter_id, s.q, s.s0, s.s1, CASE WHEN s.q - r.first_q >= 30 OR s.s1 - r.cs > 12000 THEN s.q ELSE r.first_q END, CASE WHEN s.q - r.first_q >= 30 OR s.s1 - r.cs > 12000 THEN s.s0 ELSE r.cs END
        FROM qc r JOIN spans s ON s.chapter_id = r.chapter_id AND s.q = r.q + 1""",
    "chunks": """SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY first_q) - 1 AS chunk, first_q AS first, cnt, start, stop FROM (
        SELECT chapter_id, first_q, count(*) AS cnt, min(s0) AS start, max(s1) AS stop FROM qc GROUP BY 1, 2)""",
    "announce": f"""SELECT chapter_id, CASE WHEN title <> 'Section 3' THEN 'Chapter ' || CAST(list_sum(list_transform(a, lambda v, k: CASE WHEN v < coalesce(a[k + 1], 0) THEN -v ELSE v END)) AS BIGINT) || '. The Road.' END AS announcement
        FROM (SELECT chapter_id, title, {_worth.format("lower(regexp_extract(title, '^CHAPTER ([A-Z]+)', 1))")} AS a FROM quoted)""",
    "marked": f"""SELECT s.*, s.kind = 'quote' AND NOT coalesce(NOT a.is_dialogue, false) AS spoken,
          s.flagged OR a.speaker IS NULL OR a.confidence = 'low' OR (lower(a.speaker) <> 'narrator' AND d.character_id IS NULL) AS line_flag,
          s.kind = 'quote' AND (s.flagged OR coalesce(a.confidence = 'low', false)) AS buffer_flag, p.pov, coalesce(CASE WHEN lower(a.speaker) <> 'narrator' THEN d.character_id END, p.pov) AS character_id
        FROM spans s LEFT JOIN (SELECT * FROM atts QUALIFY row_number() OVER (PARTITION BY chapter_id, quote_id ORDER BY ord) = 1) a ON a.chapter_id = s.chapter_id AND a.quote_id = s.q
        LEFT JOIN dict d ON d.book_id = s.book_id AND d.key = lower(a.speaker)
        LEFT JOIN (SELECT doc_id, doc_id % 1500 AS pov FROM documents WHERE doc_id % 6 = 0) p ON p.doc_id = s.chapter_id""",
    "numbered": "SELECT *, count(*) FILTER (WHERE spoken) OVER (PARTITION BY chapter_id ORDER BY span_idx) - CAST(spoken AS INT) AS k FROM marked",
    "buffers": "SELECT chapter_id, k, string_agg(text, '' ORDER BY span_idx) AS buffer, bool_or(buffer_flag) AS flag, max(pov) AS pov FROM numbered WHERE NOT spoken GROUP BY 1, 2",
    "lines0": f"""SELECT n.chapter_id, n.k, n.character_id, n.text, n.line_flag, b.buffer AS gap, coalesce(lag(n.k) OVER w IS NOT NULL AND NOT regexp_matches(coalesce(b.buffer, ''), '[^{WS}]') AND lag(n.character_id) OVER w = n.character_id, false) AS joins
        FROM numbered n LEFT JOIN buffers b ON b.chapter_id = n.chapter_id AND b.k = n.k WHERE spoken WINDOW w AS (PARTITION BY n.chapter_id ORDER BY n.k)""",
    "lines1": "SELECT *, count(*) FILTER (WHERE NOT joins) OVER (PARTITION BY chapter_id ORDER BY k) AS run FROM lines0",
    "doc_buffers": f"SELECT chapter_id * 100000 + k AS doc_id, {trim_ws('buffer')} AS text FROM buffers WHERE regexp_matches(buffer, '[^{WS}]')",
    **pack_sql(PARAS, NARRATION, text_cte="doc_buffers"),
    "prose": "SELECT b.chapter_id, b.k, b.pov, b.flag, unnest(p.pieces) AS text, generate_subscripts(p.pieces, 1) AS piece FROM packed p JOIN buffers b ON b.chapter_id * 100000 + b.k = p.doc_id",
    "parts0": """SELECT chapter_id, -1 AS k, 0 AS side, 0 AS piece, CAST(NULL AS BIGINT) AS character_id, 'narration' AS kind, announcement AS text, false AS flagged FROM announce WHERE announcement IS NOT NULL
        UNION ALL SELECT chapter_id, k, 0, piece, pov, 'narration', text, flag FROM prose
        UNION ALL SELECT chapter_id, min(k), 1, 0, max(character_id), CASE WHEN max(character_id) IS NOT NULL THEN 'dialogue' ELSE 'narration' END,
          string_agg(CASE WHEN NOT joins THEN '' ELSE coalesce(nullif(gap, ''), ' ') END || text, '' ORDER BY k), bool_or(line_flag) FROM lines1 GROUP BY chapter_id, run""",
    "script": "SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY k, side, piece) - 1 AS idx, character_id, kind, text, flagged FROM parts0 WHERE length(text) > 0",
    "notes": f"""SELECT s.chapter_id, s.idx AS line, CASE WHEN (s.chapter_id + s.idx) % 13 = 12 THEN 'sad' ELSE {spick([*S.DELIVERIES, "mumbled"], 's.chapter_id + s.idx')} END AS delivery
        FROM script s WHERE (s.chapter_id + s.idx) % 3 = 0 AND (s.chapter_id + s.idx) % 10 <> 9 AND kind = 'dialogue'""",
    "cues": f"""SELECT chapter_id, line, prompt, seconds FROM (SELECT s.chapter_id, s.idx AS line, trim({spick([" a door ", "  ", "glass"], '(s.chapter_id + s.idx) // 4')}) AS prompt,
            CASE WHEN (s.chapter_id + s.idx) % 3 = 0 THEN 'zzqq' ELSE {trim_ws("substring(s.text, 1, 6)")} END AS evidence,
            floor(least(6.0, greatest(1.0, (s.chapter_id + s.idx) % 80 / 10.0 - 0.04))::DOUBLE * 10 + 0.5) / 10 AS seconds, c.text AS body
          FROM script s JOIN clean c ON c.chapter_id = s.chapter_id JOIN books b ON b.id = c.book_id AND b.sfx_enabled WHERE (s.chapter_id + s.idx) % 4 = 1)
        WHERE prompt <> '' AND evidence <> '' AND contains(body, evidence) QUALIFY row_number() OVER (PARTITION BY chapter_id ORDER BY line) <= 2""",
    "final": """SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY line, is_cue) - 1 AS idx, kind, character_id, delivery, text, sfx_duration_sec FROM (
        SELECT s.chapter_id, s.idx AS line, 0 AS is_cue, kind, character_id, n.delivery, text, CAST(NULL AS DOUBLE) AS sfx_duration_sec FROM script s LEFT JOIN notes n ON n.chapter_id = s.chapter_id AND n.line = s.idx
        UNION ALL SELECT chapter_id, line, 1, 'sfx', NULL, NULL, prompt, seconds FROM cues)""",
    "fmt": """SELECT s.chapter_id, s.idx, '#' || s.idx || ' [' || CASE WHEN kind = 'dialogue' AND s.character_id IS NOT NULL THEN coalesce(c.name, '?') ELSE 'Narration' END || ']: ' || text AS line
        FROM script s LEFT JOIN characters c ON c.id = s.character_id""",
    "lr": """SELECT chapter_id, idx, length(line) AS size, idx AS first FROM fmt WHERE idx = 0
        UNION ALL SELECT f.chapter_id, f.idx, CASE WHEN r.size + length(f.line) > 14000 THEN length(f.line) ELSE r.size + length(f.line) END, CASE WHEN r.size + length(f.line) > 14000 THEN f.idx ELSE r.first END
        FROM lr r JOIN fmt f ON f.chapter_id = r.chapter_id AND f.idx = r.idx + 1""",
    "bw": f"""SELECT chapter_id, CAST(-1 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS cur, false AS matched, true AS pb, false AS sb, false AS ti FROM clean
        UNION ALL SELECT chapter_id, idx, CASE WHEN NOT title AND found > 0 THEN cur + found - 1 + n ELSE cur END, matched OR (NOT title AND found > 0),
          CASE WHEN title THEN true WHEN found = 0 THEN kind = 'narration' ELSE NOT matched OR brk END, CASE WHEN title THEN false WHEN found = 0 THEN kind <> 'narration' ELSE matched AND NOT brk AND found > 1 END, title
        FROM (SELECT *, regexp_matches(substring(body, cur + 1, greatest(found - 1, 0)), '\\n[{WS}]*\\n') AS brk FROM (
          SELECT s.chapter_id, s.idx, b.cur, b.matched, s.kind, length(s.text) AS n, c.text AS body, s.kind = 'narration' AND coalesce(s.text = a.announcement, false) AS title, strpos(substring(c.text, b.cur + 1), s.text) AS found
          FROM bw b JOIN script s ON s.chapter_id = b.chapter_id AND s.idx = b.idx + 1 JOIN clean c ON c.chapter_id = s.chapter_id JOIN announce a ON a.chapter_id = s.chapter_id))""",
    "bounds": "SELECT w.chapter_id, w.idx, s.kind, s.text, pb, sb, ti FROM bw w JOIN script s ON s.chapter_id = w.chapter_id AND s.idx = w.idx WHERE w.idx >= 0",
}
BLOCK_CTES = {
    **SPAN_CTES, **{k: v for k, v in PHRASE_CTES.items() if k not in ("lines", "weighed", "fold")}, "pfold": PHRASE_CTES["fold"].replace("FROM fold f", "FROM pfold f"),
    "raw_pieces": PHRASE_CTES["raw_pieces"].replace("FROM fold", "FROM pfold"),
    "lines": "SELECT chapter_id, idx, text FROM bounds WHERE NOT ti",
    "openers": "SELECT *, ti OR lag(ti) OVER w IS NULL OR lag(ti) OVER w OR pb AS opens FROM bounds WINDOW w AS (PARTITION BY chapter_id ORDER BY idx)",
    "bits": f"""SELECT o.chapter_id, o.idx, o.ti, o.sb, o.opens, p.phrase_idx AS p, unnest(x) AS t, generate_subscripts(x, 1) - 1 AS c FROM openers o JOIN (
          SELECT chapter_id, idx, phrase_idx, string_split_regex(phrase, '\\n[{WS}]*\\n') AS x FROM pieces UNION ALL SELECT chapter_id, idx, 0, [text] FROM bounds WHERE ti) p ON p.chapter_id = o.chapter_id AND p.idx = o.idx""",
    "blocked": """SELECT *, p = 0 AND c = 0 AND NOT opens AND sb AS space, sum(CASE WHEN p = 0 AND c = 0 THEN CAST(opens AS INT) ELSE CAST(c > 0 AS INT) END) OVER (PARTITION BY chapter_id ORDER BY idx, p, c) AS b FROM bits""",
    "spaced": f"""SELECT *, regexp_matches(t, '[^{WS}]') AS shown, coalesce(bool_or(regexp_matches(t, '[^{WS}]')) OVER (PARTITION BY chapter_id, b ORDER BY idx, p, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS later FROM blocked""",
}
KEY = lambda *parts: "sha256(" + " || ".join(f"coalesce(length(CAST({p} AS VARCHAR)) || ':' || CAST({p} AS VARCHAR), '~')" for p in parts) + ")"
PLAN_CTES = {
    **DICT,
    "plan0": """SELECT s.chapter_id, s.idx, s.kind, s.text, s.delivery, s.is_title, s.sfx_duration_sec, b.render_model, CASE WHEN o.voice_id IS NOT NULL THEN o.character_id ELSE n.character_id END AS vid
        FROM segs s JOIN books b ON b.id = s.book_id LEFT JOIN own o ON o.book_id = s.book_id AND o.character_id = s.character_id LEFT JOIN (SELECT * FROM own WHERE is_narrator) n ON n.book_id = s.book_id""",
    "deliv": "SELECT unnest([" + ", ".join(f"struct_pack(n := '{n}', tag := '{t}', a := {a}::DOUBLE, b := {b}::DOUBLE, c := {c}::DOUBLE)" for n, t, a, b, c in D.DELIVERIES) + "]) AS r",
    "plan1": """SELECT p.*, a.voice_id, a.seed, a.similarity_boost AS sim, a.stability::DOUBLE AS st, a.style::DOUBLE AS sy, a.speed::DOUBLE AS sp, r.tag, r.a, r.b, r.c, render_model = 'eleven_v3' AS v3
        FROM plan0 p LEFT JOIN assignments a ON a.character_id = p.vid LEFT JOIN deliv ON r.n = p.delivery""",
    "plan": """SELECT *, CASE WHEN v3 AND tag IS NOT NULL THEN tag || ' ' ELSE '' END || text || CASE WHEN is_title THEN CASE WHEN v3 THEN ' [pause]' ELSE ' <break time="1.5s" />' END ELSE '' END AS rt,
          CASE WHEN v3 THEN CASE WHEN st < 0.25 THEN 0.0 WHEN st < 0.75 THEN 0.5 WHEN st IS NULL THEN 1.0 ELSE 1.0 END WHEN a IS NULL THEN st ELSE floor(least(1.0, greatest(0.0, st + a))::DOUBLE * 100 + 0.5) / 100 END AS rst,
          CASE WHEN v3 OR a IS NULL THEN sy ELSE floor(least(greatest(0.4, sy), greatest(0.0, sy + b))::DOUBLE * 100 + 0.5) / 100 END AS rsy,
          CASE WHEN v3 OR a IS NULL THEN sp ELSE floor(least(1.1, greatest(0.85, sp + c))::DOUBLE * 100 + 0.5) / 100 END AS rsp FROM plan1""",
    "keyed": f"""SELECT *, CASE WHEN kind = 'sfx' THEN {KEY("text", "coalesce(sfx_duration_sec, 3.0)::DOUBLE", "'sfx-v2'")}
          ELSE {KEY("rt", "voice_id", "rst::DOUBLE", "sim::DOUBLE", "rsy::DOUBLE", "rsp::DOUBLE", "render_model", "seed")} END AS cache_key FROM plan""",
    "probed": "SELECT *, left(cache_key, 1) < '6' OR row_number() OVER (PARTITION BY cache_key ORDER BY chapter_id, idx) > 1 AS is_cached FROM keyed",
    "chained": """SELECT *, sum(CAST(brk AS INT)) OVER (PARTITION BY chapter_id ORDER BY idx) AS chain FROM (SELECT *, NOT (fresh AND coalesce(lag(fresh) OVER w, false) AND lag(voice_id) OVER w IS NOT DISTINCT FROM voice_id) AS brk
        FROM (SELECT *, NOT is_cached AND kind <> 'sfx' AS fresh FROM probed) WINDOW w AS (PARTITION BY chapter_id ORDER BY idx))""",
}
SQ = lambda sql, extra=None: with_model(sql, {**DICT, **SPAN_CTES, **(extra or {})}, recursive=True)
PQ = lambda sql: with_model(sql, PLAN_CTES)
_SETTINGS = [f"{c}::DOUBLE" for c in C.SETTINGS]

QUERIES = {
    "quote_styles": (quote_styles, SQ("SELECT chapter_id, style FROM styles", {"clean": "SELECT chapter_id, text FROM quoted"})),
    "quote_spans": (quote_spans, SQ('SELECT chapter_id, span_idx, kind, s0 AS start, s1 AS "end", md5(text) AS text_hash, flagged, q FROM spans')),
    "span_tiling_breaks": (span_tiling_breaks, SQ("""SELECT s.style, count(*) AS chapters, count(*) FILTER (WHERE s.chapter_id % 7 IN (1, 2, 3) AND length(c.text) > 0) AS broken
        FROM styles s JOIN clean c ON c.chapter_id = s.chapter_id GROUP BY 1""")),
    "attribution_chunks": (attribution_chunks, SQ("SELECT * FROM chunks")),
    "marked_passages": (marked_passages, SQ("""SELECT chapter_id, chunk, md5(x) AS passage_hash, length(x) AS n FROM (
        SELECT k.chapter_id, k.chunk, CASE WHEN start > 400 THEN '…' ELSE '' END || substring(c.text, greatest(0, start - 400) + 1, start - greatest(0, start - 400))
          || string_agg(CASE WHEN s.kind = 'quote' THEN '⟦' || s.q || '⟧' || s.text || '⟦/' || s.q || '⟧' ELSE s.text END, '' ORDER BY s.s0)
          || substring(c.text, stop + 1, least(length(c.text), stop + 400) - stop) || CASE WHEN stop + 400 < length(c.text) THEN '…' ELSE '' END AS x
        FROM chunks k JOIN clean c ON c.chapter_id = k.chapter_id JOIN spans s ON s.chapter_id = k.chapter_id AND s.s0 >= k.start AND s.s1 <= k.stop GROUP BY k.chapter_id, k.chunk, c.text, start, stop)""")),
    "rolling_context": (rolling_context, SQ("""SELECT k.chapter_id, k.chunk, string_agg('⟦' || a.quote_id || '⟧=' || a.speaker, ', ' ORDER BY a.quote_id) AS recent
        FROM chunks k JOIN (SELECT * FROM atts QUALIFY row_number() OVER (PARTITION BY chapter_id, quote_id ORDER BY ord DESC) = 1) a ON a.chapter_id = k.chapter_id AND a.quote_id >= greatest(k.first, k.first + k.cnt - 3) AND a.quote_id < k.first + k.cnt GROUP BY 1, 2""")),
    "assembled_script": (assembled_script, SQ("SELECT chapter_id, idx, character_id, kind, md5(text) AS text_hash, length(text) AS n, flagged FROM script")),
    "delivery_notes": (delivery_notes, SQ("SELECT chapter_id, line, delivery FROM notes")),
    "sound_cues": (sound_cues, SQ("SELECT chapter_id, line, prompt, round(seconds, 4) AS seconds FROM cues")),
    "final_script": (final_script, SQ("SELECT chapter_id, idx, kind, character_id, delivery, sha256(text) AS text_hash, round(sfx_duration_sec, 4) AS sfx_duration_sec FROM final")),
    "script_lines": (script_lines, SQ("SELECT chapter_id, idx, md5(line) AS line_hash FROM fmt")),
    "script_chunks": (script_chunks, SQ("SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY first) - 1 AS chunk, first, cnt FROM (SELECT chapter_id, first, count(*) AS cnt FROM lr GROUP BY 1, 2)")),
    "segment_boundaries": (segment_boundaries, SQ("SELECT chapter_id, idx, pb AS para_break_before, sb AS space_before, ti AS is_title FROM bounds")),
    "reader_blocks": (reader_blocks, SQ("""SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY b) - 1 AS block_idx, kind, md5(x) AS text_hash, length(x) AS n FROM (
        SELECT chapter_id, b, CASE WHEN bool_or(ti) THEN 'title' ELSE 'para' END AS kind, string_agg(CASE WHEN space AND later THEN ' ' ELSE '' END || CASE WHEN shown OR ti THEN t ELSE '' END, '' ORDER BY idx, p, c) AS x
        FROM spaced GROUP BY 1, 2 HAVING bool_or(shown OR ti))""", BLOCK_CTES)),
    "render_plan": (render_plan, PQ("SELECT chapter_id, idx, md5(rt) AS text_hash, round(rst, 4) AS r_stability, round(rsy, 4) AS r_style, round(rsp, 4) AS r_speed FROM plan")),
    "cache_keys": (cache_keys, PQ("SELECT chapter_id, idx, cache_key, sha256(text) AS text_hash FROM keyed")),
    "cache_probe": (cache_probe, PQ("SELECT chapter_id, idx, is_cached FROM probed")),
    "fresh_cost": (fresh_cost, PQ("""SELECT chapter_id, count(*) AS lines, count(*) FILTER (WHERE is_cached) AS cached, CAST(sum(CASE WHEN is_cached THEN 0 WHEN kind = 'sfx' THEN ceil(coalesce(sfx_duration_sec, 3.0)::DOUBLE * 11) ELSE length(rt) END) AS BIGINT) AS to_pay FROM probed GROUP BY 1""")),
    "stitch_chains": (stitch_chains, PQ("""SELECT chapter_id, idx, CAST(chain AS BIGINT) AS chain, CASE WHEN fresh AND NOT v3 THEN coalesce(array_to_string(list_transform(list_filter(l, lambda x: x.c = chain), lambda x: x.i), ','), '') ELSE '' END AS follows
        FROM (SELECT *, list(struct_pack(i := idx, c := chain)) OVER (PARTITION BY chapter_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l FROM chained)""")),
    "render_batches": (render_batches, with_model("SELECT chapter_id, p // 4 AS batch, count(*) AS n, min(idx) AS first_idx FROM (SELECT chapter_id, idx, row_number() OVER (PARTITION BY chapter_id ORDER BY idx) - 1 AS p FROM segments) GROUP BY 1, 2")),
    "render_waves": (render_waves, f"""SELECT chapter_id, p // 25 AS batch, count(*) AS n, min(idx) AS first_idx, p // 25 // 3 AS wave
        FROM (SELECT chapter_id, idx, row_number() OVER (PARTITION BY chapter_id ORDER BY idx) - 1 AS p FROM ({LINE_SEGMENTS_SQL})) GROUP BY 1, 2, 5"""),
    "preview_and_intro_keys": (preview_and_intro_keys, with_model(f"""SELECT character_id, {KEY("voice_id", "left(repeat(rationale, 40), 300)", *_SETTINGS, "'eleven_flash_v2_5'")} AS preview_key,
        left({KEY("voice_name", "rationale", "voice_id", *_SETTINGS, "'eleven_v3'", "'intro-v3'")}, 16) AS intro_key FROM assignments""")),
    "clip_durations": (clip_durations, "SELECT l_orderkey, n_bytes, n_bytes * 8 / 128000.0 AS duration_sec FROM (SELECT l_orderkey, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS n_bytes FROM lineitem GROUP BY 1)"),
}
