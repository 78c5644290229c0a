"""Queries over cast and voices, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscript.functions import domains as D
from folioscript.functions.js import lower_key
from folioscript.operators import cast as C
from folioscript.operators import ordered as O
from folioscript.operators import voices as V
from folioscript.sources import samples as S
from folioscript.sources.model import Model, pick
from folioscript.sources.sql_model import key, lst, trim_ws, with_model
from folioscript.sources.sql_model import pick as spick

_join = lambda c: F.array_join(c, "|")


def _old_cast(m):
    """The cast before re-analysis: other ids, partly other names."""
    c = F.col("id")
    return m.characters.withColumns({
        "name": F.when(c % 4 == 0, F.concat(F.lit("Former "), c.cast("string"))).otherwise(F.concat(F.lit("Hero "), (c % 61).cast("string"))),
        "aliases": F.array(F.concat(F.lit("nobody "), c.cast("string")), F.concat(F.lit("Alias "), (c % 23).cast("string")), F.lit("NARRATOR")),
    }).filter(c % 7 != 0)


OLD_CAST = """SELECT id, book_id, dialogue_share, is_narrator, profile_edited, age_range,
   CASE WHEN id % 4 = 0 THEN 'Former ' || id ELSE 'Hero ' || (id % 61) END AS name,
   ['nobody ' || id, 'Alias ' || (id % 23), 'NARRATOR'] AS aliases FROM characters WHERE id % 7 <> 0"""


def _segments_in_books(m):
    return m.segments.join(m.chapters.select(F.col("id").alias("chapter_id"), "book_id"), "chapter_id")


SEGS_IN_BOOKS = "SELECT s.*, c.book_id FROM segments s JOIN chapters c ON c.id = s.chapter_id"


def _mentions(m):
    """Per-chunk character mentions, taken from order lines."""
    pk = F.col("l_partkey")
    return m.table("lineitem").select(
        (F.col("l_orderkey") % 25).alias("book_id"), F.col("l_orderkey").alias("chunk_idx"),
        F.concat(pick(["", " ", ""], pk), pick(["Hero ", "HERO ", "Alias ", "Who "], pk), (pk % 60).cast("string")).alias("name"),
        F.array(F.concat(F.lit("aka "), (F.col("l_suppkey") % 7).cast("string")), F.lit("")).alias("aliases"),
        pick(["male", "female", "unknown"], F.col("l_linenumber")).alias("gender_hint"),
        F.array(F.concat(F.lit("q"), pk.cast("string"))).alias("quotes"))


MENTIONS = f"""SELECT l_orderkey % 25 AS book_id, l_orderkey AS chunk_idx,
   {spick(["", " ", ""], 'l_partkey')} || {spick(["Hero ", "HERO ", "Alias ", "Who "], 'l_partkey')} || (l_partkey % 60) AS name,
   ['aka ' || (l_suppkey % 7), ''] AS aliases, {spick(["male", "female", "unknown"], 'l_linenumber')} AS gender_hint, 'q' || l_partkey AS quote FROM lineitem"""


def _picks(m):
    c = F.col("id")
    names = m.voices.select(F.col("id").alias("_vid"), F.upper("name").alias("_vname"))
    return m.characters.filter(c % 6 != 5).select(
        "id", F.concat(F.lit("v"), (c * 3 % 27).cast("string"), F.lit("-"), (c % 13).cast("string")).alias("pick_id"),
        F.concat(F.lit("v"), (c % 25 + 1).cast("string"), F.lit("-"), (c % 12).cast("string")).alias("_vid"),
        ((c % 10) / 10.0).alias("pick_stability"), (0.85 + (c % 20) / 100.0).alias("pick_speed"),
        pick(["fits the accent well", "short", "a placeholder for now", "calm and warm narrator voice", None], c).alias("rationale"),
    ).join(names, "_vid", "left").select("id", "pick_id", F.coalesce("_vname", F.lit("Nobody")).alias("pick_name"), "pick_stability", "pick_speed", "rationale")


PICKS = f"""SELECT c.id, 'v' || (c.id * 3 % 27) || '-' || (c.id % 13) AS pick_id, coalesce(upper(v.name), 'Nobody') AS pick_name,
   (c.id % 10) / 10.0 AS pick_stability, 0.85 + (c.id % 20) / 100.0 AS pick_speed,
   {spick(["fits the accent well", "short", "a placeholder for now", "calm and warm narrator voice", None], 'c.id')} AS rationale
   FROM characters c LEFT JOIN voices v ON v.id = 'v' || (c.id % 25 + 1) || '-' || (c.id % 12) WHERE c.id % 6 <> 5"""

AGE_TEXT = lambda e: f"""CASE WHEN regexp_matches(lower({e}), '{D.AGE_OLD}') THEN 'old' WHEN regexp_matches(lower({e}), '{D.AGE_MIDDLE}') THEN 'middle'
   WHEN regexp_matches(lower({e}), '{D.AGE_YOUNG}') THEN 'young' END"""
AGE_VOICE = lambda e: f"CASE WHEN lower({e}) LIKE '%young%' THEN 'young' WHEN lower({e}) LIKE '%old%' THEN 'old' WHEN lower({e}) LIKE '%middle%' THEN 'middle' END"
ACCENT = lambda e: "CASE " + " ".join(f"WHEN regexp_matches(lower({e}), '{p}') THEN '{n}'" for n, p in D.ACCENT_FAMILIES) + " END"

DICT = {
    "all_names": """SELECT *, unnest(list_prepend(name, aliases)) AS nm, generate_subscripts(list_prepend(name, aliases), 1) - 1 AS pos FROM characters""",
    "dict": f"""SELECT book_id, {key('nm')} AS key, arg_min(id, (CASE WHEN pos = 0 THEN 1 ELSE 2 END, -dialogue_share, name, id)) AS character_id
        FROM all_names WHERE NOT is_narrator AND {key('nm')} <> '' GROUP BY 1, 2""",
    "dict_n": f"""SELECT book_id, {key('nm')} AS key, arg_min(id, (CASE WHEN is_narrator THEN 0 WHEN pos = 0 THEN 1 ELSE 2 END, -dialogue_share, name, id)) AS character_id
        FROM all_names WHERE (NOT is_narrator OR pos = 0) AND {key('nm')} <> '' GROUP BY 1, 2""",
    "mentions": MENTIONS,
    "old_cast": OLD_CAST,
    "moves": f"""SELECT o.id AS old_id, arg_min(d.character_id, o.pos) AS new_id FROM (SELECT id, book_id, unnest(list_prepend(name, aliases)) AS nm,
          generate_subscripts(list_prepend(name, aliases), 1) - 1 AS pos FROM old_cast) o JOIN dict_n d ON d.book_id = o.book_id AND d.key = {key('o.nm')} GROUP BY 1""",
    "segs": SEGS_IN_BOOKS,
    "picks": PICKS,
    "vclass": f"SELECT *, coalesce(gender, '') AS vg, {AGE_VOICE('age')} AS va, {ACCENT('accent')} AS vf FROM voices",
    "cclass": f"SELECT *, {AGE_TEXT('age_range')} AS ca, coalesce({ACCENT('accent_hint')}, {ACCENT('heritage')}) AS cf FROM characters",
    "ranked": """SELECT id, voice_id, tier, ordinal FROM (SELECT c.id, v.id AS voice_id, v.ordinal,
          CASE WHEN g AND a AND coalesce(vf = cf, false) THEN 1 WHEN g AND a AND (cf IS NULL OR vf IS NULL) THEN 2 WHEN g AND a THEN 3 WHEN g THEN 4 ELSE 5 END AS tier
        FROM (SELECT c.*, v.id AS vid, vg = '' OR gender IN ('unknown', 'nonbinary') OR vg = gender AS g,
                NOT coalesce((ca = 'old' AND va = 'young') OR (ca = 'young' AND va = 'old'), false) AS a, vf FROM cclass c, (SELECT id, vg, va, vf FROM vclass) v) c
        JOIN voices v ON v.id = c.vid) QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, ordinal) = 1""",
    "pools": """SELECT gender, ca, cf, list(vid ORDER BY ordinal) AS pool FROM (SELECT *, min(tier) OVER (PARTITION BY gender, ca, cf) AS best FROM (
          SELECT k.gender, k.ca, k.cf, v.id AS vid, v.ordinal, CASE WHEN g AND a AND coalesce(vf = cf, false) THEN 1 WHEN g AND a AND (cf IS NULL OR vf IS NULL) THEN 2 WHEN g AND a THEN 3 WHEN g THEN 4 ELSE 5 END AS tier
          FROM (SELECT k.*, v.id AS vid, v.vf, vg = '' OR k.gender IN ('unknown', 'nonbinary') OR vg = k.gender AS g,
                  NOT coalesce((ca = 'old' AND va = 'young') OR (ca = 'young' AND va = 'old'), false) AS a
                FROM (SELECT DISTINCT gender, ca, cf FROM cclass) k CROSS JOIN vclass v) k JOIN voices v ON v.id = k.vid))
        WHERE tier = best AND (tier < 5 OR ordinal = (SELECT min(ordinal) FROM voices)) GROUP BY 1, 2, 3""",
    "turns": """SELECT c.id, c.book_id, p.pool, row_number() OVER (PARTITION BY c.book_id ORDER BY is_narrator DESC, dialogue_share DESC, name, c.id) AS pos
        FROM cclass c JOIN pools p ON p.gender IS NOT DISTINCT FROM c.gender AND p.ca IS NOT DISTINCT FROM c.ca AND p.cf IS NOT DISTINCT FROM c.cf""",
    "by_name": f"SELECT {key('name')} AS key, arg_min(struct_pack(id := id, name := name, gender := gender, age := age), ordinal) AS v FROM voices GROUP BY 1",
    "resolved": f"""SELECT p.*, CASE WHEN a.id IS NOT NULL AND {key('a.name')} = {key('p.pick_name')} THEN struct_pack(id := a.id, name := a.name, gender := a.gender, age := a.age)
          WHEN b.v IS NOT NULL THEN b.v WHEN a.id IS NOT NULL THEN struct_pack(id := a.id, name := a.name, gender := a.gender, age := a.age) END AS v
        FROM picks p LEFT JOIN voices a ON a.id = p.pick_id LEFT JOIN by_name b ON b.key = {key('p.pick_name')}""",
    "judged": f"""SELECT c.*, r.pick_id, r.v, r.rationale, r.pick_stability, r.pick_speed, f.voice_id AS fallback,
          CASE WHEN r.pick_id IS NULL THEN 'not assigned' WHEN r.v IS NULL THEN 'unknown voice'
            WHEN r.rationale IS NULL OR length(trim(r.rationale)) < 12 OR regexp_matches(r.rationale, '(?i)\\b(placeholder|todo|tbd|n/a)\\b') THEN 'a filler rationale'
            WHEN c.gender IN ('male', 'female') AND lower(r.v.gender) IN ('male', 'female') AND c.gender <> lower(r.v.gender) THEN 'a gender mismatch'
            WHEN (c.ca = 'old' AND {AGE_VOICE('r.v.age')} = 'young') OR (c.ca = 'young' AND {AGE_VOICE('r.v.age')} = 'old') THEN 'an age mismatch' END AS problem
        FROM cclass c LEFT JOIN resolved r ON r.id = c.id JOIN ranked f ON f.id = c.id""",
    "own": "SELECT c.book_id, c.id AS character_id, c.is_narrator, a.voice_id, a.seed FROM characters c JOIN assignments a ON a.character_id = c.id",
    "narr": "SELECT book_id, voice_id, seed FROM own WHERE is_narrator",
    "ordered_cast": """SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY is_narrator DESC, dialogue_share DESC, name, id) - 1 AS position FROM characters""",
}
Q = lambda sql, extra=None, **k: with_model(sql, {**DICT, **(extra or {})}, **k)
QR = lambda sql, extra: Q(sql, extra, recursive=True)
WALK = {
    "seats": "SELECT t.id, t.book_id, t.pos, t.pool, h.fixed FROM turns t JOIN held h ON h.id = t.id",
    "walk": """SELECT book_id, id, pos, coalesce(fixed, pool[1]) AS voice_id, [coalesce(fixed, pool[1])] AS taken FROM seats WHERE pos = 1
        UNION ALL SELECT book_id, id, pos, v, list_append(taken, v) FROM (SELECT s.book_id, s.id, s.pos, w.taken,
            coalesce(s.fixed, list_filter(s.pool, lambda x: NOT list_contains(w.taken, x))[1], s.pool[1]) AS v
          FROM walk w JOIN seats s ON s.book_id = w.book_id AND s.pos = w.pos + 1)""",
}


def name_dictionary(spark, d):
    return C.name_dictionary(Model(spark, d).characters)


def speaker_resolution(spark, d):
    m = Model(spark, d)
    said = _mentions(m).select("book_id", "chunk_idx", F.col("name").alias("speaker"))
    return C.resolve_speakers(said, C.name_dictionary(m.characters)).groupBy("book_id", "speaker", "character_id").agg(F.count("*").alias("n"))


def old_to_new_cast(spark, d):
    m = Model(spark, d)
    return C.match_old_to_new(_old_cast(m), C.name_dictionary(m.characters, with_narrator=True))


def uncast_characters(spark, d):
    m = Model(spark, d)
    return m.characters.join(m.assignments.select(F.col("character_id").alias("id")), "id", "left_anti").select("book_id", "id", "name")


def segment_voices(spark, d):
    m = Model(spark, d)
    return V.resolve_segment_voices(_segments_in_books(m), m.characters, m.assignments).select(
        "chapter_id", "idx", F.col("voice.voice_id").alias("voice_id"), F.col("voice.seed").alias("seed"))


def missing_voice_names(spark, d):
    m = Model(spark, d)
    return V.missing_voice_names(_segments_in_books(m), m.characters, m.assignments)


def best_voice(spark, d):
    m = Model(spark, d)
    return V.best_voice(m.characters, m.voices).select("id", F.col("tier").cast("long"), "voice_id")


def distinct_voices(spark, d):
    m = Model(spark, d)
    return V.distinct_voices(m.characters, m.voices)


def resolved_picks(spark, d):
    m = Model(spark, d)
    return V.resolve_picks(_picks(m), m.voices).select("id", F.col("voice.id").alias("voice_id"))


def pick_validation(spark, d):
    m = Model(spark, d)
    return V.cast_from_picks(m.characters, _picks(m), m.voices).select("id", "problem")


def assignment_settings(spark, d):
    m = Model(spark, d)
    return V.cast_from_picks(m.characters, _picks(m), m.voices).select(
        "id", "voice_id", "rationale", F.round("stability", 4).alias("stability"), "similarity_boost", "style", F.round("speed", 4).alias("speed"))


def age_and_accent_classes(spark, d):
    return Model(spark, d).characters.select(
        "id", D.age_bucket_of_text(F.col("age_range")).alias("age_bucket"), D.accent_family(F.col("accent_hint")).alias("accent"),
        D.accent_family(F.col("heritage")).alias("heritage"))


def voice_classes(spark, d):
    return Model(spark, d).voices.select("id", D.age_bucket_of_voice(F.col("age")).alias("age_bucket"), D.accent_family(F.col("accent")).alias("accent"))


def variant_siblings(spark, d):
    return C.variant_siblings(Model(spark, d).characters).select("id", "sibling_id", "sibling_count")


def cast_voice_list(spark, d):
    m = Model(spark, d)
    return V.cast_voice_list(m.characters, m.assignments, m.voices)


def voices_not_cast(spark, d):
    m = Model(spark, d)
    return m.voices.select("id").join(m.assignments.select(F.col("voice_id").alias("id")).distinct(), "id", "left_anti")


def already_cast(spark, d):
    m = Model(spark, d)
    return V.already_cast(m.characters, m.assignments, m.voices).select("id", "name", "voice_name", "v_gender", "v_age", "v_accent")


def accent_list(spark, d):
    m = Model(spark, d)
    return m.voices.filter("accent IS NOT NULL AND accent <> ''").select("accent").distinct().withColumn(
        "n", F.length("accent").cast("long"))


def group_rank_order(spark, d):
    return C.list_order(Model(spark, d).characters).select("id", "group_key", "group_rank")


def cast_order_and_batches(spark, d):
    return C.cast_order(Model(spark, d).characters).select("id", "position", "batch")


def measured_dialogue_share(spark, d):
    m = Model(spark, d)
    return C.measured_share(m.segments, m.chapters).select("book_id", "character_id", "chars", F.round("share", 9).alias("share"))


def mention_merge(spark, d):
    return C.merge_mentions(_mentions(Model(spark, d))).select(
        "book_id", "key", F.col("rank").cast("long").alias("cast_rank"), "mention_count", "name", _join("aliases").alias("aliases"), "gender", _join("quotes").alias("quotes"))


def alias_components(spark, d):
    return C.alias_components(_alias_mentions(Model(spark, d)))


def _alias_mentions(m):
    c = F.col("c_custkey")
    return m.table("customer").select(
        F.col("c_nationkey").cast("long").alias("book_id"), F.concat(F.lit("Name "), c.cast("string")).alias("name"),
        F.when(c % 3 == 0, F.array(F.concat(F.lit("name "), (F.floor(c / 2)).cast("string")), F.concat(F.lit("Nick "), (c % 40).cast("string"))))
        .otherwise(F.array(F.concat(F.lit("Title "), F.floor(c / 100).cast("string")))).alias("aliases"))


def alias_lists(spark, d):
    m = Model(spark, d)
    return m.characters.select("id", _join(C.dedupe_aliases(F.concat("aliases", F.array(F.upper("name"), F.lit(" Alias 3 "))), F.col("name"))).alias("aliases"))


def _merged_cast(m):
    c = F.col("id")
    v = lambda k: F.struct(
        F.concat(F.lit(" "), F.lit(S.VARIANT_LABELS[k].upper())).alias("label"), F.lit(S.VARIANT_LABELS[k]).alias("age_range"),
        F.when((c + k) % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit("style "), F.lit(str(k)))).alias("speech_style"),
        (F.col("dialogue_share") + k).alias("dialogue_share"),
        F.when((c + k) % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.repeat(F.lit("word "), (c % 90).cast("int")))).alias("quotes"))
    return m.characters.select(
        "book_id", "id", "name", "aliases", "role", "age_range", F.lit("plain").alias("speech_style"), "dialogue_share",
        F.array(F.concat(F.lit("own "), c.cast("string"))).alias("quotes"),
        F.slice(F.array(*[v(k) for k in range(4)]), 1, (c % 4).cast("int")).alias("age_variants"))


def age_variant_expansion(spark, d):
    return C.expand_age_variants(_merged_cast(Model(spark, d))).select(
        "source_id", "name", _join("aliases").alias("aliases"), "age_range", "speech_style", _join("quotes").alias("quotes"), "dialogue_share", "variant_group", "variant_label")


def _split_commands(m):
    c = F.col("id")
    return m.characters.filter(c % 2 == 0).select(
        c.alias("character_id"), F.slice(F.array(F.lit(" Child"), F.lit("Adult"), pick(["Elderly", "adult", ""], c)), 1, (c % 5).cast("int")).alias("labels"),
        F.array(F.lit("8"), F.lit(" "), F.lit("70s")).alias("age_ranges"))


def variant_split(spark, d):
    m = Model(spark, d)
    return C.split_into_variants(m.characters, _split_commands(m)).select(
        "source_id", "character_id", "variant_name", F.col("variant_label"), _join("variant_aliases").alias("aliases"), "age_range", "dialogue_share", "reject_reason")


def _removals(m):
    """The two lowest ids of each variant group."""
    members = m.characters.filter("variant_group IS NOT NULL").select("book_id", "variant_group", "id")
    return O.top_by(members, ["book_id", "variant_group"], [F.col("id")], 2).select(F.col("id").alias("character_id"))


def variant_removal_segments(spark, d):
    m = Model(spark, d)
    moved, _ = C.remove_variants(m.characters, m.segments, _removals(m))
    return moved.select("chapter_id", "idx", "character_id", "audio_path")


def variant_removal_cast(spark, d):
    m = Model(spark, d)
    _, rest = C.remove_variants(m.characters, m.segments, _removals(m))
    return rest.select("id", "name", "variant_group", "variant_label", _join("aliases").alias("aliases"))


REMOVALS = {
    "sib": """SELECT c.id, c.book_id, c.variant_group, count(s.id) AS sibling_count, arg_min(s.id, (-s.dialogue_share, s.name, s.id)) AS sibling_id
        FROM characters c LEFT JOIN characters s ON s.book_id = c.book_id AND s.variant_group = c.variant_group AND s.id <> c.id WHERE c.variant_group IS NOT NULL GROUP BY 1, 2, 3""",
    "cmd": """SELECT id FROM characters WHERE variant_group IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, variant_group ORDER BY id) <= 2""",
    "heads": """SELECT book_id, variant_group, count(*) FILTER (WHERE id NOT IN (SELECT id FROM cmd)) AS stay,
        arg_min(id, (-dialogue_share, name, id)) FILTER (WHERE id NOT IN (SELECT id FROM cmd)) AS strong, arg_min(id, (-dialogue_share, name, id)) AS any_one
        FROM characters WHERE variant_group IS NOT NULL GROUP BY 1, 2""",
    "gone": """SELECT c.id, c.book_id, c.variant_group, coalesce(h.strong, h.any_one) AS sibling_id, greatest(h.stay, 1) AS sibling_count
        FROM characters c JOIN heads h ON h.book_id = c.book_id AND h.variant_group = c.variant_group WHERE c.id IN (SELECT id FROM cmd) AND c.id <> coalesce(h.strong, h.any_one)""",
}


def reconciled_assignments(spark, d):
    m = Model(spark, d)
    _, kept, _ = C.reconcile(_old_cast(m), m.assignments, m.characters)
    return kept


def reconciled_profiles(spark, d):
    m = Model(spark, d)
    _, _, profiles = C.reconcile(_old_cast(m), m.assignments, m.characters)
    return profiles


def repointed_segments(spark, d):
    m = Model(spark, d)
    moves, _, _ = C.reconcile(_old_cast(m), m.assignments, m.characters)
    return C.repoint_segments(m.segments, moves).select("chapter_id", "idx", "character_id", "flagged")


def cast_name_lists(spark, d):
    m = Model(spark, d)
    return C.name_lists(m.books, m.characters).select("book_id", "page", F.md5("names").alias("names_hash"))


def pov_characters(spark, d):
    m = Model(spark, d)
    answers = m.chapters.select(
        F.col("id").alias("chapter_id"), "book_id", pick(["high", "medium", "low"], F.col("id")).alias("confidence"),
        F.when(F.col("id") % 4 == 0, " Narrator").otherwise(F.concat(F.lit(" hero "), (F.col("id") % 50).cast("string"))).alias("narrator"))
    return C.pov_character(answers, C.name_dictionary(m.characters)).select("chapter_id", "character_id")


def voice_override(spark, d):
    m = Model(spark, d)
    return V.voice_overrides(_override_commands(m), m.characters, m.assignments, m.voices).select(
        "character_id", "reject_reason", "voice_id", "voice_name", F.round("speed", 4).alias("speed"), "rationale")


def _override_commands(m):
    c = F.col("id")
    return m.characters.filter(c % 3 == 1).select(
        F.when(c % 7 == 0, -c).otherwise(c).alias("character_id"),
        F.when(c % 4 != 0, F.concat(F.lit("v"), (c % 28).cast("string"), F.lit("-"), (c % 12).cast("string"))).alias("new_voice_id"),
        F.when(c % 8 > 3, 0.9).alias("new_speed"))


OVERRIDES = {"cmds": """SELECT CASE WHEN id % 7 = 0 THEN -id ELSE id END AS character_id,
    CASE WHEN id % 4 <> 0 THEN 'v' || (id % 28) || '-' || (id % 12) END AS new_voice_id, CASE WHEN id % 8 > 3 THEN 0.9 END AS new_speed FROM characters WHERE id % 3 = 1"""}


def _requests(m):
    n = F.col("s_suppkey")
    return m.table("supplier").select(
        n.alias("request_id"), pick(["Male", "female", "neutral", None, ""], n).alias("gender"), pick([" Irish", None, "i", "", "brit"], F.floor(n / 5)).alias("accent"),
        pick(["young", None, "OLD", ""], n).alias("age"), pick([None, "voice", "narrative", "tone 1", "ring"], F.floor(n / 3)).alias("query"),
        F.when(n % 3 == 0, (n % 40).cast("int")).alias("limit"))


REQUESTS = f"""SELECT s_suppkey AS request_id, lower({spick(["Male", "female", "neutral", None, ""], 's_suppkey')}) AS g, lower(trim({spick([" Irish", None, "i", "", "brit"], 's_suppkey // 5')})) AS a,
   lower({spick(["young", None, "OLD", ""], 's_suppkey')}) AS age, {spick([None, "voice", "narrative", "tone 1", "ring"], 's_suppkey // 3')} AS q,
   least(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 40 ELSE 14 END, 25) AS lim FROM supplier"""


def voice_shortlist(spark, d):
    m = Model(spark, d)
    return V.search_catalog(_requests(m), m.voices).select("request_id", F.col("rank").cast("long"), "id")


def voice_text_search(spark, d):
    m = Model(spark, d)
    hit = V.text_matches(F.lit("Ir"), "name", "gender", "age", "accent", "descriptive", "description")
    return m.voices.filter(hit).select("id", "name")


def _search_hits(m, live: bool):
    q = F.explode_outer(F.array(*[F.lit(x) for x in ["ir", "ring", "old"]]))
    base = m.table("part") if live else None
    if live:
        return base.select(
            F.concat(F.lit("v"), (F.col("p_partkey") % 60).cast("string"), F.lit("-"), (F.col("p_partkey") % 13).cast("string")).alias("id"),
            F.col("p_partkey").alias("ordinal"), q.alias("query"))
    return m.voices.select("id", "ordinal", "name", q.alias("query")).filter(F.lower("name").contains(F.col("query"))).drop("name")


def merged_voice_search(spark, d):
    m = Model(spark, d)
    return V.merge_search(_search_hits(m, False), _search_hits(m, True)).select("query", F.col("rank").cast("long"), "id")


def _voice_json(m, account: bool):
    k = F.col("p_partkey")
    keep = lambda c, n: F.when(k % n != 0, c)
    if account:
        return m.table("part").filter(k % 3 == 0).select(k.alias("ordinal"), F.to_json(F.struct(
            F.concat(F.lit("v"), (k % 700).cast("string")).alias("voiceId"), keep(F.col("p_name"), 4).alias("name"), F.lower("p_type").alias("category"),
            F.create_map(F.lit("gender"), F.lit("male"), F.when(k % 2 == 0, "use_case").otherwise("usecase"), F.lit("story"),
                         F.when(k % 5 == 0, "descriptive").otherwise("description"), F.col("p_brand")).alias("labels"))).alias("json"))
    return m.table("part").select(k.alias("ordinal"), F.to_json(F.struct(
        F.when(k % 2 == 0, F.concat(F.lit("v"), (k % 900).cast("string"))).alias("voiceId"), F.when(k % 2 == 1, F.concat(F.lit("v"), (k % 900).cast("string"))).alias("voice_id"),
        F.when(k % 4 == 0, "").otherwise(F.col("p_name")).alias("name"), F.when(k % 5 == 0, "").otherwise(F.col("p_brand")).alias("description"),
        F.when(k % 3 == 0, "").otherwise(F.lit("irish")).alias("accent"), F.when(k % 6 == 0, "").otherwise("x").alias("useCase"), F.lit("y").alias("use_case"))).alias("json"))


def catalog_ingest(spark, d):
    m = Model(spark, d)
    merged = V.merge_catalog(V.parse_shared_voices(_voice_json(m, False)), V.parse_account_voices(_voice_json(m, True)))
    return merged.select("id", "name", "category", "description", "gender", "accent", "descriptive", "use_case")


CATALOG = {
    "shared_v": """SELECT p_partkey AS ordinal, 'v' || (p_partkey % 900) AS id, CASE WHEN p_partkey % 4 = 0 THEN 'v' || (p_partkey % 900) ELSE p_name END AS name, 'shared' AS category,
        CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS description, CAST(NULL AS VARCHAR) AS gender, CASE WHEN p_partkey % 3 <> 0 THEN 'irish' END AS accent,
        CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS descriptive, CASE WHEN p_partkey % 6 = 0 THEN 'y' ELSE 'x' END AS use_case, 0 AS src FROM part""",
    "account_v": """SELECT p_partkey AS ordinal, 'v' || (p_partkey % 700) AS id, CASE WHEN p_partkey % 4 = 0 THEN 'v' || (p_partkey % 700) ELSE p_name END AS name, lower(p_type) AS category,
        CAST(NULL AS VARCHAR) AS description, 'male' AS gender, CAST(NULL AS VARCHAR) AS accent, p_brand AS descriptive, 'story' AS use_case, 1 AS src FROM part WHERE p_partkey % 3 = 0""",
    "both_v": "SELECT * FROM shared_v UNION ALL SELECT * FROM account_v",
}

_AGEVAR = lambda k: (f"struct_pack(label := '{S.VARIANT_LABELS[k]}', age_range := '{S.VARIANT_LABELS[k]}', style := CASE WHEN (id + {k}) % 2 = 0 THEN NULL ELSE 'style {k}' END, "
                     f"share := dialogue_share + {k}, quote := CASE WHEN (id + {k}) % 3 = 0 THEN NULL ELSE left(repeat('word ', CAST(id % 90 AS INT)), 300) END)")
DEDUPE = lambda arr, own: f"""(SELECT coalesce(string_agg(a, '|' ORDER BY p), '') FROM (SELECT a, min(p) AS p FROM (SELECT {trim_ws('x')} AS a, p FROM (SELECT unnest({arr}) AS x, generate_subscripts({arr}, 1) AS p))
   WHERE a <> '' AND lower(a) <> {key(own)} GROUP BY lower(a), a QUALIFY row_number() OVER (PARTITION BY lower(a) ORDER BY min(p)) = 1))"""

QUERIES = {
    "name_dictionary": (name_dictionary, Q("SELECT * FROM dict")),
    "speaker_resolution": (speaker_resolution, Q(
        f"SELECT m.book_id, m.name AS speaker, d.character_id, count(*) AS n FROM mentions m LEFT JOIN dict d ON d.book_id = m.book_id AND d.key = {key('m.name')} GROUP BY 1, 2, 3")),
    "old_to_new_cast": (old_to_new_cast, Q("SELECT * FROM moves")),
    "uncast_characters": (uncast_characters, Q("SELECT book_id, id, name FROM characters WHERE id NOT IN (SELECT character_id FROM assignments)")),
    "segment_voices": (segment_voices, Q("""SELECT s.chapter_id, s.idx, coalesce(o.voice_id, n.voice_id) AS voice_id, CASE WHEN o.voice_id IS NOT NULL THEN o.seed ELSE n.seed END AS seed
        FROM segs s LEFT JOIN own o ON o.book_id = s.book_id AND o.character_id = s.character_id LEFT JOIN narr n ON n.book_id = s.book_id""")),
    "missing_voice_names": (missing_voice_names, Q("""SELECT DISTINCT book_id, 'Narrator' AS name FROM segs WHERE book_id NOT IN (SELECT book_id FROM narr)
        UNION SELECT s.book_id, coalesce(c.name, '?') FROM segs s LEFT JOIN own o ON o.book_id = s.book_id AND o.character_id = s.character_id
          LEFT JOIN characters c ON c.book_id = s.book_id AND c.id = s.character_id
        WHERE s.kind <> 'sfx' AND s.character_id IS NOT NULL AND o.voice_id IS NULL AND s.book_id NOT IN (SELECT book_id FROM narr)""")),
    "best_voice": (best_voice, Q("SELECT id, CAST(tier AS BIGINT) AS tier, voice_id FROM ranked")),
    "distinct_voices": (distinct_voices, QR("SELECT book_id, id, voice_id FROM walk", {"held": "SELECT id, NULL AS fixed FROM characters", **WALK})),
    "resolved_picks": (resolved_picks, Q("SELECT id, v.id AS voice_id FROM resolved")),
    "pick_validation": (pick_validation, Q("SELECT id, problem FROM judged")),
    "assignment_settings": (assignment_settings, QR("""SELECT j.id, w.voice_id,
        CASE WHEN problem IS NULL THEN rationale ELSE 'Auto-matched by gender/age (model pick was ' || problem || ')' END AS rationale,
        round(CASE WHEN problem IS NULL THEN pick_stability WHEN is_narrator THEN 0.65 ELSE 0.5 END::DOUBLE, 4) AS stability, 0.75 AS similarity_boost, 0.0 AS style,
        round(CASE WHEN problem IS NULL THEN pick_speed ELSE 1.0 END::DOUBLE, 4) AS speed FROM judged j JOIN walk w ON w.id = j.id""",
        {"held": "SELECT id, CASE WHEN problem IS NULL THEN v.id END AS fixed FROM judged", **WALK})),
    "age_and_accent_classes": (age_and_accent_classes, Q(f"SELECT id, {AGE_TEXT('age_range')} AS age_bucket, {ACCENT('accent_hint')} AS accent, {ACCENT('heritage')} AS heritage FROM characters")),
    "voice_classes": (voice_classes, Q("SELECT id, va AS age_bucket, vf AS accent FROM vclass")),
    "variant_siblings": (variant_siblings, Q("SELECT id, sibling_id, sibling_count FROM sib", REMOVALS)),
    "cast_voice_list": (cast_voice_list, Q("""SELECT coalesce(u.id, v.id) AS id, CASE WHEN v.id IS NOT NULL THEN v.name ELSE u.stub END AS name, CASE WHEN v.id IS NOT NULL THEN category ELSE 'cast' END AS category,
        gender, age, accent, u.id IS NOT NULL AS is_cast FROM (SELECT voice_id AS id, arg_min(voice_name, character_id) AS stub FROM assignments GROUP BY 1) u FULL JOIN voices v ON v.id = u.id""")),
    "voices_not_cast": (voices_not_cast, Q("SELECT id FROM voices WHERE id NOT IN (SELECT voice_id FROM assignments)")),
    "already_cast": (already_cast, Q("""SELECT c.id, c.name, a.voice_name, v.gender AS v_gender, v.age AS v_age, v.accent AS v_accent
        FROM characters c JOIN assignments a ON a.character_id = c.id AND a.overridden LEFT JOIN voices v ON v.id = a.voice_id""")),
    "accent_list": (accent_list, Q("SELECT DISTINCT accent, length(accent) AS n FROM voices WHERE accent <> ''")),
    "group_rank_order": (group_rank_order, Q("""SELECT id, coalesce(variant_group, name) AS group_key,
        max(dialogue_share) OVER (PARTITION BY book_id, coalesce(variant_group, name)) AS group_rank FROM characters""")),
    "cast_order_and_batches": (cast_order_and_batches, Q("SELECT id, position, position // 8 AS batch FROM ordered_cast")),
    "measured_dialogue_share": (measured_dialogue_share, Q("""SELECT book_id, character_id, CAST(sum(length(text)) AS BIGINT) AS chars,
        round(sum(length(text)) / sum(sum(length(text))) OVER (PARTITION BY book_id), 9) AS share FROM segs WHERE kind = 'dialogue' AND character_id IS NOT NULL GROUP BY 1, 2""")),
    "mention_merge": (mention_merge, Q(f"""SELECT book_id, key, cast_rank, mention_count, name, aliases, gender, quotes FROM (
        SELECT c.*, row_number() OVER (PARTITION BY c.book_id ORDER BY mention_count DESC, c.key) AS cast_rank, g.gender, q.quotes, a.aliases
        FROM (SELECT book_id, {key('name')} AS key, count(*) AS mention_count, min(name) AS name FROM mentions GROUP BY 1, 2) c
        JOIN (SELECT book_id, key, arg_min(gender_hint, (-n, gender_hint)) AS gender FROM (SELECT book_id, {key('name')} AS key, gender_hint, count(*) AS n FROM mentions GROUP BY 1, 2, 3) GROUP BY 1, 2) g USING (book_id, key)
        JOIN (SELECT book_id, key, string_agg(a, '|' ORDER BY a) AS aliases FROM (SELECT DISTINCT book_id, {key('name')} AS key, aliases[1] AS a FROM mentions) GROUP BY 1, 2) a USING (book_id, key)
        JOIN (SELECT book_id, key, string_agg(quote, '|' ORDER BY r) AS quotes FROM (SELECT book_id, {key('name')} AS key, quote, row_number() OVER (PARTITION BY book_id, {key('name')} ORDER BY chunk_idx, quote) AS r FROM mentions) WHERE r <= 5 GROUP BY 1, 2) q USING (book_id, key)
      )""")),
    "alias_components": (alias_components, with_model("""SELECT book_id, n AS key, min(r) AS person FROM reach GROUP BY 1, 2""", {
        "am": """SELECT CAST(c_nationkey AS BIGINT) AS book_id, 'name ' || c_custkey AS n, unnest(CASE WHEN c_custkey % 3 = 0 THEN ['name ' || (c_custkey // 2), 'nick ' || (c_custkey % 40)]
             ELSE ['title ' || (c_custkey // 100)] END) AS a FROM customer""",
        "link": "SELECT book_id, n AS u, a AS v FROM am UNION SELECT book_id, a, n FROM am UNION SELECT book_id, n, n FROM am UNION SELECT book_id, a, a FROM am",
        "reach": "SELECT book_id, u AS n, v AS r FROM link UNION SELECT k.book_id, r.n, k.v FROM reach r JOIN link k ON k.book_id = r.book_id AND k.u = r.r"}, recursive=True)),
    "alias_lists": (alias_lists, Q(f"SELECT id, {DEDUPE('z', 'name')} AS aliases FROM (SELECT id, name, list_concat(aliases, [upper(name), ' Alias 3 ']) AS z FROM characters)")),
    "age_variant_expansion": (age_variant_expansion, Q(f"""SELECT source_id, nm AS name, {DEDUPE('z', 'nm')} AS aliases, age_range, speech_style, quotes, dialogue_share, variant_group, variant_label FROM (
        SELECT id AS source_id, CASE WHEN v IS NULL THEN name ELSE name || ' (' || v.label || ')' END AS nm, CASE WHEN v IS NULL THEN aliases ELSE list_prepend(name, aliases) END AS z,
          CASE WHEN v IS NULL THEN age_range ELSE v.age_range END AS age_range, coalesce(v.style, 'plain') AS speech_style, coalesce(v.quote, 'own ' || id) AS quotes,
          CASE WHEN v IS NULL THEN dialogue_share ELSE v.share END AS dialogue_share, CASE WHEN v IS NOT NULL THEN name END AS variant_group, v.label AS variant_label
        FROM (SELECT *, unnest(CASE WHEN id % 4 >= 2 THEN [{', '.join(_AGEVAR(k) for k in range(3))}][1:CAST(id % 4 AS INT)] ELSE [NULL] END) AS v FROM characters))""")),
    "variant_split": (variant_split, Q(f"""SELECT source_id, CASE WHEN reject_reason IS NULL THEN CASE WHEN i = 1 THEN CAST(source_id AS VARCHAR) ELSE sha256(source_id || '|' || l) END END AS character_id,
          nm AS variant_name, l AS variant_label, CASE WHEN nm IS NULL THEN {DEDUPE('z', "''")} ELSE {DEDUPE('z', 'nm')} END AS aliases,
          CASE WHEN i = 1 THEN '8' WHEN i = 3 THEN '70s' ELSE age_range END AS age_range, CASE WHEN i = 1 THEN dialogue_share WHEN i > 1 THEN 0 END AS dialogue_share, reject_reason
        FROM (SELECT *, CASE WHEN l IS NOT NULL THEN name || ' (' || l || ')' END AS nm, list_prepend(name, aliases) AS z FROM (
          SELECT *, unnest(CASE WHEN reject_reason IS NULL THEN labels ELSE [NULL] END) AS l, unnest(CASE WHEN reject_reason IS NULL THEN generate_series(1, len(labels)) ELSE [NULL] END) AS i FROM (
            SELECT *, CASE WHEN is_narrator THEN 'not_splittable' WHEN variant_group IS NOT NULL THEN 'already_variant'
               WHEN len(labels) < 2 OR list_contains(labels, '') OR len(list_distinct(labels)) <> len(labels) THEN 'bad_variants' END AS reject_reason FROM (
              SELECT id AS source_id, *, list_transform(['child', 'adult', lower({spick(["Elderly", "adult", ""], 'id')})][1:CAST(id % 5 AS INT)], lambda x: x) AS labels FROM characters WHERE id % 2 = 0))))""")),
    "variant_removal_segments": (variant_removal_segments, Q("""SELECT chapter_id, idx, coalesce(g.sibling_id, character_id) AS character_id,
        CASE WHEN g.id IS NULL THEN audio_path END AS audio_path FROM segments s LEFT JOIN gone g ON g.id = s.character_id""", REMOVALS)),
    "variant_removal_cast": (variant_removal_cast, Q("""SELECT c.id, CASE WHEN g.sibling_id IS NOT NULL THEN c.variant_group ELSE c.name END AS name, CASE WHEN g.sibling_id IS NULL THEN c.variant_group END AS variant_group,
        CASE WHEN g.sibling_id IS NULL THEN c.variant_label END AS variant_label,
        array_to_string(CASE WHEN g.sibling_id IS NOT NULL THEN list_filter(c.aliases, lambda a: lower(trim(a)) <> lower(c.variant_group)) ELSE c.aliases END, '|') AS aliases
        FROM characters c LEFT JOIN (SELECT DISTINCT sibling_id, variant_group FROM gone WHERE sibling_count = 1) g ON g.sibling_id = c.id WHERE c.id NOT IN (SELECT id FROM gone)""", REMOVALS)),
    "reconciled_assignments": (reconciled_assignments, Q("""SELECT new_id, voice_id, voice_name, overridden, character_id AS old_id FROM assignments a JOIN moves m ON m.old_id = a.character_id
        QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY overridden DESC, character_id) = 1""")),
    "reconciled_profiles": (reconciled_profiles, Q("""SELECT n.new_id, arg_max(o.age_range, o.id) AS age_range FROM old_cast o JOIN (
          SELECT book_id, lower(name) AS key, arg_max(id, (-dialogue_share, id)) AS new_id FROM characters WHERE NOT is_narrator GROUP BY 1, 2) n
        ON n.book_id = o.book_id AND n.key = lower(o.name) WHERE o.profile_edited AND NOT o.is_narrator GROUP BY 1""")),
    "repointed_segments": (repointed_segments, Q("""SELECT chapter_id, idx, m.new_id AS character_id, flagged OR (character_id IS NOT NULL AND m.new_id IS NULL) AS flagged
        FROM segments s LEFT JOIN moves m ON m.old_id = s.character_id""")),
    "cast_name_lists": (cast_name_lists, Q("""SELECT b.id AS book_id, coalesce(page, 0) AS page, md5(coalesce(string_agg(e, chr(10) ORDER BY pos), '(none listed — use "narrator")')) AS names_hash
        FROM books b LEFT JOIN (SELECT book_id, pos, pos // 1000 AS page, name || ' (aka ' || array_to_string(aliases, ', ') || ')' || CASE WHEN variant_group IS NOT NULL THEN ' — ' || variant_group || ' as: ' || variant_label ELSE '' END AS e
          FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY dialogue_share DESC, name, id) - 1 AS pos FROM characters WHERE NOT is_narrator)) c ON c.book_id = b.id GROUP BY 1, 2""")),
    "pov_characters": (pov_characters, Q(f"""SELECT c.id AS chapter_id, d.character_id FROM chapters c LEFT JOIN dict d ON d.book_id = c.book_id AND c.id % 3 <> 2 AND c.id % 4 <> 0 AND d.key = 'hero ' || (c.id % 50)""")),
    "voice_override": (voice_override, Q("""SELECT m.character_id, CASE WHEN new_voice_id IS NULL AND new_speed IS NULL THEN 'nothing_to_update' WHEN c.id IS NULL THEN 'not_found'
          WHEN coalesce(new_voice_id, a.voice_id) IS NULL THEN 'no_voice' WHEN new_voice_id IS NOT NULL AND v.id IS NULL THEN 'voice_not_found' END AS reject_reason,
        coalesce(new_voice_id, a.voice_id) AS voice_id, CASE WHEN new_voice_id IS NOT NULL THEN v.name ELSE coalesce(a.voice_name, a.voice_id) END AS voice_name,
        round(coalesce(new_speed, a.speed, 1.0)::DOUBLE, 4) AS speed, CASE WHEN a.voice_id IS NOT NULL THEN a.rationale ELSE 'Manually selected' END AS rationale
        FROM cmds m LEFT JOIN characters c ON c.id = m.character_id LEFT JOIN assignments a ON a.character_id = m.character_id LEFT JOIN voices v ON v.id = m.new_voice_id""", OVERRIDES)),
    "voice_shortlist": (voice_shortlist, Q(f"""SELECT request_id, rank, id FROM (SELECT r.request_id, r.lim, v.id, row_number() OVER (PARTITION BY r.request_id ORDER BY v.ordinal, v.id) AS rank
        FROM reqs r JOIN vclass v ON (coalesce(g, '') IN ('', 'neutral') OR v.vg = '' OR lower(v.vg) = g) AND (coalesce(a, '') = '' OR contains(lower(coalesce(v.accent, '')), a))
          AND (coalesce(r.age, '') = '' OR v.va IS NULL OR v.va = r.age)
          AND (q IS NULL OR contains(lower(v.name || ' ' || coalesce(descriptive, '') || ' ' || coalesce(description, '') || ' ' || coalesce(use_case, '') || ' ' || coalesce(v.accent, '')), q))) WHERE rank <= lim""", {"reqs": REQUESTS})),
    "voice_text_search": (voice_text_search, Q("""SELECT id, name FROM voices WHERE contains(lower(name), 'ir') OR contains(lower(gender), 'ir') OR contains(lower(age), 'ir')
        OR contains(lower(accent), 'ir') OR contains(lower(descriptive), 'ir') OR contains(lower(description), 'ir')""")),
    "merged_voice_search": (merged_voice_search, Q("""SELECT query, row_number() OVER (PARTITION BY query ORDER BY src, ordinal, id) AS rank, id FROM (
          SELECT query, id, src, ordinal FROM hits QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY src, ordinal) = 1)
        QUALIFY row_number() OVER (PARTITION BY query ORDER BY src, ordinal, id) <= 80""", {
        "hits": """SELECT id, ordinal, query, 0 AS src FROM voices, (SELECT unnest(['ir', 'ring', 'old']) AS query) WHERE contains(lower(name), query)
          UNION ALL SELECT 'v' || (p_partkey % 60) || '-' || (p_partkey % 13), p_partkey, query, 1 FROM part, (SELECT unnest(['ir', 'ring', 'old']) AS query)"""})),
    "catalog_ingest": (catalog_ingest, Q("""SELECT id, name, category, description, gender, accent, descriptive, use_case FROM both_v
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY src DESC, ordinal DESC) = 1""", CATALOG)),
}
