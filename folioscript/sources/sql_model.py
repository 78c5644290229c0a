"""ANSI SQL twin of :mod:`folioscript.sources.model`, used for result checks."""

from __future__ import annotations

import re

from folioscript.sources import samples as S


def lst(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values, idx: str) -> str:
    return f"({lst(values)})[CAST(({idx}) % {len(values)} AS INT) + 1]"


WS = r"\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def trim_ws(e: str) -> str:
    return f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def collapse_ws(e: str) -> str:
    return trim_ws(f"regexp_replace({e}, '[{WS}]+', ' ', 'g')")


def key(e: str) -> str:
    return f"lower({trim_ws(e)})"


_JOB_TYPE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.JOB_TYPES.items()) + " END"

CTES: dict[str, str] = {
    "books": f"""SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title,
        CASE WHEN n_nationkey % 4 <> 0 THEN 'Author ' || n_nationkey END AS author,
        {pick(S.BOOK_STATUS, 'n_nationkey')} AS status, {pick(S.STAGES, 'n_nationkey')} AS pipeline_stage,
        {pick(S.MODELS, 'n_nationkey')} AS render_model, n_nationkey % 2 = 0 AS sfx_enabled,
        CASE WHEN n_nationkey % 5 = 0 THEN 'book error ' || n_nationkey END AS error FROM nation""",
    "chapters": f"""SELECT o_orderkey AS id, o_custkey % 25 AS book_id, o_orderkey AS idx,
        CASE WHEN o_orderkey % 29 = 0 THEN 'Front Matter'
             WHEN o_orderkey % 7 = 0 THEN 'CHAPTER ' || {pick(S.ROMANS, 'o_orderkey')} || ' — The / Road: ' || o_orderkey
             ELSE 'Chapter ' || o_orderkey END AS title,
        CAST(floor(o_totalprice) AS BIGINT) AS char_count,
        CASE WHEN o_orderstatus = 'F' THEN 'ready'
             WHEN o_orderstatus = 'O' THEN {pick(["pending", "scripted", "stale"], 'o_orderkey')}
             ELSE {pick(["scripting", "generating", "scripted", "error"], 'o_orderkey')} END AS status,
        CASE WHEN o_orderstatus = 'F' THEN 'chapters/' || o_orderkey || '.mp3'
             WHEN o_orderkey % 3 = 2 THEN 'chapters/' || o_orderkey || '-old.mp3' END AS audio_path,
        CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 9 AS DOUBLE) END AS intro_duration_sec,
        CASE WHEN o_orderkey % 13 = 0 THEN 'chapter error ' || o_orderkey END AS error,
        o_orderdate AS created_at FROM orders""",
    "jobs": f"""SELECT o_orderkey AS id, {_JOB_TYPE} AS type, o_custkey % 25 AS book_id,
        CASE WHEN o_orderkey % 19 <> 0 THEN o_orderkey - o_orderkey % 3 END AS chapter_id,
        CASE WHEN o_orderkey % 17 = 0 THEN 'failed' WHEN o_orderkey % 23 = 0 THEN 'cancelled'
             WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'running' END AS status,
        CAST(floor(CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 101) / 100) AS BIGINT) AS done,
        CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS total,
        CASE WHEN o_orderkey % 17 = 0 THEN 'job error ' || o_orderkey END AS error,
        CASE WHEN o_orderkey % 3 <> 0 THEN 'step ' || (o_orderkey % 101) END AS note,
        CASE WHEN o_orderkey % 5 <> 0 THEN 'run-' || (o_orderkey % 1000) END AS run_id,
        CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS created_s,
        CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 + o_orderkey % 301 AS updated_s FROM orders""",
    "segments": f"""SELECT chapter_id * 8 + idx AS id, chapter_id, idx, kind,
        'Line ' || pk || ' of ' || sk || {pick(S.ENDINGS, 'pk')} AS text,
        CASE WHEN kind = 'dialogue' THEN pk WHEN kind = 'narration' AND pk % 9 = 0 THEN sk END AS character_id,
        CASE WHEN pk % 50 <> 0 THEN q END AS duration_sec,
        CASE WHEN pk % 50 <> 0 THEN 'segments/' || pk || '.mp3' END AS audio_path,
        CASE WHEN pk % 7 <> 0 THEN d END AS pause_before_sec, pk % 11 = 0 AS flagged,
        CASE WHEN kind = 'dialogue' AND pk % 4 = 0 THEN {pick([*S.DELIVERIES, "mumbled"], 'pk')} END AS delivery,
        CASE WHEN kind = 'sfx' AND pk % 3 <> 0 THEN (sk % 60) / 10.0 END AS sfx_duration_sec,
        (pk % 30) / 100.0 AS tail_sec, (sk % 20) / 100.0 AS lead_sec, pk % 5 = 0 AS para_break_before,
        pk % 3 = 0 AS space_before, idx = 0 AND kind = 'narration' AND pk % 2 = 0 AS is_title
        FROM (SELECT l_orderkey AS chapter_id, CAST(l_linenumber - 1 AS BIGINT) AS idx, max(l_quantity) AS q,
                     max(l_discount) AS d, min(l_suppkey) AS sk, min(l_partkey) AS pk,
                     CASE min(l_returnflag) WHEN 'A' THEN 'dialogue' WHEN 'N' THEN 'narration' ELSE 'sfx' END AS kind
              FROM lineitem GROUP BY 1, 2)""",
    "timed_chapters": """SELECT c.*, CASE WHEN status IN ('ready', 'stale') THEN round((total + CASE WHEN status = 'stale' THEN 0.25 ELSE 0 END)::DOUBLE, 6) END AS duration_sec FROM chapters c
        JOIN (SELECT chapter_id, sum(coalesce(duration_sec, 0.0) + coalesce(pause_before_sec, 0.0)) AS total FROM segments GROUP BY 1) t ON t.chapter_id = c.id""",
    "characters": f"""SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS book_id,
        CASE WHEN c_custkey = nid THEN 'Narrator' ELSE 'Hero ' || (c_custkey % 37) END AS name,
        [' hero ' || (c_custkey * 7 % 53), 'Alias ' || (c_custkey % 11), '', 'ALIAS ' || (c_custkey % 11)] AS aliases,
        CASE WHEN c_custkey = nid THEN 'narrator' WHEN c_custkey % 3 = 0 THEN 'major' ELSE 'minor' END AS role,
        CAST(floor(c_acctbal + 1000) AS BIGINT) AS dialogue_share, c_custkey = nid AS is_narrator,
        CASE WHEN c_custkey % 5 = 0 AND c_custkey <> nid THEN 'Group ' || (c_custkey % 20) END AS variant_group,
        CASE WHEN c_custkey % 5 = 0 AND c_custkey <> nid THEN {pick(S.VARIANT_LABELS, 'c_custkey')} END AS variant_label,
        {pick(S.GENDERS, 'c_custkey')} AS gender, {pick(S.AGE_RANGES, 'c_custkey')} AS age_range,
        {pick(S.ACCENT_HINTS, 'c_custkey')} AS accent_hint, {pick(S.HERITAGES, 'c_custkey')} AS heritage,
        c_custkey % 6 = 0 AS profile_edited
        FROM (SELECT *, min(c_custkey) OVER (PARTITION BY c_nationkey) AS nid FROM customer)""",
    "voices": f"""SELECT 'v' || b || '-' || s || CASE WHEN ordinal = min(ordinal) OVER (PARTITION BY b, s) THEN '' ELSE '-' || ordinal END AS id, ordinal,
        array_to_string(list_transform(string_split(n, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' ' || (b % 9) AS name,
        lower(t) AS category, 'A ' || n || ' voice' AS description, {pick(S.VOICE_GENDERS, 's')} AS gender,
        CASE WHEN b % 5 <> 0 THEN {pick(S.VOICE_AGES, 's // 4')} END AS age, {pick(S.VOICE_ACCENTS, 'b')} AS accent,
        CASE WHEN s % 5 <> 0 THEN 'tone ' || s END AS descriptive, {pick(S.USE_CASES, 'b + s')} AS use_case
        FROM (SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS b, CAST(p_size % 12 AS BIGINT) AS s,
                     p_partkey AS ordinal, p_name AS n, p_type AS t FROM part)""",
    "assignments": """SELECT c_custkey AS character_id, 'v' || (c_custkey % 27) || '-' || (c_custkey * 5 % 12) AS voice_id,
        'Voice ' || (c_custkey % 27) AS voice_name, (c_custkey % 101) / 100.0 AS stability, 0.75 AS similarity_boost,
        (c_custkey % 50) / 100.0 AS style, 0.8 + (c_custkey % 40) / 100.0 AS speed, c_custkey * 7919 % 2147483647 AS seed,
        c_custkey % 7 = 0 AS overridden, 'because ' || (c_custkey % 13) AS rationale FROM customer WHERE c_custkey % 5 <> 2""",
    "docs": """SELECT doc_id, source || '_' || doc_id || '--draft.txt' AS source_file_name,
        replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents""",
    "headed": f"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
        CASE WHEN (i - 1) % 8 = 0 AND doc_id % 4 <> 3 THEN
          CASE ((i - 1) // 8) % 5
            WHEN 0 THEN 'CHAPTER ' || {pick(S.ROMANS, '(i - 1) // 8')} || '.' || chr(10) || chr(10) || 'The Road to ' || ((i - 1) // 8)
            WHEN 1 THEN 'Chapter ' || ((i - 1) // 8) || ' :'
            WHEN 2 THEN 'Prologue'
            WHEN 3 THEN {pick(S.ROMANS, '(i - 1) // 8')} || '.'
            ELSE 'Not a heading ' || ((i - 1) // 8) END || chr(10) || chr(10) || l
        ELSE l END), chr(10) || chr(10)) AS text FROM documents""",
    "quoted": f"""SELECT doc_id AS chapter_id, doc_id % 25 AS book_id,
        CASE WHEN doc_id % 10 = 0 THEN 'Section 3' ELSE 'CHAPTER ' || {pick(S.ROMANS, 'doc_id')} || ' — The Road' END AS title,
        array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
          CASE WHEN (i - 1) % 3 <> 1 THEN l
               WHEN (i - 1) % 21 = 10 THEN op || l
               WHEN (i - 1) % 6 = 4 THEN op || substring(l, 1, 20) || cl || op || substring(l, 21) || cl
               ELSE op || l || cl || ' said Hero ' || ((i - 1) % 40) || '.' END), chr(10) || chr(10)) AS text
        FROM (SELECT *, CASE WHEN doc_id % 4 < 2 THEN '"' WHEN doc_id % 4 = 2 THEN '“' ELSE '‘' END AS op,
                     CASE WHEN doc_id % 4 < 2 THEN '"' WHEN doc_id % 4 = 2 THEN '”' ELSE '’' END AS cl FROM documents)""",
}


def with_model(sql: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix ``sql`` with the CTEs it names, directly or through other CTEs."""
    pool = {**CTES, **(extra or {})}
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in pool:
            if name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
                seen.add(name)
                visit(pool[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = "WITH RECURSIVE " if recursive else "WITH "
    # Recursive steps read their inputs once per round, so those are kept as results.
    keep = lambda n: " MATERIALIZED" if recursive and not re.search(rf"\bFROM {n}\b", pool[n]) else ""
    return head + ",\n".join(f"{n} AS{keep(n)} ({pool[n]})" for n in needed) + "\n" + sql
