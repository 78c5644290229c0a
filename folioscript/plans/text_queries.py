"""Queries over text, chunks and chapters, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscript.functions import domains as D
from folioscript.functions import js
from folioscript.functions import text as X
from folioscript.operators import chapters as CH
from folioscript.operators import pack as P
from folioscript.operators import quality as Q
from folioscript.sources.model import Model
from folioscript.sources.samples import MODELS
from folioscript.sources.sql_model import WS, collapse_ws, trim_ws, with_model

sql_re = lambda pattern: pattern.replace(js.WS, WS).replace("'", "''")


def pack_sql(items: str, p: P.Packing, limit: int | str | None = None, text_cte: str = "docs") -> dict[str, str]:
    """CTEs that run a packing as an ordered recursion; ``packed`` holds (doc_id, pieces). ``limit`` may be an expression over doc_id."""
    lim = limit or p.limit
    join = "''" if p.joiner == "" else "(" + " || ".join("chr(10)" if ch == "\n" else f"'{ch}'" for ch in p.joiner) + ")"
    placed = f"CASE WHEN cur = '' OR length(cur) + length(t) + {p.test_sep} > {lim} THEN t ELSE cur || {join} || t END"
    before = f"CASE WHEN cur <> '' AND length(cur) + length(t) + {p.test_sep} > {lim} THEN list_append(pieces, cur) ELSE pieces END"
    extra = f"(CAST(ceil(length(c) / {lim}) AS INT) - 1)"
    step = "SELECT doc_id, i, n, b AS pieces, c AS cur FROM ({src})"
    if p.hard:
        step = (f"SELECT doc_id, i, n, CASE WHEN length(c) > {lim} THEN list_concat(b, list_transform(range({extra}), lambda j: substr(c, j * {lim} + 1, {lim}))) ELSE b END AS pieces,"
                f" CASE WHEN length(c) > {lim} THEN substr(c, {extra} * {lim} + 1) ELSE c END AS cur FROM ({{src}})")
    first = step.format(src="SELECT doc_id, i, n, CAST([] AS VARCHAR[]) AS b, t AS c FROM items WHERE i = 1")
    more = step.format(src=f"SELECT k.doc_id, k.i, k.n, {before.replace('doc_id', 'k.doc_id')} AS b, {placed.replace('doc_id', 'k.doc_id')} AS c FROM fold f JOIN items k ON k.doc_id = f.doc_id AND k.i = f.i + 1")
    keep = f"regexp_matches(cur, '[^{WS}]')" if p.drop_blank else "cur <> ''"
    final = f"SELECT doc_id, CASE WHEN {keep} THEN list_append(pieces, cur) ELSE pieces END AS pieces FROM fold WHERE i = n"
    if p.whole:
        final += f" AND doc_id NOT IN (SELECT doc_id FROM {text_cte} WHERE length(text) <= {lim}) UNION ALL SELECT doc_id, [text] FROM {text_cte} WHERE length(text) <= {lim}"
    return {
        "items": f"SELECT doc_id, unnest(a) AS t, generate_subscripts(a, 1) AS i, len(a) AS n FROM (SELECT doc_id, {items} AS a FROM {text_cte})",
        "fold": f"{first} UNION ALL {more}",
        "packed": final,
    }


PARAS = "string_split_regex(text, chr(10) || chr(10) || '+')"
SENTENCES = ("string_split(regexp_replace(text, '([.!?…\"''”’])[" + WS + "]+', '\\1' || chr(1), 'g'), chr(1))")
PIECE_ROWS = "SELECT doc_id, CAST(generate_subscripts(pieces, 1) - 1 AS BIGINT) AS idx, unnest(pieces) AS text FROM packed"


def _pieces(docs, packed):
    return docs.select("doc_id", F.posexplode_outer(packed).alias("idx", "text")).filter("text IS NOT NULL").select(
        "doc_id", F.col("idx").cast("long"), "text")


def _hashed(df):
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("text_hash", F.md5("text")).drop("text")


HASHED = "SELECT doc_id, idx, length(text) AS n_chars, md5(text) AS text_hash FROM "


def book_chunk_summary(spark, d):
    """Per book: number of analysis chunks, characters, and speech credits."""
    clean = Model(spark, d).documents.withColumn("text", X.normalize(F.col("text")))
    chunks = _pieces(clean, P.pack_text(F.col("text"), P.ANALYSIS_CHUNKS))
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunk_count"), F.sum(F.length("text")).cast("long").alias("chars"),
    ).withColumn("credits", D.speech_credits(F.col("chars"), F.lit(D.HALF_RATE_MODEL)))


def analysis_chunks(spark, d):
    return _hashed(_pieces(Model(spark, d).documents, P.pack_text(F.col("text"), P.ANALYSIS_CHUNKS)))


SMALL = P.Packing(180, 2, "\n\n", r"\n\n+", hard=True)


def small_chunks_with_hard_split(spark, d):
    return _hashed(_pieces(Model(spark, d).documents, P.pack_text(F.col("text"), SMALL)))


def narration_pieces(spark, d):
    return _hashed(_pieces(Model(spark, d).documents, P.pack_text(F.col("text"), P.NARRATION)))


def section_split(spark, d):
    return _hashed(_pieces(Model(spark, d).documents, P.pack_text(F.col("text"), P.SECTIONS)))


def model_pieces(spark, d):
    """Sentence-bounded pieces under the limit of the book's model (4 500 here)."""
    return _hashed(_pieces(Model(spark, d).documents, P.pack_text(F.col("text"), P.model_pieces(4_500), D.model_limit(F.lit(D.V3_MODEL)))))


def model_pieces_by_book(spark, d):
    """Sentence-bounded pieces of every document under the limit of the model that its book is rendered with."""
    m = Model(spark, d)
    models = m.books.select(F.col("id").alias("book_id"), "render_model")
    docs = m.documents.withColumn("book_id", F.col("doc_id") % 25).join(models, "book_id")
    limit = D.model_limit(F.col("render_model"))
    pieces = docs.select("doc_id", "render_model", F.posexplode_outer(P.pack_text(F.col("text"), P.model_pieces(D.DEFAULT_MODEL_LIMIT), limit)).alias("idx", "text")).filter("text IS NOT NULL")
    return _hashed(pieces.withColumn("idx", F.col("idx").cast("long")))


MODEL_LIMIT_SQL = "(CASE ((doc_id % 25) % 3) " + " ".join(f"WHEN {k} THEN {D.MODEL_LIMITS.get(name, D.DEFAULT_MODEL_LIMIT)}" for k, name in enumerate(MODELS)) + " END)"


def raw_text(docs):
    """Text as an upload may hold it: CRLF, trailing blanks, emphasis, extra blank lines."""
    marked = F.transform(F.split("text", "\n\n"), lambda l, i: F.when(i % 5 == 0, F.concat(F.lit("_"), F.substring(l, 1, 30), F.lit("_"), F.substring(l, 31, 1 << 30)))
                         .when(i % 7 == 3, F.concat(F.lit("_"), l)).otherwise(l))
    return docs.withColumn("text", F.concat(F.lit("  \n"), F.array_join(marked, " \t\r\n\r\n\r\n"), F.lit(" \r")))


RAW_SQL = """SELECT doc_id, source_file_name, '  ' || chr(10) || array_to_string(list_transform(string_split(text, chr(10) || chr(10)), lambda l, i:
     CASE WHEN (i - 1) % 5 = 0 THEN '_' || substring(l, 1, 30) || '_' || substring(l, 31) WHEN (i - 1) % 7 = 3 THEN '_' || l ELSE l END),
     ' ' || chr(9) || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10)) || ' ' || chr(13) AS text FROM docs"""
EMPHASIS_SQL = "regexp_replace({0}, '_((?:\\n?[^_\\n]){{1,400}}\\n?)_|(_[^_]{{1,400}}_)', '\\1\\2', 'g')"
NORMAL_SQL = EMPHASIS_SQL.format(trim_ws(
    "regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"))


def normalize_text(spark, d):
    clean = raw_text(Model(spark, d).documents).withColumn("text", X.normalize(F.col("text")))
    return clean.select("doc_id", F.md5("text").alias("text_hash"), F.length("text").cast("long").alias("n_chars"))


def underscores_left(spark, d):
    """Check: documents that still hold an emphasis mark after cleaning."""
    clean = raw_text(Model(spark, d).documents).select("doc_id", X.normalize(F.col("text")).alias("text"))
    return clean.filter(F.col("text").contains("_")).select("doc_id")


def _cleaned(m):
    """Chapters after cleaning, but for one in five that slipped past it."""
    df = m.headed_documents.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.lit("CHAPTER I. — chapter, I")).otherwise("Prologue, Part 2").alias("title"))
    return df.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(X.clean_chapter(F.col("text"), F.col("title"))))


def title_lines_left(spark, d):
    """Check: chapters whose text still starts with a line of their title."""
    return Q.title_lines_left(_cleaned(Model(spark, d))).select("doc_id", "title")


def file_titles(spark, d):
    return Model(spark, d).documents.select("doc_id", X.title_from_file_name(F.col("source_file_name")).alias("title"))


def _uploads(m):
    ext = F.element_at(F.array(*[F.lit(e) for e in [".txt", ".MD", ".doc", ".docx", ".pdf", ""]]), (F.col("doc_id") % 6 + 1).cast("int"))
    return m.table("documents").select(
        "doc_id", F.concat(F.lit("in/"), F.col("source"), ext).alias("name"),
        F.when(F.col("doc_id") % 50 == 0, 40_000_000).otherwise(F.length("text")).cast("long").alias("n_bytes"), "text")


def input_gate(spark, d):
    up = _uploads(Model(spark, d))
    return up.select("doc_id", X.reject_reason(F.col("name"), F.col("n_bytes"), X.normalize(F.col("text"))).alias("reject_reason"))


def line_offsets(spark, d):
    return CH.lines_with_offsets(Model(spark, d).headed_documents).select("doc_id", "line_idx", "offset", F.md5("line").alias("line_hash"))


def heading_candidates(spark, d):
    return CH.heading_candidates(Model(spark, d).headed_documents)


def chapter_detection(spark, d):
    return _hashed(CH.detect(Model(spark, d).headed_documents))


def chapter_detection_supplied(spark, d):
    m = Model(spark, d)
    given = m.table("documents").select("doc_id", F.array(F.lit(-1), F.lit(900), (F.col("doc_id") % 3 + 2).cast("int"), F.lit(1)).alias("heading_indexes"))
    return _hashed(CH.detect(m.headed_documents, given))


def title_announcements(spark, d):
    return Model(spark, d).chapters.select("id", X.title_announcement(F.col("title")).alias("announcement"))


def roman_numerals(spark, d):
    """Every line's roman-looking tail letters as a number."""
    part = F.regexp_extract(F.lower("p_name"), "([ivxlcdm]+)", 1)
    return Model(spark, d).table("part").select("p_partkey", F.when(part != "", X.roman_to_int(part)).cast("long").alias("value"))


def clean_chapters(spark, d):
    m = Model(spark, d)
    df = m.headed_documents.select("doc_id", F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.lit("CHAPTER I. — chapter, I")).otherwise("Part 2").alias("title"))
    return df.select("doc_id", F.md5(X.clean_chapter(F.col("text"), F.col("title"))).alias("text_hash"))


def pov_excerpt(spark, d):
    head, tail = X.opening_excerpt(F.col("text"))
    return Model(spark, d).documents.select("doc_id", F.md5(head).alias("head"), F.md5(tail).alias("tail"))


def book_full_text(spark, d):
    return CH.book_text(CH.detect(Model(spark, d).headed_documents)).select(
        "doc_id", F.md5("text").alias("text_hash"), F.length("text").cast("long").alias("n_chars"), "opening")


FILE_TITLE = collapse_ws("regexp_replace(regexp_replace(source_file_name, '[.][^.]*$', ''), '[-_]+', ' ', 'g')")
H = sql_re(CH.HEADINGS)
CLEAN_TITLE = lambda e: trim_ws(f"regexp_replace(regexp_replace({e}, '[{WS}]+', ' ', 'g'), '[.:{WS}]+$', '')")
CHAPTER_CTES = {
    "raw_lines": "SELECT doc_id, unnest(a) AS l, generate_subscripts(a, 1) - 1 AS i, len(a) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM headed)",
    "all_lines": f"""SELECT *, lag(t) OVER w AS prev_t, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(t, 3) OVER w AS t3,
          CAST(sum(length(l) + 1) OVER w AS BIGINT) - length(l) - 1 AS start_at
        FROM (SELECT *, {trim_ws('l')} AS t FROM raw_lines) WINDOW w AS (PARTITION BY doc_id ORDER BY i)""",
    "cands": f"SELECT *, regexp_matches(t, '{H}') AS hit, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS nth FROM all_lines WHERE length(t) BETWEEN 1 AND 60 AND (i = 0 OR prev_t = '')",
    "given": "SELECT doc_id, unnest([-1, 900, doc_id % 3 + 2, 1]) AS nth FROM documents",
    "split1": "SELECT doc_id, count(*) AS k FROM cands WHERE hit GROUP BY 1",
    "split2": "SELECT c.doc_id, count(*) AS k FROM cands c JOIN given g ON g.doc_id = c.doc_id AND g.nth = c.nth GROUP BY 1",
    "picked": f"""SELECT c.*, m.method FROM cands c JOIN methods m ON m.doc_id = c.doc_id
        WHERE (m.method = 'heuristic' AND hit) OR (m.method = 'llm' AND (c.doc_id, c.nth) IN (SELECT doc_id, nth FROM given))""",
    "subs": f"""SELECT *, CASE WHEN t1 <> '' THEN CASE WHEN length(t1) <= 60 AND coalesce(t2, '') = '' AND NOT regexp_matches(t1, '{H}') THEN i + 1 END
          WHEN t2 <> '' THEN CASE WHEN length(t2) <= 60 AND coalesce(t3, '') = '' AND NOT regexp_matches(t2, '{H}') THEN i + 2 END END AS sub,
          lead(i, 1, n) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM picked""",
    "bodies": f"""SELECT s.doc_id, s.method, s.i AS ord, {CLEAN_TITLE("CASE WHEN s.sub IS NOT NULL THEN " + CLEAN_TITLE('s.t') + " || ' — ' || CASE WHEN s.sub = s.i + 1 THEN s.t1 ELSE s.t2 END ELSE s.t END")} AS title,
          {trim_ws("coalesce(string_agg(b.l, chr(10) ORDER BY b.i), '')")} AS text
        FROM subs s LEFT JOIN raw_lines b ON b.doc_id = s.doc_id AND b.i > coalesce(s.sub, s.i) AND b.i < s.stop
        GROUP BY s.doc_id, s.method, s.i, s.t, s.t1, s.t2, s.sub""",
    "fronts": f"""SELECT p.doc_id, p.method, -1 AS ord, 'Front Matter' AS title, {trim_ws("string_agg(b.l, chr(10) ORDER BY b.i)")} AS text
        FROM (SELECT doc_id, method, min(i) AS i0 FROM picked GROUP BY 1, 2) p JOIN raw_lines b ON b.doc_id = p.doc_id AND b.i < p.i0 GROUP BY 1, 2""",
    **pack_sql(PARAS, P.SECTIONS, text_cte="headed"),
    "parts": """SELECT doc_id, method, ord, title, text FROM bodies WHERE text <> '' UNION ALL SELECT * FROM fronts WHERE length(text) > 500
        UNION ALL SELECT p.doc_id, 'sections', o, 'Section ' || o, t FROM (SELECT doc_id, generate_subscripts(pieces, 1) AS o, unnest(pieces) AS t FROM packed) p
          JOIN methods m ON m.doc_id = p.doc_id AND m.method = 'sections'
        UNION ALL SELECT h.doc_id, 'single', 0, 'Chapter 1', text FROM headed h JOIN methods m ON m.doc_id = h.doc_id AND m.method = 'single'""",
    "detected": "SELECT doc_id, method, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS idx, title, text FROM parts",
}
_METHOD = """SELECT h.doc_id, CASE WHEN s.k >= 2 AND length(text) / s.k >= 800 THEN 'heuristic' {llm}
     WHEN length(text) > 25000 THEN 'sections' ELSE 'single' END AS method FROM headed h LEFT JOIN split1 s ON s.doc_id = h.doc_id {join}"""
DETECT = {**CHAPTER_CTES, "methods": _METHOD.format(llm="", join="")}
DETECT_GIVEN = {**CHAPTER_CTES, "methods": _METHOD.format(
    llm="WHEN g.k >= 2 AND length(text) / g.k >= 800 THEN 'llm'", join="LEFT JOIN split2 g ON g.doc_id = h.doc_id")}
DETECTED_ROWS = "SELECT doc_id, method, idx, title, length(text) AS n_chars, md5(text) AS text_hash FROM detected"

_W = "chapter|part|book|canto|act|stave"
_T = collapse_ws("title")
_worth = "list_transform(string_split({0}, ''), lambda ch: CASE ch WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 ELSE 1000 END)"
ROMAN_SQL = lambda e: f"(SELECT list_sum(list_transform(a, lambda v, k: CASE WHEN v < coalesce(a[k + 1], 0) THEN -v ELSE v END)) FROM (SELECT {_worth.format(e)} AS a))"
ANNOUNCE_SQL = f"""SELECT id, CASE WHEN t <> '' AND NOT regexp_matches(t, '(?i)^(section \\d+|front matter)$') THEN
    regexp_replace(regexp_replace(CASE WHEN num <> '' THEN upper(w[1]) || lower(w[2:]) || ' ' || CAST(list_sum(list_transform(a, lambda v, k: CASE WHEN v < coalesce(a[k + 1], 0) THEN -v ELSE v END)) AS BIGINT) || substring(t, length(m) + 1)
      WHEN bare <> '' THEN upper(bare[1]) || lower(bare[2:]) || substring(t, length(bare) + 1) ELSE t END,
      '[{WS}]*[—–][{WS}]*', '. ', 'g'), '[.:{WS}]+$', '') || '.' END AS announcement
  FROM (SELECT *, {_worth.format('lower(num)')} AS a FROM (SELECT id, t, regexp_extract(t, '(?i)^(?:{_W})[{WS}.:]+[ivxlcdm]+\\b') AS m,
      regexp_extract(t, '(?i)^({_W})[{WS}.:]+[ivxlcdm]+\\b', 1) AS w, regexp_extract(t, '(?i)^(?:{_W})[{WS}.:]+([ivxlcdm]+)\\b', 1) AS num,
      regexp_extract(t, '(?i)^({_W})\\b', 1) AS bare FROM (SELECT id, {_T} AS t FROM chapters)))"""
FORM = lambda e: f"trim(regexp_replace(lower({e}), '[^a-z0-9]+', ' ', 'g'))"

def cleaned_sql(even: str, odd: str) -> str:
    """Chapters with the title line taken out of ``cleaned``; f is their first line."""
    return f"""SELECT *, {trim_ws(f"CASE WHEN {FORM('f')} <> '' AND length(f) <= 60 AND ends_with({FORM('title')}, {FORM('f')}) THEN regexp_replace(text, '^[{WS}]*[^\\n]*(?:\\n|$)', '') ELSE text END")} AS cleaned
        FROM (SELECT *, {trim_ws(f"regexp_extract(text, '^[{WS}]*([^\\n]*)', 1)")} AS f, CASE WHEN doc_id % 2 = 0 THEN '{even}' ELSE '{odd}' END AS title FROM headed)"""


QUERIES = {
    "book_chunk_summary": (book_chunk_summary, with_model(
        """SELECT doc_id, count(*) AS chunk_count, CAST(sum(length(text)) AS BIGINT) AS chars,
             CAST(ceil(sum(length(text)) * 0.5) AS BIGINT) AS credits FROM (""" + PIECE_ROWS + ") GROUP BY 1",
        pack_sql(PARAS, P.ANALYSIS_CHUNKS, text_cte="cleaned") | {"cleaned": f"SELECT doc_id, {NORMAL_SQL} AS text FROM docs"}, recursive=True)),
    "analysis_chunks": (analysis_chunks, with_model(HASHED + f"({PIECE_ROWS})", pack_sql(PARAS, P.ANALYSIS_CHUNKS), recursive=True)),
    "small_chunks_with_hard_split": (small_chunks_with_hard_split, with_model(HASHED + f"({PIECE_ROWS})", pack_sql(PARAS, SMALL), recursive=True)),
    "narration_pieces": (narration_pieces, with_model(HASHED + f"({PIECE_ROWS})", pack_sql(PARAS, P.NARRATION), recursive=True)),
    "section_split": (section_split, with_model(HASHED + f"({PIECE_ROWS})", pack_sql(PARAS, P.SECTIONS), recursive=True)),
    "model_pieces": (model_pieces, with_model(HASHED + f"({PIECE_ROWS})", pack_sql(SENTENCES, P.model_pieces(4_500)), recursive=True)),
    "normalize_text": (normalize_text, with_model(
        f"SELECT doc_id, md5(x) AS text_hash, length(x) AS n_chars FROM (SELECT doc_id, {NORMAL_SQL} AS x FROM raw)", {"raw": RAW_SQL})),
    "underscores_left": (underscores_left, with_model(
        f"SELECT doc_id FROM raw WHERE contains({NORMAL_SQL}, '_')", {"raw": RAW_SQL})),
    "model_pieces_by_book": (model_pieces_by_book, with_model(
        f"SELECT p.doc_id, b.render_model, idx, length(text) AS n_chars, md5(text) AS text_hash FROM ({PIECE_ROWS}) p JOIN books b ON b.id = p.doc_id % 25",
        pack_sql(SENTENCES, P.model_pieces(D.DEFAULT_MODEL_LIMIT), MODEL_LIMIT_SQL), recursive=True)),
    "title_lines_left": (title_lines_left, with_model(f"""SELECT doc_id, title FROM (SELECT doc_id, title, {trim_ws("split_part(CASE WHEN doc_id % 5 = 0 THEN text ELSE cleaned END, chr(10), 1)")} AS first_line
          FROM ({cleaned_sql('CHAPTER I. — chapter, I', 'Prologue, Part 2')})) WHERE contains(lower(title), lower(first_line)) AND length(first_line) <= 60""")),
    "file_titles": (file_titles, with_model(
        f"SELECT doc_id, {FILE_TITLE} AS title FROM docs")),
    "input_gate": (input_gate, f"""SELECT doc_id, CASE WHEN doc_id % 50 = 0 AND 40000000 > 30 * 1024 * 1024 THEN 'too_large' WHEN doc_id % 6 = 2 THEN 'legacy_doc'
          WHEN doc_id % 6 NOT IN (0, 1) THEN 'unsupported_file' WHEN length({trim_ws('text')}) < 100 THEN 'empty_extraction' END AS reject_reason FROM documents"""),
    "line_offsets": (line_offsets, with_model('SELECT doc_id, i AS line_idx, start_at AS "offset", md5(l) AS line_hash FROM all_lines', DETECT)),
    "heading_candidates": (heading_candidates, with_model('SELECT doc_id, i AS line_idx, start_at AS "offset", t AS heading, hit AS is_heading FROM cands', DETECT)),
    "chapter_detection": (chapter_detection, with_model(DETECTED_ROWS, DETECT, recursive=True)),
    "chapter_detection_supplied": (chapter_detection_supplied, with_model(DETECTED_ROWS, DETECT_GIVEN, recursive=True)),
    "title_announcements": (title_announcements, with_model(ANNOUNCE_SQL)),
    "roman_numerals": (roman_numerals, f"""SELECT p_partkey, CASE WHEN s > 0 THEN s END AS value FROM (SELECT p_partkey,
        CAST(list_sum(list_transform(a, lambda v, k: CASE WHEN v < coalesce(a[k + 1], 0) THEN -v ELSE v END)) AS BIGINT) AS s
        FROM (SELECT p_partkey, CASE WHEN r <> '' THEN {_worth.format('r')} END AS a FROM (SELECT p_partkey, regexp_extract(lower(p_name), '([ivxlcdm]+)', 1) AS r FROM part)))"""),
    "clean_chapters": (clean_chapters, with_model(f"SELECT doc_id, md5(cleaned) AS text_hash FROM ({cleaned_sql('CHAPTER I. — chapter, I', 'Part 2')})")),
    "pov_excerpt": (pov_excerpt, with_model(
        "SELECT doc_id, md5(left(text, 3000)) AS head, md5(CASE WHEN length(text) > 4000 THEN right(text, 1000) ELSE '' END) AS tail FROM docs")),
    "book_full_text": (book_full_text, with_model(
        """SELECT doc_id, md5(x) AS text_hash, length(x) AS n_chars, opening FROM (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS x,
             left(arg_min(text, idx), 280) AS opening FROM detected GROUP BY 1)""", DETECT, recursive=True)),
}
