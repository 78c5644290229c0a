"""The script data model, derived from whatever base tables are given.

``Model(spark, dir)`` maps the star-schema and text tables onto books, chapters,
segments, characters, voices, assignments and jobs, so that every operator can
run at the size of its input. The mapping is plain column arithmetic; nothing is
sampled or capped. ``sql_model.CTES`` states the same mapping as ANSI SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscript.sources import samples as S
from folioscript.session import spread, tune


def pick(values, idx):
    """Value ``idx % len`` of a fixed list."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (idx % len(values) + 1).cast("int"))



class Model:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.dir = sf_dir.rstrip("/")
        self.shared: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- library ---------------------------------------------------------
    @cached_property
    def books(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.table("nation").select(
            n.cast("long").alias("id"),
            F.col("n_name").alias("title"),
            F.when(n % 4 != 0, F.concat(F.lit("Author "), n.cast("string"))).alias("author"),
            pick(S.BOOK_STATUS, n).alias("status"),
            pick(S.STAGES, n).alias("pipeline_stage"),
            pick(S.MODELS, n).alias("render_model"),
            (n % 2 == 0).alias("sfx_enabled"),
            F.when(n % 5 == 0, F.concat(F.lit("book error "), n.cast("string"))).alias("error"),
        )

    @cached_property
    def chapters(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self.table("orders").select(
            o.alias("id"),
            (F.col("o_custkey") % 25).alias("book_id"),
            o.alias("idx"),
            F.when(o % 29 == 0, "Front Matter")
            .when(o % 7 == 0, F.concat(F.lit("CHAPTER "), pick(S.ROMANS, o), F.lit(" — The / Road: "), o.cast("string")))
            .otherwise(F.concat(F.lit("Chapter "), o.cast("string"))).alias("title"),
            F.floor("o_totalprice").cast("long").alias("char_count"),
            F.when(F.col("o_orderstatus") == "F", "ready")
            .when(F.col("o_orderstatus") == "O", pick(["pending", "scripted", "stale"], o))
            .otherwise(pick(["scripting", "generating", "scripted", "error"], o)).alias("status"),
            F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("chapters/"), o.cast("string"), F.lit(".mp3")))
            .when(o % 3 == 2, F.concat(F.lit("chapters/"), o.cast("string"), F.lit("-old.mp3"))).alias("audio_path"),
            F.when(o % 4 == 0, (o % 9).cast("double")).alias("intro_duration_sec"),
            F.when(o % 13 == 0, F.concat(F.lit("chapter error "), o.cast("string"))).alias("error"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        o = F.col("o_orderkey")
        total = F.floor("o_totalprice").cast("long")
        return self.table("orders").select(
            o.alias("id"),
            pick_map(S.JOB_TYPES, F.col("o_orderpriority")).alias("type"),
            (F.col("o_custkey") % 25).alias("book_id"),
            F.when(o % 19 != 0, o - o % 3).alias("chapter_id"),
            F.when(o % 17 == 0, "failed").when(o % 23 == 0, "cancelled")
            .when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("status"),
            F.floor(total * (o % 101) / 100).cast("long").alias("done"),
            F.when(o % 41 == 0, F.lit(0)).otherwise(total).cast("long").alias("total"),
            F.when(o % 17 == 0, F.concat(F.lit("job error "), o.cast("string"))).alias("error"),
            F.when(o % 3 != 0, F.concat(F.lit("step "), (o % 101).cast("string"))).alias("note"),
            F.when(o % 5 != 0, F.concat(F.lit("run-"), (o % 1000).cast("string"))).alias("run_id"),
            (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + o % 86400).alias("created_s"),
            (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + o % 86400 + (o % 301)).alias("updated_s"),
        )

    @cached_property
    def segments(self) -> DataFrame:
        rows = self.table("lineitem").groupBy(
            F.col("l_orderkey").alias("chapter_id"),
            (F.col("l_linenumber") - 1).cast("long").alias("idx"),
        ).agg(
            F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"),
            F.min("l_suppkey").alias("sk"), F.min("l_partkey").alias("pk"),
            F.min(F.ascii("l_returnflag")).alias("rf"),
        )
        kind = F.when(F.col("rf") == ord("A"), "dialogue").when(F.col("rf") == ord("N"), "narration").otherwise("sfx")
        pk, sk = F.col("pk"), F.col("sk")
        missing = pk % 50 == 0
        return rows.select(
            (F.col("chapter_id") * 8 + F.col("idx")).alias("id"),
            "chapter_id", "idx", kind.alias("kind"),
            F.concat(F.lit("Line "), pk.cast("string"), F.lit(" of "), sk.cast("string"), pick(S.ENDINGS, pk)).alias("text"),
            F.when(kind == "dialogue", pk).when((kind == "narration") & (pk % 9 == 0), sk).alias("character_id"),
            F.when(~missing, F.col("q")).alias("duration_sec"),
            F.when(~missing, F.concat(F.lit("segments/"), pk.cast("string"), F.lit(".mp3"))).alias("audio_path"),
            F.when(pk % 7 != 0, F.col("d")).alias("pause_before_sec"),
            (pk % 11 == 0).alias("flagged"),
            F.when((kind == "dialogue") & (pk % 4 == 0), pick([*S.DELIVERIES, "mumbled"], pk)).alias("delivery"),
            F.when((kind == "sfx") & (pk % 3 != 0), (sk % 60) / 10.0).alias("sfx_duration_sec"),
            ((pk % 30) / 100.0).alias("tail_sec"), ((sk % 20) / 100.0).alias("lead_sec"),
            (pk % 5 == 0).alias("para_break_before"),
            (pk % 3 == 0).alias("space_before"),
            ((F.col("idx") == 0) & (kind == "narration") & (pk % 2 == 0)).alias("is_title"),
        )

    @cached_property
    def timed_chapters(self) -> DataFrame:
        """Chapters with the length stored when they were rendered; a stale one still has that of an earlier script."""
        clip = F.coalesce("duration_sec", F.lit(0.0)) + F.coalesce("pause_before_sec", F.lit(0.0))
        total = self.segments.groupBy(F.col("chapter_id").alias("id")).agg(F.sum(clip).alias("total"))
        stored = F.when(F.col("status").isin("ready", "stale"), F.round(F.col("total") + F.when(F.col("status") == "stale", 0.25).otherwise(0.0), 6))
        return self.chapters.join(total, "id").select(*self.chapters.columns, stored.alias("duration_sec"))

    # -- cast ------------------------------------------------------------
    @cached_property
    def characters(self) -> DataFrame:
        c = F.col("c_custkey")
        base = self.table("customer")
        narrators = base.groupBy("c_nationkey").agg(F.min("c_custkey").alias("narrator_id"))
        return base.join(narrators, "c_nationkey").select(
            c.alias("id"),
            F.col("c_nationkey").cast("long").alias("book_id"),
            F.when(c == F.col("narrator_id"), "Narrator")
            .otherwise(F.concat(F.lit("Hero "), (c % 37).cast("string"))).alias("name"),
            F.array(
                F.concat(F.lit(" hero "), (c * 7 % 53).cast("string")),
                F.concat(F.lit("Alias "), (c % 11).cast("string")),
                F.lit(""), F.concat(F.lit("ALIAS "), (c % 11).cast("string")),
            ).alias("aliases"),
            F.when(c == F.col("narrator_id"), "narrator").when(c % 3 == 0, "major").otherwise("minor").alias("role"),
            F.floor(F.col("c_acctbal") + 1000).cast("long").alias("dialogue_share"),
            (c == F.col("narrator_id")).alias("is_narrator"),
            F.when((c % 5 == 0) & (c != F.col("narrator_id")), F.concat(F.lit("Group "), (c % 20).cast("string"))).alias("variant_group"),
            F.when((c % 5 == 0) & (c != F.col("narrator_id")), pick(S.VARIANT_LABELS, c)).alias("variant_label"),
            pick(S.GENDERS, c).alias("gender"),
            pick(S.AGE_RANGES, c).alias("age_range"),
            pick(S.ACCENT_HINTS, c).alias("accent_hint"),
            pick(S.HERITAGES, c).alias("heritage"),
            (c % 6 == 0).alias("profile_edited"),
        )

    @cached_property
    def voices(self) -> DataFrame:
        """One voice per part; the first part of a (brand, size class) has the short id that other tables refer to."""
        s = F.col("s")
        b = F.col("b")
        parts = self.table("part").select(
            F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("b"), (F.col("p_size") % 12).cast("long").alias("s"),
            F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("n"), F.col("p_type").alias("t"))
        first = parts.groupBy("b", "s").agg(F.min("ordinal").alias("ordinal")).withColumn("_first", F.lit(True))
        short = F.concat(F.lit("v"), b.cast("string"), F.lit("-"), s.cast("string"))
        return (
            parts.join(first, ["b", "s", "ordinal"], "left")
            .select(
                F.when(F.col("_first"), short).otherwise(F.concat(short, F.lit("-"), F.col("ordinal").cast("string"))).alias("id"),
                "ordinal", F.concat(F.initcap("n"), F.lit(" "), (b % 9).cast("string")).alias("name"),
                F.lower("t").alias("category"),
                F.concat(F.lit("A "), F.col("n"), F.lit(" voice")).alias("description"),
                pick(S.VOICE_GENDERS, s).alias("gender"),
                F.when(b % 5 != 0, pick(S.VOICE_AGES, F.floor(s / 4).cast("long"))).alias("age"),
                pick(S.VOICE_ACCENTS, b).alias("accent"),
                F.when(s % 5 != 0, F.concat(F.lit("tone "), s.cast("string"))).alias("descriptive"),
                pick(S.USE_CASES, b + s).alias("use_case"),
            )
        )

    @cached_property
    def assignments(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").filter(c % 5 != 2).select(
            c.alias("character_id"),
            F.concat(F.lit("v"), (c % 27).cast("string"), F.lit("-"), (c * 5 % 12).cast("string")).alias("voice_id"),
            F.concat(F.lit("Voice "), (c % 27).cast("string")).alias("voice_name"),
            ((c % 101) / 100.0).alias("stability"), F.lit(0.75).alias("similarity_boost"),
            ((c % 50) / 100.0).alias("style"), (0.8 + (c % 40) / 100.0).alias("speed"),
            (c * 7919 % 2147483647).alias("seed"),
            (c % 7 == 0).alias("overridden"),
            F.concat(F.lit("because "), (c % 13).cast("string")).alias("rationale"),
        )

    # -- text ------------------------------------------------------------
    @cached_property
    def texts(self) -> DataFrame:
        """Document texts for work that is heavy per row, dealt over all tasks."""
        return spread(self.table("documents").select("doc_id", "text"))

    @cached_property
    def documents(self) -> DataFrame:
        """One book per document; lines become blank-line separated paragraphs."""
        return self.table("documents").select(
            F.col("doc_id"), F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("--draft.txt")).alias("source_file_name"),
            F.regexp_replace("text", "\n", "\n\n").alias("text"),
        )

    @cached_property
    def headed_documents(self) -> DataFrame:
        """Documents with a heading line before every eighth line (none for doc_id % 4 = 3)."""
        lines = F.split("text", "\n")
        n = lambda i: F.floor(i / 8).cast("long")
        heading = lambda i: (
            F.when(n(i) % 5 == 0, F.concat(F.lit("CHAPTER "), pick(S.ROMANS, n(i)), F.lit(".\n\nThe Road to "), n(i).cast("string")))
            .when(n(i) % 5 == 1, F.concat(F.lit("Chapter "), n(i).cast("string"), F.lit(" :")))
            .when(n(i) % 5 == 2, F.lit("Prologue"))
            .when(n(i) % 5 == 3, F.concat(pick(S.ROMANS, n(i)), F.lit(".")))
            .otherwise(F.concat(F.lit("Not a heading "), n(i).cast("string")))
        )
        marked = F.transform(
            lines,
            lambda l, i: F.when((i % 8 == 0) & (F.col("doc_id") % 4 != 3), F.concat(heading(i), F.lit("\n\n"), l)).otherwise(l),
        )
        return self.table("documents").select(
            "doc_id", F.array_join(marked, "\n\n").alias("text")
        )

    @cached_property
    def quoted_chapters(self) -> DataFrame:
        """Chapters with dialogue: every third paragraph quoted, some left unclosed."""
        d = F.col("doc_id")
        op = F.when(d % 4 < 2, '"').when(d % 4 == 2, "“").otherwise("‘")
        cl = F.when(d % 4 < 2, '"').when(d % 4 == 2, "”").otherwise("’")
        quote = lambda l, i: (
            F.when(i % 3 != 1, l)
            .when(i % 21 == 10, F.concat(op, l))
            .when(i % 6 == 4, F.concat(op, F.substring(l, 1, 20), cl, op, F.substring(l, 21, 1 << 30), cl))
            .otherwise(F.concat(op, l, cl, F.lit(" said Hero "), (i % 40).cast("string"), F.lit(".")))
        )
        return self.texts.select(
            d.alias("chapter_id"), (d % 25).alias("book_id"),
            F.when(d % 10 == 0, "Section 3").otherwise(F.concat(F.lit("CHAPTER "), pick(S.ROMANS, d), F.lit(" — The Road"))).alias("title"),
            F.array_join(F.transform(F.split("text", "\n"), quote), "\n\n").alias("text"),
        )


def pick_map(mapping: dict[str, str], c):
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out
