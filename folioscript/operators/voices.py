"""Voice catalog, compatibility, assignment and overrides."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscript.functions import domains as D
from folioscript.functions.js import is_blank, lower_key
from folioscript.operators import ordered as O
from folioscript.operators.cast import cast_order
from folioscript.session import cut_lineage, travels

travels(__name__)

# Catalog and search limits, rationale rules.
SEARCH_LIMIT, SEARCH_MAX, LOCAL_FIRST_MAX, LIVE_MAX = 14, 25, 80, 40
RATIONALE_MIN = 12
FILLER_WORDS = r"(?i)\b(placeholder|todo|tbd|n/a)\b"
SNAPSHOT_USABLE_SEC, SNAPSHOT_REFRESH_SEC = 24 * 3600, 3600

ACCOUNT_SCHEMA = ("struct<voiceId:string,name:string,category:string,description:string,"
                  "labels:map<string,string>,previewUrl:string>")
SHARED_SCHEMA = ("struct<voiceId:string,voice_id:string,name:string,category:string,description:string,gender:string,age:string,"
                 "accent:string,descriptive:string,useCase:string,use_case:string,previewUrl:string,preview_url:string>")
PROFILE = ["id", "name", "category", "description", "gender", "age", "accent", "descriptive", "use_case", "preview_url"]


def parse_account_voices(raw: DataFrame, col: str = "json") -> DataFrame:
    """Account voices: metadata in a free-form label map; a null falls through."""
    v = raw.withColumn("_v", F.from_json(col, ACCOUNT_SCHEMA))
    label = lambda *names: F.coalesce(*[F.col("_v.labels")[n] for n in names])
    return v.select(
        "ordinal", F.col("_v.voiceId").alias("id"), F.coalesce("_v.name", "_v.voiceId").alias("name"),
        F.coalesce("_v.category", F.lit("unknown")).alias("category"), F.col("_v.description").alias("description"),
        label("gender").alias("gender"), label("age").alias("age"), label("accent").alias("accent"),
        label("descriptive", "description").alias("descriptive"), label("use_case", "usecase").alias("use_case"),
        F.col("_v.previewUrl").alias("preview_url"))


def parse_shared_voices(raw: DataFrame, col: str = "json") -> DataFrame:
    """Shared voices: flat fields in either casing; an empty string falls through."""
    v = raw.withColumn("_v", F.from_json(col, SHARED_SCHEMA))
    s = lambda *names: F.coalesce(*[F.nullif(F.col(f"_v.{n}"), F.lit("")) for n in names])
    vid = s("voiceId", "voice_id")
    return v.select(
        "ordinal", F.coalesce(vid, F.lit("")).alias("id"), F.coalesce(s("name"), vid, F.lit("")).alias("name"),
        F.coalesce(s("category"), F.lit("shared")).alias("category"), s("description").alias("description"),
        s("gender").alias("gender"), s("age").alias("age"), s("accent").alias("accent"),
        s("descriptive", "description").alias("descriptive"), s("useCase", "use_case").alias("use_case"),
        s("previewUrl", "preview_url").alias("preview_url"))


def merge_catalog(shared: DataFrame, account: DataFrame) -> DataFrame:
    """Union by id; an account voice replaces the shared copy (last wins), blank ids drop."""
    both = shared.withColumn("_src", F.lit(0)).unionByName(account.withColumn("_src", F.lit(1))).filter(F.col("id") != "")
    return O.first_by(both, ["id"], [-F.col("_src"), -F.col("ordinal")]).drop("_src")


def merge_search(local: DataFrame, live: DataFrame, limit: int = LOCAL_FIRST_MAX) -> DataFrame:
    """Local hits first, then live ones, first per id, at most ``limit`` per query."""
    both = local.withColumn("_src", F.lit(0)).unionByName(live.withColumn("_src", F.lit(1))).filter(F.col("id") != "")
    once = O.first_by(both, ["query", "id"], [F.col("_src"), F.col("ordinal")])
    return O.top_by(once, ["query"], [F.col("_src"), F.col("ordinal"), F.col("id")], limit)


def text_matches(q: Column, *fields: str) -> Column:
    """Any of the fields contains ``q``, ignoring case; nulls never match."""
    return F.lower(F.concat_ws("\u0001", *fields)).contains(F.lower(q))


GRAMS = 3


def _grams(text: Column, n: Column | int) -> Column:
    """The distinct runs of ``n`` characters of a text; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.filter(F.array_distinct(F.transform(starts, lambda i: text.substr(i, F.lit(n)))), lambda g: F.length(g) == n)


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, key) for every text of ``texts(key, hay)`` that contains a needle of ``needles(needle)``, none of them empty.

    An inverted index of the texts' runs of one to three characters: a needle is looked up by the rarest of its own
    runs, the texts posted there are verified. Only postings that some needle asks for are ever joined.
    """
    needles = needles.distinct()
    sizes = F.array_distinct(F.array(*[F.least(F.length("needle"), F.lit(n)) for n in range(1, GRAMS + 1)]))
    asked = needles.select("needle", F.explode(_grams(F.col("needle"), F.element_at(sizes, -1))).alias("gram"))
    posted = texts.select("key", F.explode(F.flatten(F.array(*[_grams(F.col("hay"), n) for n in range(1, GRAMS + 1)]))).alias("gram"))
    posted = posted.join(asked.select("gram").distinct(), "gram", "left_semi")
    often = asked.select("gram").distinct().join(posted.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = asked.join(often, "gram").groupBy("needle").agg(F.min(F.struct("n", "gram")).alias("r")).filter("r.n > 0").select("needle", "r.gram")
    found = rarest.join(posted, "gram").join(texts, "key")
    return found.filter(F.col("hay").contains(F.col("needle"))).select("needle", "key")


def search_catalog(requests: DataFrame, voices: DataFrame) -> DataFrame:
    """Shortlist per request (request_id, gender, accent, age, query, limit): (request_id, rank, id).

    Requests that ask for the same are answered once. Texts and accents are found through :func:`containing`. What a
    query finds (or the whole catalogue, without one) is cut to the first SEARCH_MAX voices of each posting, by gender
    and age bucket and, for requests that name an accent, by accent; a request then reads the few postings it accepts,
    never a voice that cannot be on its list.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    hay = F.lower(F.concat_ws(" ", "name", *[blank(F.col(c)) for c in ("descriptive", "description", "use_case", "accent")]))
    catalogue = cut_lineage(voices.select(
        F.xxhash64("id").alias("key"), "ordinal", "id", hay.alias("hay"), F.lower(blank(F.col("gender"))).alias("v_gender"),
        F.lower(blank(F.col("accent"))).alias("v_accent"), blank(D.age_bucket_of_voice(F.col("age"))).alias("v_age")), "catalogue")
    r = requests.select(
        "request_id", F.lower(blank(F.col("gender"))).alias("r_gender"), blank(lower_key(F.col("accent"))).alias("r_accent"),
        F.lower(blank(F.col("age"))).alias("r_age"), blank(lower_key(F.col("query"))).alias("r_query"),
        F.least(F.coalesce("limit", F.lit(SEARCH_LIMIT)), F.lit(SEARCH_MAX)).alias("r_limit"))
    asked = ["r_gender", "r_accent", "r_age", "r_query"]
    r = cut_lineage(r.withColumn("r_gender", F.when(F.col("r_gender") == "neutral", "").otherwise(F.col("r_gender"))), "requests")
    wanted = r.select(*asked).distinct()

    profile = catalogue.drop("hay")
    hits = containing(wanted.filter("r_query <> ''").select(F.col("r_query").alias("needle")), catalogue.select("key", "hay"))
    matched = hits.withColumnRenamed("needle", "r_query").join(profile, "key").unionByName(profile.withColumn("r_query", F.lit("")))
    postings = matched.select("r_query", "ordinal", "id", "v_gender", "v_age", F.explode(F.array(F.lit(None).cast("string"), F.col("v_accent"))).alias("v_accent"))
    place = Window.partitionBy("r_query", "v_gender", "v_age", "v_accent").orderBy("ordinal", "id")
    heads = cut_lineage(postings.withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= SEARCH_MAX).drop("nth"), "postings")

    accents = catalogue.select(F.xxhash64("v_accent").alias("key"), F.col("v_accent").alias("hay")).distinct()
    spoken = containing(wanted.filter("r_accent <> ''").select(F.col("r_accent").alias("needle")), accents).join(accents, "key").select(
        F.col("needle").alias("r_accent"), F.col("hay").alias("v_accent"))
    lists = heads.select("r_query", "v_gender", "v_age", "v_accent").distinct()
    # Which postings a request accepts: by query and accent through equal keys, by gender and age among the few that are left.
    named = wanted.filter("r_accent <> ''").join(spoken, "r_accent").join(lists, ["r_query", "v_accent"])
    any_accent = wanted.filter("r_accent = ''").join(lists.filter("v_accent IS NULL"), "r_query")
    fits = "(r_gender = '' OR v_gender = '' OR v_gender = r_gender) AND (r_age = '' OR v_age = '' OR v_age = r_age)"
    accepted = named.select(*asked, "v_gender", "v_age", "v_accent").unionByName(any_accent.select(*asked, "v_gender", "v_age", "v_accent")).filter(fits)
    both = accepted.withColumn("v_accent", F.coalesce("v_accent", F.lit("*"))).join(heads.withColumn("v_accent", F.coalesce("v_accent", F.lit("*"))), ["r_query", "v_gender", "v_age", "v_accent"])
    best = O.top_by(both.select(*asked, "ordinal", "id"), asked, [F.col("ordinal"), F.col("id")], SEARCH_MAX)
    return r.join(best, asked).filter("rank <= r_limit").select("request_id", "rank", "id")


# ---- compatibility classes ---------------------------------------------
# A voice only matters through (gender, age bucket, accent family) and its
# catalog position, and a character only through the same three. Both sets of
# classes are fixed small domains, so the many-to-many match is done once per
# pair of classes and characters then use a plain equi-join.
AGES = ["", "young", "middle", "old"]
ACCENTS = ["", *[name for name, _ in D.ACCENT_FAMILIES]]
CLASS = ["c_gender", "c_age", "c_accent"]


def with_character_class(cast: DataFrame) -> DataFrame:
    accent = F.coalesce(D.accent_family(F.col("accent_hint")), D.accent_family(F.col("heritage")), F.lit(""))
    return cast.withColumns({
        "c_gender": F.when(F.col("gender").isin("unknown", "nonbinary"), "any").otherwise(
            F.when(F.col("gender").isin("male", "female"), F.col("gender")).otherwise("other")),
        "c_age": F.coalesce(D.age_bucket_of_text(F.col("age_range")), F.lit("")),
        "c_accent": accent})


def with_voice_class(voices: DataFrame) -> DataFrame:
    g = F.coalesce("gender", F.lit(""))
    return voices.withColumns({
        "v_gender": F.when(g.isin("", "male", "female"), g).otherwise("odd"),
        "v_age": F.coalesce(D.age_bucket_of_voice(F.col("age")), F.lit("")),
        "v_accent": F.coalesce(D.accent_family(F.col("accent")), F.lit(""))})


def class_tiers(voice_classes: DataFrame) -> DataFrame:
    """Every character class with the tier (1 best .. 5) each voice class has for it."""
    each = lambda values: F.explode_outer(F.array(*[F.lit(v) for v in values]))
    df = voice_classes.withColumn("c_gender", each(["any", "male", "female", "other"])).withColumn(
        "c_age", each(AGES)).withColumn("c_accent", each(ACCENTS))
    gender = (F.col("v_gender") == "") | (F.col("c_gender") == "any") | (F.col("v_gender") == F.col("c_gender"))
    age = ~D.age_clash(F.nullif(F.col("c_age"), F.lit("")), F.nullif(F.col("v_age"), F.lit("")))
    exact = (F.col("c_accent") != "") & (F.col("v_accent") == F.col("c_accent"))
    loose = (F.col("c_accent") == "") | (F.col("v_accent") == "")
    return df.withColumn("tier", F.when(gender & age & exact, 1).when(gender & age & loose, 2)
                         .when(gender & age, 3).when(gender, 4).otherwise(5))


def best_voice(cast: DataFrame, voices: DataFrame) -> DataFrame:
    """Best voice per character by compatibility, then catalog order (sharing allowed)."""
    classes = with_voice_class(voices).groupBy("v_gender", "v_age", "v_accent").agg(
        F.min(F.struct("ordinal", "id")).alias("first"))
    best = class_tiers(classes).groupBy(*CLASS).agg(F.min(F.struct("tier", "first")).alias("b"))
    picked = best.select(*CLASS, F.col("b.tier").alias("tier"), F.col("b.first.id").alias("voice_id"))
    return with_character_class(cast).join(picked, CLASS)


def settle_voices(cast: DataFrame, voices: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """(book_id, id, voice_id): voices in casting order, avoiding those already taken in the book.

    ``fixed`` (id, fixed_id) holds accepted picks; they take their voice when their
    turn comes. Anyone else takes the first free voice of their class's best tier, or
    its first voice when none is free. Only what can matter is walked in order, one
    book per group: the first holder of each fixed voice, and of each class as many
    turns as its pool has voices. So a group is bounded by the catalogue, not by the
    cast; everyone later is joined to the first voice of a pool that is used up.
    """
    classed = with_voice_class(voices)
    tiers = class_tiers(classed.select("v_gender", "v_age", "v_accent").distinct())
    top = tiers.groupBy(*CLASS).agg(F.min("tier").alias("tier"))
    cls = F.concat_ws("|", *CLASS)
    entries = tiers.join(top, [*CLASS, "tier"]).join(classed, ["v_gender", "v_age", "v_accent"]).select(
        cls.alias("cls"), "tier", "ordinal", F.col("id").alias("voice_id"))
    entries = cut_lineage(O.dense_index(entries, ["cls"], [F.col("ordinal"), F.col("voice_id")], "r", O.rank_block(F.col("ordinal"))), "pools")
    pools = entries.groupBy("cls", "tier").agg(F.count("*").alias("size"), F.min(F.struct("r", "voice_id"))["voice_id"].alias("first"))
    people = with_character_class(cast_order(cast)).select("book_id", "id", "position", cls.alias("cls"))
    given = fixed.select("id", "fixed_id") if fixed is not None else people.select("id", F.lit(None).cast("string").alias("fixed_id"))
    rows = people.join(given, "id", "left").join(pools, "cls")
    # Without any compatible voice everyone gets the catalogue's first one, free or not.
    rows = cut_lineage(rows.withColumn("fixed_id", F.coalesce("fixed_id", F.when(F.col("tier") == 5, F.col("first")))), "cast")
    holders = rows.filter("fixed_id IS NOT NULL").groupBy("book_id", F.col("fixed_id").alias("voice_id")).agg(F.min("position").alias("position"))
    open_rows = rows.filter("fixed_id IS NULL").select("book_id", "id", "position", "cls", "size", "first")
    turns = cut_lineage(O.dense_index(open_rows, ["book_id", "cls"], [F.col("position")], "turn", O.rank_block(F.col("position"))), "turns")
    contested = turns.filter("turn < size")
    reach = contested.groupBy("book_id", "cls").agg((F.max("position") + 1).alias("reach"))
    # The walk sees numbers instead of names; a voice that is in no pool cannot be in anyone's way.
    voice_numbers = cut_lineage(entries.select("voice_id").distinct().withColumn("voice", F.monotonically_increasing_id()), "voice_numbers")
    kinds = cut_lineage(entries.select("cls").distinct().withColumn("kind", F.monotonically_increasing_id()), "kinds")
    steps = contested.join(kinds, "cls").select("book_id", "id", "position", "kind", F.lit(-1).cast("long").alias("voice")).unionByName(
        holders.join(voice_numbers, "voice_id").select("book_id", F.lit(0).cast("long").alias("id"), "position", F.lit(-1).cast("long").alias("kind"), "voice"))
    numbered = entries.join(voice_numbers.withColumnRenamed("voice_id", "_named"), F.col("voice_id").eqNullSafe(F.col("_named"))).join(kinds, "cls")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("r", "voice"))), lambda x: x["voice"])
    needed = cut_lineage(reach.join(numbered.select("cls", "kind", "r", "voice"), "cls").filter("r < reach").groupBy("book_id", "kind").agg(ordered.alias("voices")), "needed")
    walked = steps.groupBy("book_id").cogroup(needed.groupBy("book_id")).applyInPandas(_take_in_order, "book_id long, id long, voice long").join(
        voice_numbers, "voice").select("book_id", "id", "voice_id")
    late = turns.filter("turn >= size").select("book_id", "id", F.col("first").alias("voice_id"))
    held = rows.filter("fixed_id IS NOT NULL").select("book_id", "id", F.col("fixed_id").alias("voice_id"))
    return walked.unionByName(late).unionByName(held)


def distinct_voices(cast: DataFrame, voices: DataFrame) -> DataFrame:
    """Compatible voices in casting order, none shared while another is free."""
    return settle_voices(cast, voices)


def _take_in_order(steps: pd.DataFrame, pools: pd.DataFrame) -> pd.DataFrame:
    """Walk the steps of one book by position; a step with a voice takes it, others take the first free one of their kind.

    ``pools`` holds one array of numbers per kind, so a voice costs eight bytes in each pool it is in.
    """
    by = dict(zip(pools["kind"].tolist(), pools["voices"], strict=True))
    at = dict.fromkeys(by, 0)
    taken: set[int] = set()
    out = []
    for row in steps.sort_values("position").itertuples(index=False):
        if row.voice >= 0:
            taken.add(row.voice)
            continue
        pool, k = by[row.kind], at[row.kind]
        while k < len(pool) and pool[k] in taken:
            k += 1
        at[row.kind] = k
        voice = int(pool[k] if k < len(pool) else pool[0])
        taken.add(voice)
        out.append((row.book_id, int(row.id), voice))
    return pd.DataFrame(out, columns=["book_id", "id", "voice"])


# ---- picks and assignments -----------------------------------------------

def pick_problem(character_gender: Column, character_age: Column, voice_gender: Column, voice_age: Column, rationale: Column) -> Column:
    """Which hard rule a pick breaks, or null."""
    filler = rationale.isNull() | is_blank(rationale) | (F.length(F.trim(rationale)) < RATIONALE_MIN) | rationale.rlike(FILLER_WORDS)
    return (
        F.when(filler, "a filler rationale")
        .when(D.gender_clash(character_gender, voice_gender), "a gender mismatch")
        .when(D.age_clash(D.age_bucket_of_text(character_age), D.age_bucket_of_voice(voice_age)), "an age mismatch"))


def resolve_picks(picks: DataFrame, voices: DataFrame) -> DataFrame:
    """Voice of each pick: by id, or by name when the id is unknown or names disagree."""
    by_id = voices.select(F.col("id").alias("pick_id"), F.struct("id", "name", "gender", "age", "accent").alias("_a"))
    by_name = O.first_by(voices.withColumn("key", lower_key(F.col("name"))), ["key"], [F.col("ordinal"), F.col("id")]).select(
        "key", F.struct("id", "name", "gender", "age", "accent").alias("_b"))
    df = picks.join(by_id, "pick_id", "left").withColumn("key", lower_key(F.col("pick_name"))).join(by_name, "key", "left")
    agrees = F.col("_a").isNotNull() & (lower_key(F.col("_a.name")) == F.col("key"))
    return df.withColumn("voice", F.when(agrees, F.col("_a")).otherwise(F.coalesce("_b", "_a"))).drop("_a", "_b", "key")


def cast_from_picks(cast: DataFrame, picks: DataFrame, voices: DataFrame) -> DataFrame:
    """Validated picks with their settings; failed picks get a compatible voice that is still free in casting order."""
    df = cast.join(resolve_picks(picks, voices), "id", "left")
    problem = (F.when(F.col("pick_id").isNull(), "not assigned").when(F.col("voice").isNull(), "unknown voice")
               .otherwise(pick_problem(cast["gender"], cast["age_range"], F.col("voice.gender"), F.col("voice.age"), F.col("rationale"))))
    df = cut_lineage(df.withColumn("problem", problem), "picks")
    ok = F.col("problem").isNull()
    settled = settle_voices(cast, voices, df.filter(ok).select("id", F.col("voice.id").alias("fixed_id")))
    df = df.join(settled.select("id", F.col("voice_id").alias("_voice")), "id")
    return df.select(
        "book_id", "id", "problem", F.col("_voice").alias("voice_id"),
        F.when(ok, F.col("rationale")).otherwise(F.concat(F.lit("Auto-matched by gender/age (model pick was "), F.col("problem"), F.lit(")"))).alias("rationale"),
        F.coalesce(F.when(ok, F.col("pick_stability")), F.when(F.col("is_narrator"), D.NARRATOR_STABILITY).otherwise(D.DEFAULT_STABILITY)).alias("stability"),
        F.lit(D.DEFAULT_SIMILARITY).alias("similarity_boost"), F.lit(D.DEFAULT_STYLE).alias("style"),
        F.coalesce(F.when(ok, F.col("pick_speed")), F.lit(D.DEFAULT_SPEED)).alias("speed"))


def already_cast(cast: DataFrame, assignments: DataFrame, voices: DataFrame) -> DataFrame:
    """Manually cast characters with what is known of their voice."""
    fixed = assignments.filter("overridden").select(F.col("character_id").alias("id"), "voice_id", "voice_name")
    known = voices.select(F.col("id").alias("voice_id"), F.col("gender").alias("v_gender"), F.col("age").alias("v_age"), F.col("accent").alias("v_accent"))
    return cast.join(fixed, "id").join(known, "voice_id", "left")


def voice_overrides(commands: DataFrame, cast: DataFrame, assignments: DataFrame, voices: DataFrame) -> DataFrame:
    """Apply manual voice choices (character_id, new_voice_id, new_speed): upsert rows or a reject reason."""
    known = voices.select(F.col("id").alias("new_voice_id"), F.col("name").alias("_new_name"))
    df = (commands.join(cast.select(F.col("id").alias("character_id"), "book_id", "is_narrator"), "character_id", "left")
          .join(assignments, "character_id", "left").join(known, "new_voice_id", "left"))
    voice = F.coalesce("new_voice_id", "voice_id")
    reason = (F.when(F.col("new_voice_id").isNull() & F.col("new_speed").isNull(), "nothing_to_update")
              .when(F.col("book_id").isNull(), "not_found").when(voice.isNull(), "no_voice")
              .when(F.col("new_voice_id").isNotNull() & F.col("_new_name").isNull(), "voice_not_found"))
    speed = F.coalesce("new_speed", "speed", F.lit(D.DEFAULT_SPEED))
    return df.select(
        "character_id", "book_id", F.coalesce("is_narrator", F.lit(False)).alias("is_narrator"), reason.alias("reject_reason"), voice.alias("voice_id"),
        F.when(F.col("new_voice_id").isNotNull(), F.col("_new_name")).otherwise(F.coalesce("voice_name", voice)).alias("voice_name"),
        speed.alias("speed"),
        F.when(F.col("voice_id").isNotNull(), F.col("rationale")).otherwise("Manually selected").alias("rationale"))


def speaker_assignments(cast: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per character own voice, per book narrator voice) lookups for the resolver."""
    own = cast.join(assignments.withColumnRenamed("character_id", "id"), "id").select(
        "book_id", F.col("id").alias("character_id"), "is_narrator",
        F.struct("voice_id", "stability", "similarity_boost", "style", "speed", "seed").alias("voice"))
    narrator = own.filter("is_narrator").groupBy("book_id").agg(F.max_by("voice", "character_id").alias("narrator_voice"))
    return own.drop("is_narrator"), narrator


def resolve_segment_voices(segments: DataFrame, cast: DataFrame, assignments: DataFrame) -> DataFrame:
    """Voice of each segment (with book_id): own character's, else the narrator's, else null."""
    own, narrator = speaker_assignments(cast, assignments)
    # Lines without a speaker get spread keys, so they never meet in one task.
    key = F.coalesce("character_id", -F.abs(F.xxhash64("chapter_id", "idx")) - 1)
    df = segments.withColumn("_key", key).join(own.withColumnRenamed("character_id", "_key"), ["book_id", "_key"], "left")
    df = df.join(narrator, "book_id", "left")
    return df.withColumn("voice", F.coalesce("voice", "narrator_voice")).drop("_key", "narrator_voice")


def missing_voice_names(segments: DataFrame, cast: DataFrame, assignments: DataFrame) -> DataFrame:
    """Names that block rendering: only books whose narrator has no voice can have any."""
    own, narrator = speaker_assignments(cast, assignments)
    books = segments.select("book_id").distinct().join(narrator, "book_id", "left_anti")
    speakers = segments.filter((F.col("kind") != "sfx") & F.col("character_id").isNotNull()).select("book_id", "character_id").distinct()
    uncast = speakers.join(books, "book_id").join(own, ["book_id", "character_id"], "left_anti").join(
        cast.select("book_id", F.col("id").alias("character_id"), "name"), ["book_id", "character_id"], "left")
    return books.select("book_id", F.lit("Narrator").alias("name")).unionByName(
        uncast.select("book_id", F.coalesce("name", F.lit("?")).alias("name"))).distinct()


def cast_voice_list(cast: DataFrame, assignments: DataFrame, voices: DataFrame) -> DataFrame:
    """Assigned voices first (catalog data where known, else a stub), then the rest."""
    used = O.first_by(assignments, ["voice_id"], [F.col("character_id")]).select(F.col("voice_id").alias("id"), F.col("voice_name").alias("_stub"))
    df = used.join(voices.withColumn("_known", F.lit(True)), "id", "full")
    known = F.col("_known").isNotNull()
    return df.select(
        "id", F.when(known, F.col("name")).otherwise(F.col("_stub")).alias("name"),
        F.when(known, F.col("category")).otherwise("cast").alias("category"),
        "gender", "age", "accent", F.col("_stub").isNotNull().alias("is_cast"))
