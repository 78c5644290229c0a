"""Cast building: name lookup, merging, variants, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscript.functions.js import is_blank, let, lower_key, trim_ws
from folioscript.operators import ordered as O
from folioscript.session import cut_lineage

QUOTE_MAX = 300
QUOTES_PER_CHARACTER = 5


def dedupe_aliases(aliases: Column, own_name: Column) -> Column:
    """Trimmed aliases in order, without blanks, repeats (any case) or the own name."""
    def add(acc, alias):
        return let(trim_ws(alias), lambda a: F.when(
            (a == "") | (lower_key(own_name) == F.lower(a)) | F.exists(acc, lambda x: F.lower(x) == F.lower(a)), acc
        ).otherwise(F.concat(acc, F.array(a))))

    return F.aggregate(aliases, F.array().cast("array<string>"), add)


def _names(cast: DataFrame) -> DataFrame:
    """Rows (book_id, id, pos, name): the own name at 0, then aliases in order."""
    all_names = F.concat(F.array("name"), F.col("aliases"))
    return cast.select("*", F.posexplode_outer(all_names).alias("pos", "_n")).withColumn("key", lower_key(F.col("_n"))).filter("key <> ''")


def name_dictionary(cast: DataFrame, with_narrator: bool = False) -> DataFrame:
    """(book_id, key) -> character: names beat aliases, then the higher share wins.

    The winner is an aggregate minimum, so a key shared by many rows is combined
    before the shuffle.
    """
    people = cast if with_narrator else cast.filter(~F.col("is_narrator"))
    tier = F.when(F.col("is_narrator"), 0).when(F.col("pos") == 0, 1).otherwise(2)
    rows = _names(people).filter(~F.col("is_narrator") | (F.col("pos") == 0))
    rank = F.struct(tier, -F.col("dialogue_share"), F.col("name"), F.col("id"))
    return rows.groupBy("book_id", "key").agg(F.min_by("id", rank).alias("character_id"))


def resolve_speakers(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add ``character_id`` for ``speaker`` within the mention's book (null when unknown)."""
    return mentions.withColumn("key", lower_key(F.col("speaker"))).join(dictionary, ["book_id", "key"], "left").drop("key")


def match_old_to_new(old_cast: DataFrame, new_dictionary: DataFrame) -> DataFrame:
    """(old_id, new_id): first of the old name, then its aliases, found in the new cast."""
    hits = _names(old_cast).select("book_id", F.col("id").alias("old_id"), "pos", "key").join(new_dictionary, ["book_id", "key"])
    return hits.groupBy("old_id").agg(F.min_by("character_id", "pos").alias("new_id"))


def pov_character(answers: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Narrating character of a chapter; null for low confidence or the book narrator."""
    key = F.when((F.col("confidence") != "low") & (lower_key(F.col("narrator")) != "narrator"), lower_key(F.col("narrator")))
    return answers.withColumn("key", key).join(dictionary, ["book_id", "key"], "left").drop("key")


def name_list_entry(name: Column, aliases: Column, group: Column, label: Column) -> Column:
    aka = F.when(F.size(aliases) > 0, F.concat(F.lit(" (aka "), F.array_join(aliases, ", "), F.lit(")"))).otherwise("")
    stage = F.when(group.isNotNull(), F.concat(F.lit(" — "), group, F.lit(" as: "), F.coalesce(label, F.lit("")))).otherwise("")
    return F.concat(name, aka, stage)


def name_lists(books: DataFrame, cast: DataFrame, page_rows: int = 1000) -> DataFrame:
    """Prompt list of a book's cast, in pages of at most ``page_rows`` entries."""
    people = cast.filter(~F.col("is_narrator"))
    order = [F.col("dialogue_share").desc(), F.col("name"), F.col("id")]
    ranked = O.dense_index(with_share_block(people), ["book_id"], order, "pos", F.col("_share"))
    entry = name_list_entry(F.col("name"), F.col("aliases"), F.col("variant_group"), F.col("variant_label"))
    pages = ranked.groupBy("book_id", F.floor(F.col("pos") / page_rows).cast("long").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["e"]), "\n")
    keys = books.select(F.col("id").alias("book_id"))
    return keys.join(pages.select("book_id", "page", text.alias("names")), "book_id", "left").select(
        "book_id", F.coalesce("page", F.lit(0)).cast("long").alias("page"),
        F.coalesce("names", F.lit('(none listed — use "narrator")')).alias("names"))


SHARE_BLOCKS = 256


def with_share_block(cast: DataFrame, name: str = "_share", rows: int = O.BLOCK_ROWS) -> DataFrame:
    """``cast`` with a block number that never falls along descending dialogue share, in blocks of about equal size.

    The bounds are quantiles of each book's own shares, whatever their scale; a book of up to ``rows`` characters is one block.
    """
    cuts = [k / SHARE_BLOCKS for k in range(1, SHARE_BLOCKS)]
    per = cast.groupBy("book_id").agg(F.count("*").alias("_n"), F.percentile_approx("dialogue_share", cuts, 4 * SHARE_BLOCKS).alias("_cuts"))
    bounds = per.select("book_id", F.when(F.col("_n") > rows, F.array_distinct("_cuts")).otherwise(F.slice("_cuts", 1, 0)).alias("_cuts"))
    above = F.size(F.filter("_cuts", lambda c: c > F.col("dialogue_share")))
    return cast.join(bounds, "book_id").withColumn(name, above.cast("long")).drop("_cuts")


def merge_mentions(mentions: DataFrame, quotes_per_name: int = QUOTES_PER_CHARACTER) -> DataFrame:
    """Fold per-chunk mentions into one row per (book, name key), every name with its rank in the book.

    ``rank`` counts from 1 by mentions, then key; who wants the leading names only
    filters on it. Long value lists are reduced to distinct values and the first
    ``quotes_per_name`` quotes before they are gathered. Names with the same number
    of mentions are a block of their own, so a book is never ranked in one task.
    """
    keyed = mentions.withColumn("key", lower_key(F.col("name"))).filter("key <> ''")
    per = ["book_id", "key"]
    counts = keyed.groupBy(*per).agg(F.count("*").alias("mention_count"), F.min("name").alias("name"))
    aliases = keyed.select(*per, F.explode_outer("aliases").alias("a")).filter("a IS NOT NULL AND a <> ''").distinct().groupBy(*per).agg(
        F.array_sort(F.collect_list("a")).alias("aliases"))
    votes = keyed.groupBy(*per, "gender_hint").agg(F.count("*").alias("n"))
    gender = votes.groupBy(*per).agg(F.min_by("gender_hint", F.struct(-F.col("n"), F.col("gender_hint"))).alias("gender"))
    spoken = keyed.select(*per, "chunk_idx", F.posexplode_outer("quotes").alias("p", "q")).filter("q IS NOT NULL")
    best = O.top_by(spoken, per, [F.col("chunk_idx"), F.col("p"), F.col("q")], quotes_per_name)
    quotes = best.groupBy(*per).agg(F.array_sort(F.collect_list(F.struct("rank", "q"))).alias("_q")).select(
        *per, F.transform("_q", lambda x: x["q"]).alias("quotes"))
    merged = counts.join(aliases, per, "left").join(gender, per, "left").join(quotes, per, "left")
    ranked = O.dense_index(merged, ["book_id"], [F.col("mention_count").desc(), F.col("key")], "rank", -F.col("mention_count"))
    return ranked.withColumn("rank", F.col("rank") + 1)


def _fingerprint(edges: DataFrame) -> tuple:
    """Row count and order-free hash of an edge set (one number each)."""
    h = F.xxhash64("book_id", "u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def alias_components(mentions: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(book_id, key, person): names joined through shared aliases are one person.

    Alternating star contraction: each round links every neighbour of a node to
    the smallest key it knows, directly. Edges never multiply, a hub's links are
    spread over the joins, and the number of rounds is logarithmic. Lineage is
    cut at a written table each round.
    """
    keyed = mentions.withColumn("key", lower_key(F.col("name"))).filter("key <> ''")
    names = keyed.select("book_id", "key").distinct()
    links = keyed.select("book_id", F.col("key").alias("u"), F.explode_outer("aliases").alias("a")).select(
        "book_id", "u", lower_key(F.col("a")).alias("v")).filter("v <> '' AND u <> v").distinct()
    nodes = names.unionByName(links.select("book_id", F.col("v").alias("key"))).distinct()
    edges = cut_lineage(links)
    seen = _fingerprint(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select("book_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("book_id", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(low, ["book_id", "u"]).select("book_id", F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.select("book_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        floor = down.groupBy("book_id", "u").agg(F.min("v").alias("m"))
        joined = down.join(floor, ["book_id", "u"])
        small = joined.select("book_id", F.explode_outer(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select(
            "book_id", "e.u", "e.v").filter("u <> v").distinct()
        edges = cut_lineage(small)
        before, seen = seen, _fingerprint(edges)
        if seen == before:
            break
    else:
        raise RuntimeError("alias components did not settle")
    roots = edges.groupBy("book_id", F.col("u").alias("key")).agg(F.min("v").alias("root"))
    return nodes.join(roots, ["book_id", "key"], "left").select("book_id", "key", F.coalesce("root", "key").alias("person"))


def expand_age_variants(merged: DataFrame) -> DataFrame:
    """One row per life stage where a character has at least two, else one plain row."""
    nothing = F.array(F.lit(None).cast(merged.schema["age_variants"].dataType.elementType))
    plain = F.size("age_variants") < 2
    rows = merged.withColumn("_plain", plain).withColumn(
        "_v", F.explode_outer(F.when(plain, nothing).otherwise(F.col("age_variants"))))
    label = lower_key(F.col("_v.label"))
    name = F.when(F.col("_plain"), F.col("name")).otherwise(F.concat(F.col("name"), F.lit(" ("), label, F.lit(")")))
    own = lambda f: F.when(F.col("_plain") | F.coalesce(is_blank(F.col(f"_v.{f}")), F.lit(True)), F.col(f)).otherwise(F.col(f"_v.{f}"))
    aliases = F.when(F.col("_plain"), F.col("aliases")).otherwise(F.concat(F.array("name"), F.col("aliases")))
    quotes = F.when(~F.col("_plain") & (F.size("_v.quotes") > 0), F.col("_v.quotes")).otherwise(F.col("quotes"))
    return rows.select(
        "book_id", F.col("id").alias("source_id"), name.alias("full_name"),
        dedupe_aliases(aliases, name).alias("all_aliases"), "role",
        F.when(F.col("_plain"), F.col("age_range")).otherwise(F.col("_v.age_range")).alias("stage_age"),
        own("speech_style").alias("stage_style"),
        F.transform(quotes, lambda q: F.left(q, F.lit(QUOTE_MAX))).alias("stage_quotes"),
        F.when(F.col("_plain"), F.col("dialogue_share")).otherwise(F.col("_v.dialogue_share")).alias("stage_share"),
        F.when(~F.col("_plain"), F.col("name")).alias("variant_group"),
        F.when(~F.col("_plain"), label).alias("variant_label"),
    ).withColumnsRenamed({"full_name": "name", "all_aliases": "aliases", "stage_age": "age_range",
                          "stage_style": "speech_style", "stage_quotes": "quotes", "stage_share": "dialogue_share"})


def split_into_variants(cast: DataFrame, commands: DataFrame) -> DataFrame:
    """Apply split commands (character_id, labels, age_ranges).

    The first label keeps the row's id; the others get an id derived from it,
    share 0 and no quotes. Invalid commands come back with ``reject_reason``.
    """
    labels = F.transform("labels", lower_key)
    df = cast.join(commands.withColumnRenamed("character_id", "id"), "id").withColumn("_labels", labels)
    reason = (
        F.when(F.col("is_narrator"), "not_splittable").when(F.col("variant_group").isNotNull(), "already_variant")
        .when((F.size("_labels") < 2) | F.array_contains("_labels", "")
              | (F.size(F.array_distinct("_labels")) != F.size("_labels")), "bad_variants"))
    df = df.withColumn("reject_reason", reason).withColumn(
        "_e", F.explode_outer(F.when(F.col("reject_reason").isNull(), F.transform(
            "_labels", lambda l, i: F.struct(i.alias("i"), l.alias("label"), trim_ws(F.col("age_ranges")[i]).alias("age"))))))
    name = F.concat(F.col("name"), F.lit(" ("), F.col("_e.label"), F.lit(")"))
    return df.select(
        F.col("id").alias("source_id"), "book_id",
        F.when(F.col("_e.i") == 0, F.col("id").cast("string")).when(
            F.col("_e.i") > 0, F.sha2(F.concat_ws("|", F.col("id"), F.col("_e.label")), 256)).alias("character_id"),
        name.alias("variant_name"), F.col("name").alias("variant_group"), F.col("_e.label").alias("variant_label"),
        dedupe_aliases(F.concat(F.array("name"), F.col("aliases")), name).alias("variant_aliases"),
        F.coalesce(F.when(F.col("_e.age") != "", F.col("_e.age")), F.col("age_range")).alias("age_range"),
        F.when(F.col("_e.i") == 0, F.col("dialogue_share")).when(F.col("_e.i") > 0, 0).cast("long").alias("dialogue_share"),
        "reject_reason")


def variant_siblings(cast: DataFrame) -> DataFrame:
    """Strongest other member of each variant's group, and how many others there are.

    Two rows per group are enough to answer for every member; no pairs are built.
    """
    group = ["book_id", "variant_group"]
    members = cast.filter("variant_group IS NOT NULL")
    order = [F.col("dialogue_share").desc(), F.col("name"), F.col("id")]
    lead = O.top_by(members.select(*group, "id", "dialogue_share", "name"), group, order, 2)
    best = lead.groupBy(*group).agg(
        F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("_first"), F.max(F.when(F.col("rank") == 2, F.col("id"))).alias("_second"))
    sizes = members.groupBy(*group).agg((F.count("*") - 1).alias("sibling_count"))
    return members.join(best, group).join(sizes, group).withColumn(
        "sibling_id", F.when(F.col("id") == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))).drop("_first", "_second")


def remove_variants(cast: DataFrame, segments: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop the commanded variants, any number of a group.

    Lines of a removed variant go to the group's strongest member that stays. A
    group is never emptied: where all its members are commanded, the strongest one
    stays. Returns (segments re-pointed with their clip dropped, remaining cast
    where a member left alone is a plain character again).
    """
    group = ["book_id", "variant_group"]
    asked = commands.select(F.col("character_id").alias("id"), F.lit(True).alias("_asked")).distinct()
    members = cast.filter("variant_group IS NOT NULL").select(*group, "id", "dialogue_share", "name").join(asked, "id", "left")
    strength = F.struct((-F.col("dialogue_share")).alias("s"), "name", "id")
    heads = members.groupBy(*group).agg(
        F.coalesce(F.min(F.when(F.col("_asked").isNull(), strength)), F.min(strength))["id"].alias("_to"),
        F.greatest(F.sum(F.when(F.col("_asked").isNull(), 1).otherwise(0)), F.lit(1)).alias("_left"))
    gone = members.filter("_asked").join(heads, group).filter("id <> _to").select("id", "_to", "_left")
    moves = gone.select(F.col("id").alias("_who"), "_to")
    # Lines without a speaker get spread keys, so they never meet in one task.
    who = F.coalesce("character_id", -F.abs(F.xxhash64("chapter_id", "idx")) - 1)
    moved = segments.withColumn("_who", who).join(moves, "_who", "left").withColumns({
        "character_id": F.coalesce("_to", "character_id"),
        "audio_path": F.when(F.col("_to").isNull(), F.col("audio_path"))}).drop("_to", "_who")
    lone = gone.filter("_left = 1").select(F.col("_to").alias("id"), F.lit(True).alias("_lone")).distinct()
    base = F.col("variant_group")
    rest = cast.join(gone.select("id"), "id", "left_anti").join(lone, "id", "left")
    is_lone = F.col("_lone").isNotNull()
    rest = rest.withColumns({
        "name": F.when(is_lone, base).otherwise(F.col("name")),
        "aliases": F.when(is_lone, F.filter("aliases", lambda a: lower_key(a) != F.lower(base))).otherwise(F.col("aliases")),
        "variant_group": F.when(~is_lone, base), "variant_label": F.when(~is_lone, F.col("variant_label"))}).drop("_lone")
    return moved, rest


def reconcile(old_cast: DataFrame, old_assignments: DataFrame, new_cast: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Carry a cast over re-analysis: (old-to-new map, carried assignments, kept profiles)."""
    moves = match_old_to_new(old_cast, name_dictionary(new_cast, with_narrator=True))
    carried = old_assignments.join(moves.withColumnRenamed("old_id", "character_id"), "character_id")
    kept = carried.groupBy("new_id").agg(F.min_by(
        F.struct("voice_id", "voice_name", "overridden", F.col("character_id").alias("old_id")),
        F.struct(~F.col("overridden"), F.col("character_id"))).alias("a")).select("new_id", "a.*")
    exact = new_cast.filter(~F.col("is_narrator")).groupBy("book_id", F.lower("name").alias("key")).agg(
        F.max_by("id", F.struct(-F.col("dialogue_share"), F.col("id"))).alias("new_id"))
    edited = old_cast.filter("profile_edited AND NOT is_narrator").withColumn("key", F.lower("name")).join(exact, ["book_id", "key"])
    profiles = edited.groupBy("new_id").agg(F.max_by("age_range", "id").alias("age_range"))
    return moves, kept, profiles


def repoint_segments(segments: DataFrame, moves: DataFrame) -> DataFrame:
    """Point segments at the new cast; a speaker that vanished leaves a flagged line."""
    who = F.coalesce("character_id", -F.abs(F.xxhash64("chapter_id", "idx")) - 1)  # lines without a speaker are spread
    df = segments.withColumn("_who", who).join(moves.select(F.col("old_id").alias("_who"), "new_id"), "_who", "left").drop("_who")
    lost = F.col("character_id").isNotNull() & F.col("new_id").isNull()
    return df.withColumns({"flagged": F.col("flagged") | lost, "character_id": F.col("new_id")}).drop("new_id")


def list_order(cast: DataFrame) -> DataFrame:
    """Display sort columns: narrator first, then groups by best share, then share."""
    key = F.coalesce("variant_group", "name")
    top = cast.groupBy("book_id", key.alias("group_key")).agg(F.max("dialogue_share").alias("group_rank"))
    return cast.withColumn("group_key", key).join(top, ["book_id", "group_key"])


def measured_share(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """Share of spoken characters per (book, character), measured from the script."""
    spoken = segments.filter((F.col("kind") == "dialogue") & F.col("character_id").isNotNull()).join(
        chapters.select(F.col("id").alias("chapter_id"), "book_id"), "chapter_id")
    per = spoken.groupBy("book_id", "character_id").agg(F.sum(F.length("text")).cast("long").alias("chars"))
    total = per.groupBy("book_id").agg(F.sum("chars").alias("total"))
    return per.join(total, "book_id").withColumn("share", F.col("chars") / F.col("total"))


def cast_order(cast: DataFrame) -> DataFrame:
    """0-based casting position per book and its batch of eight."""
    order = [F.col("is_narrator").desc(), F.col("dialogue_share").desc(), F.col("name"), F.col("id")]
    block = F.when(F.col("is_narrator"), F.lit(-1)).otherwise(F.col("_share"))
    df = O.dense_index(with_share_block(cast), ["book_id"], order, "position", block).drop("_share")
    return df.withColumn("batch", F.floor(F.col("position") / 8).cast("long"))
