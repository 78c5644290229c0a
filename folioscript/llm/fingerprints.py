"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's words (lower case, split at ASCII white space) give its runs of five words;
a shorter text is one shingle, a blank one none. Every shingle hashes to 16 hex
digits of its MD5, and the sketch is the sorted array of the k smallest distinct
hashes. The sketch of a union of texts is the k smallest of both sketches, so parts
of a text, of a source or of a corpus are sketched apart and merged in any order.

Of two sketches the k smallest hashes of the union are a random sample of the union's
shingles: the share that both hold estimates the resemblance (Jaccard), with a
standard error of at most 1 / (2 sqrt(k)). Where the k-th smallest hash stands tells
the number of distinct shingles. Sketches of fewer than k hashes hold all of them,
and every figure is exact.

All of it is built-in functions of the row: nothing leaves the JVM. A text passes one
shuffle, in :func:`with_next`, which brings each document beside the next one.

Defined cases: null and blank texts have the empty sketch, which resembles another
empty one by 1 and any other by 0; equal texts have equal sketches; a null key comes
last in the descending order; rows of one key are ordered by the hash of their text,
equal rows follow one another; the only document of a table is its own next; an empty
table gives no rows; columns beyond key and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscript.llm.common import table

WORDS, K = 5, 128
DIGITS = 16
SPACE, BLANKS = "[ \\t-\\r]+", " \t\n\x0b\f\r"
BLOCK_ROWS = 500
FAN = 256  # quantiles per level of the search for a row's block
PER_BLOCK = 64  # keys read per block to place the quantiles


def hashes(text: Column, words: int = WORDS) -> Column:
    """The hash of every shingle of ``text``, repeats included."""
    def shingles(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0))), lambda i: F.left(
            F.md5(F.concat_ws(" ", *[F.get(w, i + j) for j in range(words)]).cast("binary")), F.lit(DIGITS)))

    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return F.transform(F.array(F.split(bare, SPACE)), lambda w: F.when(w[0] == "", none).otherwise(shingles(w)))[0]


def smallest(hashed: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashed)), 1, k)


def sketch(text: Column, words: int = WORDS, k: int = K) -> Column:
    return smallest(hashes(text, words), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two sketches."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    place = F.conv(F.left(F.element_at(a, -1), F.lit(12)), 16, 10).cast("double") + 1
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << 48) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set's shingles that the second one has too; 1 for an empty first set."""
    shared = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / F.greatest(distinct_count(a, k), F.lit(1.0))))


def merge_groups(rows: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group: distinct hashes first, then the k smallest of a group, which Spark cuts to k on the map side as well.

    A group of empty sketches has an empty one.
    """
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    found = rows.select(*own, F.explode_outer(column).alias("h")).distinct()
    place = F.row_number().over(Window.partitionBy(*names).orderBy(F.col("h").asc_nulls_last()))
    least = found.withColumn("nth", place).filter(F.col("nth") <= k)
    return least.groupBy(*names).agg(F.sort_array(F.collect_list("h")).alias("s")).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], F.col("s").alias(column))


def _place(key: Column, part: Column) -> Column:
    """A number that never grows along the descending order of key, then ``part`` of the text's hash; null keys come below all others."""
    share = part / float(1 << 53)
    return F.when(key.isNull(), -4e19 + share * 1e19).otherwise(key.cast("double") + share)


def _block_of(place: Column, bounds: list[float]) -> Column:
    """How many of ``bounds`` lie above ``place``: two short scans, of every FAN-th bound, then of those between two of them."""
    def literal(values: list[float]) -> Column:
        return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")

    if not bounds:
        return F.lit(0)
    down = sorted(bounds, reverse=True)
    nth = F.size(F.filter(literal(down[::FAN]), lambda x: x > place))
    inside = F.slice(literal(down), F.greatest(nth - 1, F.lit(0)) * FAN + 1, FAN)
    return F.greatest(nth - 1, F.lit(0)) * FAN + F.size(F.filter(inside, lambda x: x > place))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, text, sketch, next_text, next_sketch) per row: the next document by descending key, after the last one the first.

    Rows are cut into blocks of consecutive keys (at most FAN squared) at quantiles of the
    keys, read from some rows; where they lie decides how even the blocks are, never a
    result. The first row of each block is also dealt to the block before it, so one
    shuffle by block suffices.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("part", F.shiftrightunsigned("h", 11))
    n = rows.count()
    blocks = min(max(1, -(-n // block_rows)), FAN * FAN)
    bounds: list[float] = []
    if blocks > 1:
        some = rows.filter(F.shiftrightunsigned(F.xxhash64("key", "h"), 11) / float(1 << 53) < min(1.0, PER_BLOCK * blocks / n))
        share = [i / blocks for i in range(1, blocks)]
        bounds = sorted(set(some.agg(F.percentile_approx(_place(F.col("key"), F.col("part")), share, 4 * blocks)).first()[0] or []))
    rows = rows.withColumn("block", _block_of(_place(F.col("key"), F.col("part")), bounds))
    # The first place of each block, and the block before it: at most FAN squared rows.
    heads = rows.groupBy("block").agg(F.max(F.struct("key", "part", "h")).alias("head"))
    order = Window.orderBy("block")
    before = F.coalesce(F.lag("block").over(order), F.max("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("block").alias("hb"), F.col("head.key").alias("hk"), F.col("head.h").alias("hh"), before.alias("before"))
    guests = rows.join(F.broadcast(heads), (F.col("block") == F.col("hb")) & (F.col("h") == F.col("hh")) & F.col("key").eqNullSafe(F.col("hk")))
    guests = guests.groupBy(F.col("before").alias("block")).agg(F.first("key").alias("key"), F.first("text").alias("text"))
    both = rows.select("block", "key", "part", "h", "text", F.lit(0).alias("guest")).unionByName(
        guests.select("block", "key", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("h"), "text", F.lit(1).alias("guest")))
    both = both.repartition("block").withColumn("sketch", sketch(F.col("text")))
    along = Window.partitionBy("block").orderBy("guest", F.col("key").desc_nulls_last(), F.col("part").desc(), F.col("h").desc())
    return both.withColumn("next", F.lead(F.struct("text", "sketch")).over(along)).filter("guest = 0").select(
        F.col("key").alias(key), "text", "sketch", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last third replaced by as many code points from the start of ``following``."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.left(text, F.length(text) - cut), F.left(following, cut))


def fingerprint(a: Column) -> Column:
    return F.array_join(a, "")


SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following FROM docs
  WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
edits AS (
  SELECT *, left(text, length(text) - length(text) // 3) || left(following, length(text) // 3) AS edited FROM pairs),
texts AS (SELECT DISTINCT unnest([text, following, edited]) AS t FROM edits),
words AS (SELECT t, list_filter(regexp_split_to_array(lower(t), '[ \\x09-\\x0d]+'), lambda x: x <> '') AS w FROM texts),
hashed AS (
  SELECT t, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1),
    lambda i: left(md5(array_to_string(w[i : i + {WORDS - 1}], ' ')), {DIGITS})) END) AS h FROM words),
ranked AS (SELECT t, h, row_number() OVER (PARTITION BY t ORDER BY h) AS nth FROM (SELECT DISTINCT t, h FROM hashed)),
found AS (SELECT t, list(h ORDER BY h) AS s FROM ranked WHERE nth <= {K} GROUP BY t),
sketches AS (SELECT t, coalesce(s, []) AS s FROM texts LEFT JOIN found USING (t)),
rows AS (
  SELECT e.doc_id, e.text, e.edited, a.s AS sa, b.s AS sb, c.s AS sc,
    list_sort(list_distinct(a.s || b.s))[1:{K}] AS ub, list_sort(list_distinct(a.s || c.s))[1:{K}] AS uc
  FROM edits e JOIN sketches a ON a.t = e.text JOIN sketches b ON b.t = e.edited JOIN sketches c ON c.t = e.following)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
  array_to_string(sa, '') AS fingerprint, array_to_string(sb, '') AS edited_fingerprint,
  CASE WHEN len(ub) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect(sa, sb), ub))::DOUBLE / len(ub) END AS near_edited,
  CASE WHEN len(uc) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_intersect(sa, sc), uc))::DOUBLE / len(uc) END AS near_next
FROM rows
"""


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(table(spark, sf_dir, "documents")).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    pairs = pairs.withColumn("edited_sketch", sketch(F.col("edited")))
    return pairs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
