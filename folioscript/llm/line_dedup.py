"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct runs of five words (a shorter line is one token).
A line is removed when an earlier line (by doc_id, then line number) has a Jaccard
similarity of 0.8 or more; lines of equal token sets are similarity 1.

1. Token counts over all lines, in a table of hash buckets, give one total order,
   rare buckets first. Lines of the same tokens are reduced to one, owned by its first
   occurrence.
2. Two sets that reach the threshold share a token among the first n - ceil(0.8 n)
   + 1 of their ordered tokens (prefix filter). Only these are shuffled, by token;
   tokens of one set alone drop out.
3. Candidates pass the length filter and the positional filter (what can still be
   shared behind the common token). First every set meets the first owner of each
   of its tokens; sets so removed need no other partner, so a family of near
   copies costs a row per member and token. Then the sets still undecided meet all
   earlier ones.
4. The Jaccard similarity of each candidate is computed from both whole sets. These
   come from a second scan that emits the sets in a filter of fixed size.

Words are split at ASCII white space, A-Z in lower case; tokens are compared by
64-bit hashes.

Defined cases: null and empty texts have one line, blank lines are never removed;
rows equal in doc_id and text are one document; a null doc_id comes first; ties
of doc_id and line number are ordered by the hash of the token set; an empty table gives no rows; a
line is held whole by one task, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscript.llm.common import free_name, mix, table, travels
from folioscript.session import cut_lineage

travels(__name__)
WORDS = 5
NUM, DEN = 4, 5  # the similarity threshold, as a fraction
COUNT_BITS = 16  # of the table of token counts
FILTER_BITS = 26  # of the filter of sets to fetch
PIECE = 1 << 20  # bytes of text worked on at once; a longer document stays whole

_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the hash base and of its inverse, as long as the longest piece so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            steps = np.full((2, n), np.array([[_BASE], [_INVERSE]], np.uint64))
            steps[:, 0] = 1
            with np.errstate(over="ignore"):
                cls.up, cls.down = np.cumprod(steps, axis=1, dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def line_tokens(blob: bytes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(line, token) of the tokens of every line of ``blob``, repeats included, in order of lines."""
    data = np.frombuffer(blob.lower(), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    line = np.searchsorted(np.flatnonzero(data == 10), start)
    up, down = Powers.to(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
        word = mix((sums[end] - sums[start]) * down[start])
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        size = np.diff(np.concatenate([first, [len(line)]]))
        run, at, tokens, lines = word, 1, [], []
        while at <= words:
            if at < words:  # lines of exactly so many words
                own = first[size == at]
            else:
                own = np.flatnonzero(line[: len(run)] == line[at - 1 :]) if len(line) >= at else np.empty(0, np.int64)
            tokens.append(mix(run[own] + np.uint64(at)))
            lines.append(line[own])
            if len(run) < 2:
                break
            run, at = mix(run[:-1]) * np.uint64(3) + word[at:], at + 1
    line, token = np.concatenate(lines), np.concatenate(tokens)
    order = np.argsort(line, kind="stable")
    return line[order], token[order]


def starts(line: np.ndarray) -> np.ndarray:
    """Where each line's tokens begin."""
    return np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """Rows of a (.., text) batch in pieces: (row numbers, first line of each row, joined texts)."""
    texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(i)
        size += len(t or b"")
        if size >= PIECE or i == len(texts) - 1:
            parts = [texts[k] or b"" for k in held]
            lines = np.array([p.count(b"\n") + 1 for p in parts])
            yield np.array(held), np.concatenate([[0], np.cumsum(lines)[:-1]]), b"\n".join(parts)
            held, size = [], 0


def bucket_of(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def token_counts(rows: DataFrame, words: int) -> np.ndarray:
    """Occurrences of tokens over all lines, summed into a table of 2 ** COUNT_BITS hash buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            for _, _, blob in pieces(b):
                seen += np.bincount(bucket_of(line_tokens(blob, words)[1]), minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["bucket", "n"])

    sums = rows.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << COUNT_BITS, np.int64)
    out[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def in_order(token: np.ndarray, line: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The tokens of each line sorted by (rank of the bucket, token); ``line`` does not fall."""
    wide = COUNT_BITS + int(line[-1]).bit_length()
    rest = token << np.uint64(COUNT_BITS)  # the bucket is the upper bits
    key = (line.astype(np.uint64) << np.uint64(64 - wide + COUNT_BITS)) | (rank[bucket_of(token)] << np.uint64(64 - wide)) | (rest >> np.uint64(wide))
    order = np.argsort(key)
    token, key = token[order], key[order]
    for i in np.flatnonzero((key[1:] == key[:-1]) & (token[1:] != token[:-1])).tolist():  # alike in all bits that fit
        lo, hi = np.searchsorted(key, key[i], "left"), np.searchsorted(key, key[i], "right")
        token[lo:hi] = np.sort(token[lo:hi])
    return token


def set_ids(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Identity of each line's tokens: an order-free hash, repeats included."""
    with np.errstate(over="ignore"):
        size = np.diff(np.concatenate([first, [len(token)]])).astype(np.uint64)
        return mix(np.add.reduceat(mix(token), first) + size).view(np.int64)


def line_rows(rows: DataFrame, counts: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, rid, line, sid, n, prefix) of every line with words; prefix: its rarest tokens, in order."""
    shared = rows.sparkSession.sparkContext.broadcast(np.argsort(np.argsort(counts, kind="stable")).astype(np.uint64))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for b in batches:
            for row, begins, blob in pieces(b):
                line, token = line_tokens(blob, words)
                if not len(line):
                    continue
                sid = set_ids(token, starts(line))
                token = in_order(token, line, seen)
                new = np.concatenate([[True], (line[1:] != line[:-1]) | (token[1:] != token[:-1])])
                line, token = line[new], token[new]
                first = starts(line)
                n = np.diff(np.concatenate([first, [len(line)]]))
                keep = n - -(-num * n // den) + 1
                ends = np.cumsum(keep)
                at = np.repeat(first - (ends - keep), keep) + np.arange(ends[-1])
                own = np.searchsorted(begins, line[first], side="right") - 1
                take = pa.array(row[own])
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(token[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array((line[first] - begins[own]).astype(np.int32)),
                     pa.array(sid), pa.array(n.astype(np.int32)), prefix], ["doc_id", "rid", "line", "sid", "n", "prefix"])

    return rows.select("doc_id", "rid", "text").mapInArrow(run, f"doc_id {kind}, rid bigint, line int, sid bigint, n int, prefix array<bigint>")


def filter_words(owners: DataFrame) -> np.ndarray:
    """A bit table of fixed size in which the bits of all given lines (sid, doc_id, line) are set."""
    place = F.col("sid").bitwiseXOR(F.xxhash64("doc_id")).bitwiseXOR(F.shiftleft(F.col("line").cast("long"), 64 - FILTER_BITS))
    bits = owners.select(F.shiftrightunsigned(place, 64 - FILTER_BITS).alias("p")).select(
        F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 AS int))").alias("b"))
    words = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out


def token_sets(rows: DataFrame, words: int, owners: DataFrame) -> DataFrame:
    """(sid, tokens): the whole sets of the given lines (sid, doc_id, line), and of some more that the filter lets through."""
    shared = rows.sparkSession.sparkContext.broadcast(filter_words(owners))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value.view(np.uint64)
        for b in batches:
            doc = b.column(0).to_numpy(False)
            for row, begins, blob in pieces(b):
                line, token = line_tokens(blob, words)
                if not len(line):
                    continue
                first = starts(line)
                sid = set_ids(token, first)
                own = np.searchsorted(begins, line[first], side="right") - 1
                place = (sid ^ doc[row[own]] ^ ((line[first] - begins[own]) << (64 - FILTER_BITS))).view(np.uint64) >> np.uint64(64 - FILTER_BITS)
                hit = np.flatnonzero((seen[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
                ends = np.append(first[1:], len(line))
                if len(hit):
                    sets = [np.unique(token[i:j]).view(np.int64) for i, j in zip(first[hit].tolist(), ends[hit].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(sid[hit]), pa.array(sets, pa.list_(pa.int64()))], ["sid", "tokens"])

    return rows.select(F.xxhash64("doc_id").alias("doc"), "text").mapInArrow(run, "sid bigint, tokens array<bigint>").groupBy("sid").agg(F.first("tokens").alias("tokens"))


def may_reach(at: Column, xat: Column, num: int, den: int) -> Column:
    """Length filter, and positional filter for sets whose first common token stands at the given positions.

    ``at`` holds a set's size in its upper and the token's position in its lower 32 bits.
    """
    n, xn = F.shiftright(at, 32), F.shiftright(xat, 32)
    rest, xrest = n - at.bitwiseAND(F.lit(0xFFFFFFFF)), xn - xat.bitwiseAND(F.lit(0xFFFFFFFF))
    least = F.ceil(F.lit(num) * (n + xn) / F.lit(num + den))
    return (num * F.greatest(n, xn) <= den * F.least(n, xn)) & (F.least(rest, xrest) >= least)


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The candidate pairs (sid, xsid, by) whose whole token sets reach the threshold."""
    both = pairs.join(sets, "sid").join(sets.select(F.col("sid").alias("xsid"), F.col("tokens").alias("xtokens")), "xsid")
    common = F.size(F.array_intersect("tokens", "xtokens"))
    return both.filter(common * (num + den) >= num * (F.size("tokens") + F.size("xtokens"))).select("sid", "xsid", "by")


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(rid, removed): per row of ``docs`` with removed lines, identified by :func:`row_id`, an array of
    (line, of_doc, of_line): a removed line's number, and document and number of the earlier line it repeats."""
    rows = docs.select(F.col(key).alias("doc_id"), row_id(key, text).alias("rid"), F.col(text).alias("text"))
    lines = cut_lineage(line_rows(rows, token_counts(rows, words), words, num, den), "lines")
    owner = F.struct("doc_id", "line")
    sets = lines.groupBy("sid").agg(F.min(owner).alias("owner"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))

    # Set size and position travel as one number: these rows are the bulk of what is shuffled.
    postings = sets.select("sid", "n", F.col("owner.doc_id").alias("doc_id"), F.col("owner.line").alias("line"), F.posexplode("prefix").alias("pos", "token")).select(
        "token", "sid", "doc_id", "line", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("at"))
    place = F.struct("doc_id", "line", "sid")
    same = Window.partitionBy("token")
    # Two windows, one shuffle: the struct of ``lead`` is made behind it, for the tokens that are left.
    met_twice = postings.withColumn("many", F.count("*").over(same)).filter("many > 1").drop("many")
    shared = cut_lineage(met_twice.withColumn("lead", F.min(F.struct("doc_id", "line", "sid", "at")).over(same)), "postings")
    whole = cut_lineage(token_sets(rows, words, shared.select("sid", "doc_id", "line")), "sets")

    def candidates(found: DataFrame, x: str) -> DataFrame:
        fits = may_reach(F.col("at"), F.col(f"{x}.at"), num, den)
        return found.filter(fits).select("sid", F.col(f"{x}.sid").alias("xsid"), F.struct(F.col(f"{x}.doc_id").alias("doc"), F.col(f"{x}.line").alias("line")).alias("by")).distinct()

    first = cut_lineage(verified(candidates(shared.filter(F.col("lead.sid") != F.col("sid")), "lead"), whole, num, den), "matches")
    rest = shared.join(first.select("sid").distinct(), "sid", "left_anti")
    other = shared.select("token", F.struct("doc_id", "line", "sid", "at").alias("x"))
    earlier = F.struct("x.doc_id", "x.line", "x.sid") < place
    fits = may_reach(F.col("at"), F.col("x.at"), num, den)
    met = rest.withColumn("not_lead", F.col("lead.sid")).join(other, "token").filter(earlier & (F.col("x.sid") != F.col("not_lead")) & fits)
    second = verified(candidates(met, "x"), whole, num, den)
    matched = first.unionByName(second).groupBy("sid").agg(F.min("by").alias("by"))

    acts = sets.select("sid", "owner", "times").join(matched, "sid", "left").filter("times > 1 OR by IS NOT NULL")
    gone = lines.select("doc_id", "rid", "line", "sid").join(acts, "sid").filter(
        F.col("by").isNotNull() | ~(F.col("doc_id").eqNullSafe(F.col("owner.doc_id")) & (F.col("line") == F.col("owner.line"))))
    of = F.coalesce("by", F.struct(F.col("owner.doc_id").alias("doc"), F.col("owner.line").alias("line")))
    return gone.select("rid", F.struct("line", of["doc"].alias("of_doc"), of["line"].alias("of_line")).alias("r")).groupBy("rid").agg(
        F.array_sort(F.collect_set("r")).alias("removed"))


def row_id(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``; all rows and columns stay."""
    rid, gone_name = free_name(docs, "rid"), free_name(docs, "gone")
    gone = removed_lines(docs, key, text).select(F.col("rid").alias(rid), F.col("removed.line").alias(gone_name))
    joined = docs.withColumn(rid, row_id(key, text)).join(gone, rid, "left").drop(rid)
    names, place = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, drop in zip(b.column(place).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if drop:
                    out = set(drop)
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in out)
                texts.append(t)
            columns = [*b.columns[: len(names)]]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.select(*docs.columns, gone_name).mapInArrow(run, docs.schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    own = docs.select("doc_id", row_id("doc_id", "text").alias("rid"), F.coalesce(lines, F.lit(1)).cast("long").alias("n_lines"))
    found = own.join(removed_lines(docs), "rid", "left")
    removed = F.coalesce("removed", F.from_json(F.lit("[]"), found.schema["removed"].dataType))
    return found.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
