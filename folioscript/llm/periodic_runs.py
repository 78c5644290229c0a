"""Periodic runs of words by a dictionary of basic factors, and texts collapsed by them.

A run is a stretch of consecutive words with smallest period q (words q apart are
equal) of at least max(6, 4 q) words that no neighbouring word extends. The words
of a text are named by number; the name of a factor of 2 ** (k + 1) words is the
pair of the names of its halves. For each power of two:

1. Positions are sorted by (name, position), which puts the next occurrence of
   every factor beside it. Occurrences within twice the factor's length propose
   their distance as a period.
2. Neighbouring positions that propose one distance q form a progression from s to
   e: words s to e + length + q repeat with period q.
3. In a run of at least 4 q words, a factor of q or more words cannot recur sooner
   than after q words (the run would have a smaller period), so where q is above
   half the length and not above the length, the progression is the whole run: its
   neighbours disagree. Distances outside that range are the same runs again, met
   at another power, and are dropped.
4. Only positions whose factor occurs twice in the text go on to the next power; in
   prose these are few after two or three steps.

A text of n words takes at most log n sorts. Texts are worked on in pieces of bounded
size; a longer text is a piece by itself. Nothing is shuffled.

Words are split at ASCII white space and compared by their bytes. Defined cases: null
and blank texts have no words, no runs and an empty collapsed text; texts shorter than
six words have no runs; a word in several runs is dropped if any of them drops it;
repeated rows give equal results, a null key is kept as it is; an empty table gives no
rows; columns beyond key and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscript.llm.common import table, travels

travels(__name__)
LEAST, TIMES = 6, 4  # a run has at least so many words, and so many periods
PIECE = 4 << 20  # bytes of text worked on at once
SPACE = "[ \\t-\\r]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def factor_runs(names: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period.

    ``names`` numbers the words of one or more texts laid end to end, unlike ones in
    unlike texts; ``ends`` has for every word the position behind its text.
    """
    at, name, size, found = np.arange(len(names)), names, 1, []
    while len(at):
        order = np.argsort(name, kind="stable")
        pos, name = at[order], name[order]
        same = name[1:] == name[:-1]
        gap = pos[1:] - pos[:-1]
        near = np.flatnonzero(same & (gap <= size) & (2 * gap > size))
        if len(near):
            start, period = pos[near], gap[near]
            order = np.argsort(start)
            start, period = start[order], period[order]
            first = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1] + 1) | (period[1:] != period[:-1])]))
            last = np.append(first[1:], len(start)) - 1
            length = start[last] - start[first] + size + period[first]
            keep = length >= np.maximum(least, times * period[first])
            found.append((start[first][keep], length[keep], period[first][keep]))
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        code = np.full(len(names), -1, np.int64)
        code[pos[again]] = np.cumsum(np.concatenate([[True], ~same]))[again]
        at = np.flatnonzero(code >= 0)
        at = at[at + 2 * size <= ends[at]]
        at = at[code[at + size] >= 0]
        name = code[at] * (len(names) + 1) + code[at + size]
        size *= 2
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, length, period = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _texts_in_pieces(texts: list) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t or b"")
        size += len(held[-1])
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def runs_of_texts(texts: list[bytes], least: int = LEAST, times: int = TIMES) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs (start, length, period) and the text without the repeats: words that a run holds behind its first period."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    behind = np.cumsum(sizes)
    number = defaultdict(count().__next__)
    names = np.fromiter((number[x] for w in split for x in w), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(split)), sizes)
    start, length, period = factor_runs(names + doc * len(number), behind[doc], least, times)
    own = doc[start]
    cut = np.searchsorted(own, np.arange(len(split) + 1))
    for i, words in enumerate(split):
        lo, hi = cut[i], cut[i + 1]
        if lo == hi:
            yield [], b" ".join(words)
            continue
        begin = behind[i] - sizes[i]
        runs = list(zip((start[lo:hi] - begin).tolist(), length[lo:hi].tolist(), period[lo:hi].tolist(), strict=True))
        edge = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            edge[s + q] += 1
            edge[s + n] -= 1
        kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
        yield runs, b" ".join([words[k] for k in kept])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(key, runs, collapsed) per row of ``docs``: every run of the text in order, and the text without the runs' repeats."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for b in batches:
            at = 0
            for piece in _texts_in_pieces(b.column(1).cast(pa.binary()).to_pylist()):
                found, texts = zip(*runs_of_texts(piece, least, times), strict=True)
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                offsets = np.concatenate([[0], np.cumsum([len(runs) for runs in found])]).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(item)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(piece)), runs, pa.array(texts, pa.binary()).cast(pa.string())], ["key", "runs", "collapsed"])
                at += len(piece)

    return docs.select(key, text).mapInArrow(run, f"key {kind}, runs {RUNS}, collapsed string").withColumnRenamed("key", key)


def words_of(text: Column) -> Column:
    """The words of a text, in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def with_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) where one text in ten, chosen by the CRC of its key, repeats a stretch of its words from some word on to the end."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    rows = docs.select(F.col(key), F.col(text).alias("text"), h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words_of(F.col("text"))))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = F.col("a").cast("int")
    unit = F.array_join(F.slice("words", at + 1, F.col("p").cast("int")), " ")
    tail = F.col("n") - F.col("a")
    whole = F.floor(tail / F.col("p")).cast("int")
    rest = F.slice("words", at + 1, (tail - whole * F.col("p")).cast("int"))
    repeated = F.array_join(F.concat(F.slice("words", F.lit(1), at), F.array_repeat(unit, whole), rest), " ")
    return rows.select(key, F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Figures and digests of :func:`find_runs`: number of runs, the longest one, and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        key, F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.q")).alias("period"),
        F.expr("1000 * best.n div -best.q").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_runs(with_repeats(table(spark, sf_dir, "documents"))))
