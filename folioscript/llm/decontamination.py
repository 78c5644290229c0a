"""Benchmark decontamination by the q-gram lemma.

A passage within k edits of an item of m characters shares at least m - q + 1 - kq
q-grams with it, and those lie on diagonals (text position minus item position)
that differ by at most k. So the shared q-grams are counted in overlapping bands
of diagonals, 2(k + 1) wide and k + 1 apart; only bands that reach the bound can
hold a passage, and each is verified by a banded alignment (free start and end in
the text). k is EDIT_RATE of the item's length, less where the bound needs it.

Texts are compared in lower case with white space as one space. Documents are
scanned once per slice of the benchmark; a slice has at most SLICE_CHARS
characters, and its q-gram table is what is broadcast. Documents are never
shuffled, and a long one is scanned in overlapping pieces of whole coverage.

Defined cases: null and blank documents or items match nothing; items shorter
than q must occur literally; repeated documents and equal items are reported each;
an item found several times in a document has one row per passage; a null doc_id
or item_id is carried as null; no document or no item gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscript.llm.common import free_name, ship, table, travels, unship
from folioscript.llm.line_dedup import row_id

travels(__name__)
Q = 10
EDIT_RATE = 0.08
SLICE_CHARS = 2_000_000
PIECE = 1 << 18
FILTER_BITS = 22
PRIME = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(c: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of each run of q characters: a polynomial, built from runs of doubling length."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        run, size, power, out, done = c.astype(np.uint64) + np.uint64(1), 1, PRIME, None, 0
        while True:
            if q & size:  # put the runs of the binary digits of q behind one another
                out = run if out is None else out[: len(run) - done] * power + run[done:]
                done += size
            if done == q:
                h = out[: len(c) - q + 1]
                return h ^ (h >> np.uint64(29))
            run, power, size = run[: len(run) - size] * power + run[size:], power * power, size * 2


class Items:
    """A slice of the benchmark and its q-gram table."""

    def __init__(self, ids: list, texts: list[str], q: int = Q, rate: float = EDIT_RATE):
        self.q = q
        texts = [normal(t) for t in texts]
        live = [i for i, t in enumerate(texts) if t]
        self.ids, self.texts = [ids[i] for i in live], [texts[i] for i in live]
        self.short = [i for i, t in enumerate(self.texts) if len(t) < q]
        m = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.minimum((rate * m).astype(np.int64), np.maximum(0, (m - q) // q))
        self.least = m - q + 1 - self.edits * q
        self.m, self.width = m, self.edits + 1
        grams = [gram_hashes(codes(t), q) for t in self.texts]
        h = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.grams, first, count = np.unique(h[order], return_index=True, return_counts=True)
        self.first, self.count, self.item, self.pos = first, count, item[order], pos[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.grams >> np.uint64(64 - FILTER_BITS)] = True
        self.span = int((m + 2 * self.width + 2 * self.edits).max(initial=0))

    def bands(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) that reach the bound of shared q-grams in a text of codes ``c``; band b holds diagonals from b * width - m."""
        none = np.empty(0, np.int64)
        if not len(self.grams) or len(c) < self.q:
            return none, none
        h = gram_hashes(c, self.q)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - FILTER_BITS)])
        nth = np.searchsorted(self.grams, h[at]).clip(max=len(self.grams) - 1)
        same = self.grams[nth] == h[at]
        at, nth = at[same], nth[same]
        if not len(at):
            return none, none
        times = self.count[nth]
        row = np.repeat(self.first[nth] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        item, diagonal = self.item[row], np.repeat(at, times) - self.pos[row]
        common = np.bincount(item, minlength=len(self.m))[item] >= self.least[item]  # of the whole text: a weaker bound
        item, diagonal = item[common], diagonal[common]
        if not len(item):
            return none, none
        band = (diagonal + self.m[item]) // self.width[item]
        keys, counts = np.unique((np.concatenate([item, item]) << 40) | np.concatenate([band, band - 1]).clip(min=0), return_counts=True)
        found, band = keys >> 40, keys & ((1 << 40) - 1)
        good = counts >= self.least[found]
        return found[good], band[good]

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of each passage in a normalised text."""
        out = []
        for i in self.short:
            at = text.find(self.texts[i])
            while at >= 0:
                out.append((i, at, at + len(self.texts[i]), 0))
                at = text.find(self.texts[i], at + len(self.texts[i]))
        regions: dict[int, list[list[int]]] = {}
        for lo in range(0, max(1, len(text)), PIECE):
            found, band = self.bands(codes(text[lo : lo + PIECE + self.span]))
            for i, b in sorted(zip(found.tolist(), band.tolist(), strict=True)):
                d, e, w = lo + b * int(self.width[i]) - int(self.m[i]), int(self.edits[i]), int(self.width[i])
                parts = regions.setdefault(i, [])
                if parts and d - e <= parts[-1][1] + e:
                    parts[-1][1] = max(parts[-1][1], d + 2 * w)
                else:
                    parts.append([d, d + 2 * w])
        for i, parts in regions.items():
            for low, high in parts:
                out += self.verify(text, i, low, high)
        return sorted(set(out))

    def verify(self, text: str, i: int, low: int, high: int) -> list[tuple[int, int, int, int]]:
        """Passages of item i whose diagonals lie in [low, high]; copies that do not overlap are found one after another."""
        k, m, out, rest = int(self.edits[i]), len(self.texts[i]), [], [(low, high)]
        while rest:
            low, high = rest.pop()
            start = max(0, low - k)
            literal = text.find(self.texts[i], start, max(start, high + m + k))
            hit = (literal, literal + m, 0) if literal >= 0 else align(self.texts[i], text, low - k, high + k, k)
            if hit is None or any(hit[0] < e and s < hit[1] for _, s, e, _ in out):
                continue
            out.append((i, *hit))
            rest += [(a, b) for a, b in ((low, hit[0] - m), (hit[1], high)) if b - a > -k]  # another copy before or behind
        return out


def align(pattern: str, text: str, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best passage on diagonals low to high with at most k edits; the leftmost of equals."""
    m, n = len(pattern), len(text)
    p, width = codes(pattern), high - low + 1
    padded = np.zeros(width + m, np.uint32)
    a, b = max(0, low), min(n, high + m)
    if b <= a:
        return None
    padded[a - low : b - low] = codes(text[a:b])
    unit = 1 << 40
    ramp = np.arange(width, dtype=np.int64)
    far = (m + 2) * unit
    best = np.where((ramp + low >= 0) & (ramp + low <= n), ramp, far)  # edits * unit + start, before the first character
    step = ramp * unit
    for i in range(m):
        here = padded[i : i + width] == p[i]
        inside = (ramp + low + i >= 0) & (ramp + low + i < n)
        kept = best + np.where(here & inside, 0, unit)
        kept[:-1] = np.minimum(kept[:-1], best[1:] + unit)  # a character of the item is missing in the text
        best = np.minimum.accumulate(kept - step) + step  # characters of the text that the item lacks
    best = np.where(ramp + low + m <= n, best, far)
    j = int(best.argmin())
    edits, start = int(best[j]) >> 40, int(best[j]) & (unit - 1)
    return (start + low, j + low + m, edits) if edits <= k else None


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
               item_text: str = "text", q: int = Q, rate: float = EDIT_RATE) -> DataFrame:
    """(key, item, start, end, edits, passage) of every benchmark passage; positions are in the normalised text."""
    items = benchmark.select(F.col(item).alias("id"), F.col(item_text).alias("t")).filter("t IS NOT NULL")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    slices = max(1, -(-chars // SLICE_CHARS))
    kinds = [docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()]
    names = [key, item, "start", "end", "edits", "passage"]
    found = None
    for nth in range(slices):
        own = items.filter(F.pmod(F.xxhash64("t"), F.lit(slices)) == nth).collect()  # at most about SLICE_CHARS characters
        shared = ship(docs.sparkSession, Items([r["id"] for r in own], [r["t"] for r in own], q, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = unship(shared)
            for b in batches:
                rows = []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    t = normal(t)
                    rows += [(k, held.ids[i], s, e, d, t[s:e]) for i, s, e, d in held.matches(t)] if t else []
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1]), *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array(cols[5], pa.string())], names)

        part = docs.select(key, text).mapInArrow(
            run, f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, `start` bigint, `end` bigint, edits bigint, passage string")
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark passage; rows go by key and text, null keys included."""
    rid = free_name(docs, "rid")
    own = docs.withColumn(rid, row_id(key, text))
    leaks = find_leaks(own, benchmark, rid, text).select(rid).distinct()
    return own.join(leaks, rid, "left_anti").select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
