"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector o is turned by a random rotation P and stored as the signs of Po,
with the correction factor f = <Po, sign(Po)/sqrt(D)>. For another unit vector q,
<Pq, sign(Po)/sqrt(D)> / f is an unbiased estimate of <o, q>; its error is within
EPS * sqrt((1 - f^2) / (f^2 * (D - 1))) but for rare cases. A pair whose upper
bound stays below the threshold is ruled out from codes alone; all other pairs
are recomputed exactly in double precision, and only those at or above it link.

Which pairs are looked at: the turned components also index the vectors. A table
takes a few slices of them; the largest component of each slice, with its sign,
names a cell, and a vector has a place in those cells of a round's tables that lie
nearest to it. How many it needs is measured on random pairs at the threshold, so
that such a pair meets with probability INDEX at any size of the input; up to FEW
vectors of a length all share one cell. A pair that meets in several cells counts
in the least of them only. The places of one round are on disk at a time.

A cell is gone through twice. First with the few signs that travel with a place:
two vectors whose signs differ too often for the threshold are apart, and a place
where that holds for all others is done. Then the vectors of the places that are
left are fetched, estimated and recomputed as above.

Equal vectors are one class with a weight, so copies cost nothing. Large cells
are cut into blocks, and each pair of blocks is a group of its own; a group gives
link counts and a spanning forest per vector, never its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are kept; rows that repeat a vec_id count each;
a null vec_id counts as a partner but names no class; vectors of other lengths
only meet their own kind; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, LongType, StructField, StructType

from folioscript.llm.common import components, mix, table, travels
from folioscript.session import cut_lineage

travels(__name__)
THRESHOLD = 0.9
RECALL = 0.998  # of pairs that are exactly at the threshold; closer ones are found more surely
INDEX = (1 + RECALL) / 2  # of them, those that share a cell: the bounds may lose the rest
EPS = 4.0  # of the error bound: about one pair in 10^4 at the threshold falls outside one code
CODES = 4  # rotations whose estimates are averaged
SIGNS = 192  # that travel with a place
ROUNDS, TABLES, WIDTH, NEAREST = 2, 6, 64, 6  # rounds; tables of each; components of a slice at most; cells of a table that come into question
BUCKET = 256  # vectors that a cell of unrelated vectors holds
FEW = 4096  # vectors of one length that need no index
BLOCK = 1024  # vectors of a cell per block
SMALL = 32  # vectors of a group that is compared along with other groups
WHOLE = 1 << 16  # vectors of a cell that goes on as it is
PART = 1 << 17  # places that are sorted together
SEED = 7


def rotation(dim: int, nth: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, nth]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def best(scores: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` largest scores along the last axis."""
    if scores.shape[-1] <= most:
        return np.broadcast_to(np.arange(scores.shape[-1]), scores.shape)
    return np.argpartition(-scores, most - 1, axis=-1)[..., :most]


class Coder:
    """Signs, correction factors and cells of unit vectors of one length."""

    def __init__(self, dim: int, width: int, slices: int, cells: int = 8):
        self.dim, self.width, self.slices, self.cells = dim, width, slices, cells
        used, tables = slices * width, ROUNDS * TABLES  # a table stays within one rotation where it can: its cells then hold alike many vectors
        first = np.arange(tables) // (dim // used) * dim + np.arange(tables) % (dim // used) * used if 0 < used <= dim else np.arange(tables) * used
        need = max(CODES, -(-SIGNS // dim), -(-int(first[-1] + used) // dim))
        self.turn = np.concatenate([rotation(dim, i) for i in range(need)]).T
        self.index = self.turn[:, (first[:, None] + np.arange(used)).ravel()]

    def nearest(self, unit: np.ndarray, nth: int) -> np.ndarray:
        """The cells of each row in one round, the nearest first."""
        base = self.dim << 44
        if not self.slices:
            return np.full((len(unit), int(nth == 0)), base, np.int64)
        columns, names_of = TABLES * self.slices * self.width, 2 * self.width
        t = (unit @ self.index[:, nth * columns : (nth + 1) * columns]).reshape(len(unit), TABLES, self.slices, self.width)
        few = names_of <= NEAREST  # then a component counts with both signs
        size = (np.concatenate([t, -t], axis=3) if few else np.abs(t)).astype(np.float32)
        at = best(size, NEAREST)
        names = at if few else at + self.width * (np.take_along_axis(t, at, 3) < 0)
        sizes = np.take_along_axis(size, at, 3)
        cell, score = names[:, :, 0], sizes[:, :, 0]
        for k in range(1, self.slices):
            cell = (cell[..., None] * names_of + names[:, :, k, None, :]).reshape(*cell.shape[:2], -1)
            score = (score[..., None] + sizes[:, :, k, None, :]).reshape(cell.shape)
            at = best(score, NEAREST)
            cell, score = np.take_along_axis(cell, at, 2), np.take_along_axis(score, at, 2)
        cell = (cell + (nth * TABLES + np.arange(TABLES)[:, None]) * names_of**self.slices).reshape(len(unit), -1)
        at = np.argsort(-score.reshape(cell.shape), axis=1, kind="stable")[:, : self.cells]
        return np.take_along_axis(cell, at, 1) + base

    def all_cells(self, unit: np.ndarray) -> np.ndarray:
        return np.concatenate([self.nearest(unit, nth) for nth in range(ROUNDS)], axis=1)

    def signs(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(turned vectors, their signs, correction factors), CODES for each."""
        turned = (unit @ self.turn[:, : CODES * self.dim]).reshape(len(unit), CODES, self.dim)
        return turned, turned > 0, np.abs(turned).sum(2) / math.sqrt(self.dim)

    def code(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return *self.signs(unit), self.all_cells(unit)

    def travelling(self, unit: np.ndarray) -> np.ndarray:
        """The signs that travel with the places of each row, 64 to a number."""
        return np.packbits(unit @ self.turn[:, :SIGNS] > 0, axis=1).view(np.uint64)


def meeting(coder: Coder, threshold: float, pairs: int = 8192) -> int:
    """Cells per vector and round with which a share of INDEX of random pairs at the threshold has one in common."""
    rng, need = np.random.default_rng([SEED, coder.dim]), []
    for _ in range(0, pairs, 256):
        x, z = unit_rows(rng.standard_normal((512, coder.dim))).reshape(2, 256, coder.dim)
        if coder.dim > 1:
            z = threshold * x + math.sqrt(1 - threshold**2) * unit_rows(z - (z * x).sum(1, keepdims=True) * x)
        else:
            z = x
        a, b = coder.all_cells(x), coder.all_cells(z)
        nth = np.arange(a.shape[1]) % (a.shape[1] // ROUNDS)
        need.append(np.where(a[:, :, None] == b[:, None, :], np.maximum(nth[:, None], nth), a.shape[1]).min(axis=(1, 2)))
    return int(np.quantile(np.concatenate(need), INDEX, method="higher")) + 1


def plan(n: int, dim: int, threshold: float = THRESHOLD) -> tuple[int, int, int]:
    """(width of a slice, slices of a table, cells of a vector in each round) for ``n`` classes of length ``dim``."""
    cells = 2 * n / BUCKET  # of one table, where a vector is in two of each
    while n > FEW and cells > 2:
        most = [min(WIDTH, dim // k) or min(WIDTH, dim) for k in range(1, 40)]  # at k slices
        slices = next(k for k, w in enumerate(most, 1) if (2 * w) ** k >= cells / 2 or dim == 1)
        width = next(w for w in range(1, most[slices - 1] + 1) if (2 * w) ** slices >= cells or w == most[slices - 1])
        need = meeting(Coder(dim, width, slices, TABLES * NEAREST), threshold)
        if need <= TABLES * NEAREST:
            return width, slices, need
        cells /= 4
    return 1, 0, 1


def estimates(coder: Coder, turned: np.ndarray, signs: np.ndarray, factor: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of stored rows with ``queries`` (turned vectors), and the bound of the error per stored row."""
    est = sum(((2.0 * signs[:, c] - 1) @ queries[:, c].T) / (math.sqrt(coder.dim) * factor[:, c, None]) for c in range(CODES)) / CODES
    bound = EPS * np.sqrt(((1 - factor**2) / (factor**2 * max(1, coder.dim - 1))).clip(0).sum(1)) / CODES
    return est, bound


def unit_rows(flat: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length 1."""
    x = flat.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fingerprint(x: np.ndarray) -> np.ndarray:
    """A 64-bit number per row of doubles."""
    with np.errstate(over="ignore"):
        salt = mix(np.arange(1, x.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return mix(mix(np.ascontiguousarray(x).view(np.uint64) ^ salt).sum(axis=1, dtype=np.uint64)).view(np.int64)


def pack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose components fit 4 bytes each without loss, the matrix in 4 bytes)."""
    with np.errstate(over="ignore", under="ignore"):
        short = x.astype(np.float32)
    return (short == x).all(axis=1), short


def binaries(x: np.ndarray) -> pa.Array:
    """Each row of a matrix as a binary."""
    return pa.Array.from_buffers(pa.binary(), len(x), [
        None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)), pa.py_buffer(np.ascontiguousarray(x))])


def matrices(vecs: pa.Array, dims: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, their vectors in double precision) of packed vectors, for each length."""
    sizes = pc.binary_length(vecs).to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        found, rows = [], []
        for kind in (np.float32, np.float64):
            at = np.flatnonzero((dims == dim) & (sizes == dim * np.dtype(kind).itemsize))
            if len(at):
                found.append(at)
                rows.append(np.frombuffer(b"".join(vecs.take(pa.array(at)).to_pylist()), kind).reshape(len(at), dim).astype(np.float64))
        at = np.concatenate(found)
        order = np.argsort(at)
        yield dim, at[order], np.concatenate(rows)[order]


def keyed(vectors: DataFrame, key: str, embedding: str, vec: bool = True) -> DataFrame:
    """(id, cid, dim, vec) per row: the hash of its vector, the vector's length, and the vector packed if asked for; null where it is of no use."""
    kind = vectors.schema[embedding].dataType
    held = F.col(embedding) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col(embedding).cast("array<double>")
    schema = StructType([StructField("id", vectors.schema[key].dataType), StructField("cid", LongType()), StructField("dim", IntegerType()),
                         StructField("vec", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x = flat[starts[at][:, None] + np.arange(dim)].astype(np.float64) + 0.0  # -0.0 is 0.0
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                fits, short = pack(x)
                for rows, y in ((good & fits, short), (good & ~fits, x), (~good, None)):
                    m = int(rows.sum())
                    if m:
                        none = y is None
                        yield pa.RecordBatch.from_arrays([
                            ids.take(pa.array(at[rows])), pa.nulls(m, pa.int64()) if none else pa.array(fingerprint(x[rows])),
                            pa.array(np.full(m, dim, np.int32)), pa.nulls(m, pa.binary()) if none or not vec else binaries(y[rows])], ["id", "cid", "dim", "vec"])

    return vectors.select(F.col(key).alias("id"), held.alias("vec")).mapInArrow(run, schema)


def vector_classes(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(cid, dim, vec, id, n): each usable vector once, with its smallest key and the number of rows that hold it."""
    return keyed(vectors, key, embedding).filter("cid IS NOT NULL").groupBy("cid", "dim", "vec").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def places(classes: DataFrame, plans: dict, parts: int, nth: int) -> DataFrame:
    """(part, places): the places of many vectors in one round, each as its cell, cid and signs; a cell is in one part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[int, Coder] = {}
        held: list[np.ndarray] = []

        def dealt() -> pa.RecordBatch:
            rows = np.concatenate(held)
            part = (mix(rows[:, 0]) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, rows = part[order], rows[order]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(starts, len(rows)).astype(np.int32) * (rows.shape[1] * 8)
            packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(rows)])
            return pa.RecordBatch.from_arrays([pa.array(part[starts]), packed], ["part", "places"])

        for b in batches:
            cids = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for dim, at, x in matrices(b.column(2), b.column(1).to_numpy(zero_copy_only=False)):
                if dim not in coders:
                    coders[dim] = Coder(dim, *plans.get(dim, (1, 0, 1)))
                unit = unit_rows(x)
                cells, signs = coders[dim].nearest(unit, nth), coders[dim].travelling(unit)
                each = cells.shape[1]
                held.append(np.column_stack([cells.view(np.uint64).ravel(), np.repeat(cids[at], each), np.repeat(signs, each, axis=0)]))
            if sum(map(len, held)) >= PART:
                yield dealt()
                held.clear()
        if sum(map(len, held)):
            yield dealt()

    return classes.select("cid", "dim", "vec").mapInArrow(run, "part int, places binary")


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signs in which columns of ``a`` and ``b`` differ."""
    out = np.bitwise_count(a[0] ^ b[0])
    for k in range(1, len(a)):
        out += np.bitwise_count(a[k] ^ b[k])
    return out


def partners(cells: np.ndarray, signs: np.ndarray, threshold: float) -> np.ndarray:
    """Which places have another in their cell that their signs do not rule out; ``signs`` has a row per 64 signs."""
    apart = math.acos(threshold) / math.pi
    most = int(SIGNS * apart + EPS * math.sqrt(SIGNS * apart * (1 - apart)))
    order = np.argsort(cells, kind="stable")
    starts = np.flatnonzero(np.diff(cells[order], prepend=~cells[order[:1]]))
    sizes = np.diff(np.append(starts, len(cells)))
    large_first = np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())]
    sizes, starts = sizes[large_first], starts[large_first]
    found = np.zeros(len(cells), bool)
    alone = int((sizes > BLOCK).sum())
    for size, start in zip(sizes[:alone].tolist(), starts[:alone].tolist(), strict=True):
        at = order[start : start + size]
        found[at] = True if size > WHOLE else _of_large(np.ascontiguousarray(signs[:, at]), most)
    sizes, starts = sizes[alone:], starts[alone:]
    filler, lo = np.random.default_rng(SEED).integers(0, 1 << 63, (len(signs), BLOCK), dtype=np.uint64), 0
    while lo < len(sizes):  # cells of about equal size, filled up to the largest of them, as many as stay in the processor's cache
        most_of = int(sizes[lo])
        hi = min(len(sizes), lo + max(1, (1 << 14) // most_of))
        size = sizes[lo:hi, None]
        real = np.arange(most_of) < size
        at = order[np.where(real, starts[lo:hi, None] + np.arange(most_of), 0)]
        own = np.where(real, signs[:, at], filler[:, None, :most_of])
        own, hit = np.concatenate([own, own[:, :, : most_of // 2]], axis=2), np.zeros(real.shape, bool)
        for d in range(1, most_of // 2 + 1):  # around the circle, so that half of it reaches every pair
            differ = unlike(own[:, :, :most_of], own[:, :, d : d + most_of])
            if differ.min() <= most:
                row, i = np.divmod(np.flatnonzero(differ <= most), most_of)
                j = (i + d) % most_of
                both = real[row, i] & real[row, j]
                row, i, j = row[both], i[both], j[both]
                hit[row, i] = hit[row, j] = True
        found[at[hit]] = True
        lo = hi
    return found


def _of_large(own: np.ndarray, most: int) -> np.ndarray:
    """As partners, within one cell. A few of its places are held against all of it first, which settles most of a close group."""
    m = own.shape[1]
    hit = np.zeros(m, bool)
    for j in np.unique(np.linspace(0, m - 1, 64).astype(int)).tolist():
        near = unlike(own[:, j, None], own) <= most
        near[j] = False
        hit |= near
        hit[j] |= near.any()
    order = np.argsort(hit, kind="stable")  # the open ones first: each is held against all that follow
    own, hit = np.ascontiguousarray(own[:, order]), hit[order]
    for j in range(int((~hit).sum())):
        near = np.flatnonzero(unlike(own[:, j, None], own[:, j + 1 :]) <= most)
        if len(near):
            hit[near + (j + 1)] = hit[j] = True
    out = np.empty(m, bool)
    out[order] = hit
    return out


def near_places(dealt: DataFrame, threshold: float) -> DataFrame:
    """(cid, cell) of the places whose cell holds another vector that the signs do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at = None

        def close() -> Iterator[pa.RecordBatch]:
            rows = np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2 + SIGNS // 64)
            found = partners(rows[:, 0].view(np.int64), np.ascontiguousarray(rows[:, 2:].T), threshold)
            for lo in range(0, len(rows), PART):
                some = rows[lo : lo + PART][found[lo : lo + PART]].view(np.int64)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(some[:, 1]), pa.array(some[:, 0])], ["cid", "cell"])

        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if part != at and held:
                    yield from close()
                    held.clear()
                at = part
                held.append(data)
        if held:
            yield from close()

    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(run, "cid bigint, cell bigint")


def met(cell: np.ndarray | int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Per row, whether the cells of ``left`` and of ``right`` have one in common that is less than ``cell``."""
    out = np.zeros(len(left), bool)
    for lo in range(0, len(left), 4096):
        some = slice(lo, lo + 4096)
        a, b = left[some], right[some]
        before = a < (cell[some, None] if isinstance(cell, np.ndarray) else cell)
        out[some] = ((a[:, :, None] == b[:, None, :]) & before[:, :, None]).any(axis=(1, 2))
    return out


def met_before(cell: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """As met, for all pairs of a row of ``left`` and one of ``right``."""
    shared = np.intersect1d(left[left < cell], right[right < cell])
    out = np.zeros((len(left), len(right)), bool)
    for lo in range(0, len(shared), 2048):
        some = shared[lo : lo + 2048]
        marks = []
        for cells in (left, right):
            at = np.searchsorted(some, cells).clip(max=len(some) - 1)
            i, j = np.nonzero(some[at] == cells)
            marks.append(np.zeros((len(cells), len(some)), np.float32))
            marks[-1][i, at[i, j]] = 1
        out |= marks[0] @ marks[1].T > 0
    return out


def compare(coder: Coder, cell: int, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs that link and meet first in ``cell``, from (vectors, cells) of two sides; ``right`` None: within ``left``."""
    x, x_cells = left
    y, y_cells = left if right is None else right
    a = coder.signs(x)
    est, bound = estimates(coder, *a, a[0] if right is None else coder.signs(y)[0])
    maybe = est + bound[:, None] >= threshold
    if right is None:
        maybe = np.triu(maybe, 1)
    if np.count_nonzero(maybe) > 1 << 14:
        maybe &= x @ y.T >= threshold
        return maybe & ~met_before(cell, x_cells, y_cells)
    i, j = np.nonzero(maybe)
    maybe[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    i, j = np.nonzero(maybe)
    maybe[i, j] = ~met(cell, x_cells[i], y_cells[j])
    return maybe


def compare_pairs(coder: Coder, cells: np.ndarray, unit: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) of rows link and meet first in the cell of their row; ``own`` has all cells of each row."""
    turned, signs, factor = coder.signs(unit)
    bound = EPS * np.sqrt(((1 - factor**2) / (factor**2 * max(1, coder.dim - 1))).clip(0).sum(1)) / CODES
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), 2048):
        x, y = i[lo : lo + 2048], j[lo : lo + 2048]
        est = (np.einsum("ncd,ncd->nc", 2.0 * signs[x] - 1, turned[y]) / (math.sqrt(coder.dim) * factor[x])).mean(axis=1)
        some = np.flatnonzero(est + bound[x] >= threshold)
        x, y = x[some], y[some]
        close = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
        some, x, y = some[close], x[close], y[close]
        out[lo + some] = ~met(cells[x], own[x], own[y])
    return out


def forest(links: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) that connect what ``links`` connects; v is the smallest id of each part."""
    both = links | links.T
    label = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(both, label[None, :], top).min(axis=1, initial=top))
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != ids)
    return ids[moved], label[moved]


def forest_across(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As forest, where a row of ``links`` is one of ``left`` and a column one of ``right``."""
    top = np.iinfo(np.int64).max
    x, y = left, right
    while True:
        new_x = np.minimum(x, np.where(links, y, top).min(axis=1, initial=top))
        new_y = np.minimum(y, np.where(links, new_x[:, None], top).min(axis=0, initial=top))
        if (new_x == x).all() and (new_y == y).all():
            break
        x, y = new_x, new_y
    ids, label = np.concatenate([left, right]), np.concatenate([x, y])
    moved = np.flatnonzero(label != ids)
    return ids[moved], label[moved]


def forest_of(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As forest, from the pairs (i, j) that link."""
    label = ids.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != ids)
    return ids[moved], label[moved]


def fetched(near: DataFrame, classes: DataFrame, plans: dict) -> DataFrame:
    """(cell, blocks, cid, n, dim, vec, cells) for each of the ``near`` places (cid, cell, blocks); cells has all cells of the vector."""
    at = near.groupBy("cid").agg(F.collect_list(F.struct("cell", "blocks")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[int, Coder] = {}
        for b in batches:
            for dim, rows, x in matrices(b.column(3), b.column(2).to_numpy(zero_copy_only=False)):
                if dim not in coders:
                    coders[dim] = Coder(dim, *plans.get(dim, (1, 0, 1)))
                cells = np.concatenate([coders[dim].all_cells(unit_rows(x[lo : lo + 512])) for lo in range(0, len(x), 512)])
                own = b.take(pa.array(rows))
                lists = own.column(4)
                repeat = pa.array(np.repeat(np.arange(len(rows)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
                cell, blocks = lists.flatten().flatten()
                yield pa.RecordBatch.from_arrays([cell, blocks, *(own.column(k).take(repeat) for k in range(4)), binaries(cells).take(repeat)],
                                                 ["cell", "blocks", "cid", "n", "dim", "vec", "cells"])

    return classes.select("cid", "n", "dim", "vec").join(at, "cid").mapInArrow(
        run, "cell bigint, blocks int, cid bigint, n bigint, dim int, vec binary, cells binary")


def near_links(near: DataFrame, classes: DataFrame, plans: dict, threshold: float) -> DataFrame:
    """(cid, other, n): n other vectors linked to class cid (other null), or an edge of the forest (n null)."""
    big = near.groupBy("cell").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK).select("cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = fetched(near.join(big, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), classes, plans)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cid", F.lit("block")), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least("own", k).alias("lo"), F.greatest("own", k).alias("hi"))))
    dealt = rows.withColumn("pair", pair).select("cell", "pair.lo", "pair.hi", "own", "cid", "n", "dim", "vec", "cells")
    group = ["cell", "lo", "hi"]
    ordered = dealt.repartition(*group).sortWithinPartitions(*group, "own", "cid")

    def of_group(coder: Coder, key: tuple, own: np.ndarray, cid: np.ndarray, n: np.ndarray, unit: np.ndarray, cells: np.ndarray) -> Iterator[tuple]:
        cell, lo, hi = key
        cut = int((own == lo).sum())
        if lo == hi:
            links = compare(coder, cell, (unit, cells), None, threshold)
            yield (links @ n + links.T @ n, *forest(links, cid))
        elif 0 < cut < len(cid):
            links = compare(coder, cell, (unit[:cut], cells[:cut]), (unit[cut:], cells[cut:]), threshold)
            yield (np.concatenate([links @ n[cut:], links.T @ n[:cut]]), *forest_across(links, cid[:cut], cid[cut:]))

    def of_small(coder: Coder, cell: np.ndarray, left: np.ndarray, cid: np.ndarray, n: np.ndarray, unit: np.ndarray, cells: np.ndarray) -> Iterator[tuple]:
        i = np.concatenate([np.flatnonzero(left > d) for d in range(1, SMALL)])
        j = i + np.concatenate([np.full(int((left > d).sum()), d) for d in range(1, SMALL)])
        linked = compare_pairs(coder, cell, unit, cells, i, j, threshold)
        i, j = i[linked], j[linked]
        counts = np.zeros(len(cid), np.int64)
        np.add.at(counts, i, n[j])
        np.add.at(counts, j, n[i])
        yield (counts, *forest_of(i, j, cid))

    def of_groups(b: pa.RecordBatch, coders: dict) -> Iterator[pa.RecordBatch]:
        cell, lo, hi, own, cid, n, dims = (b.column(k).to_numpy(zero_copy_only=False) for k in range(7))
        start = np.flatnonzero((np.diff(cell, prepend=~cell[:1]) != 0) | (np.diff(lo, prepend=-1) != 0) | (np.diff(hi, prepend=-1) != 0))
        size = np.diff(np.append(start, len(cell)))
        sizes, left = np.repeat(size, size), np.repeat(start + size, size) - np.arange(len(cell))
        for dim in np.unique(dims).tolist():
            coder = coders.setdefault(dim, Coder(dim, *plans.get(dim, (1, 0, 1)))) if dim not in coders else coders[dim]

            def rows(at: np.ndarray, dim: int = dim) -> tuple:
                some = pa.array(at)
                unit = unit_rows(next(matrices(b.column(7).take(some), dims[at]))[2])
                return cid[at], n[at], unit, np.frombuffer(b"".join(b.column(8).take(some).to_pylist()), np.int64).reshape(len(at), -1)

            at = np.flatnonzero((dims == dim) & (sizes > 1) & (sizes <= SMALL) & (lo == hi))
            done = [(at, of_small(coder, cell[at], left[at], *rows(at)))] if len(at) else []
            for k in np.flatnonzero((dims[start] == dim) & (size > 1) & ((size > SMALL) | (lo[start] != hi[start]))).tolist():
                at, first = np.arange(start[k], start[k] + size[k]), start[k]
                done.append((at, of_group(coder, (int(cell[first]), int(lo[first]), int(hi[first])), own[at], *rows(at))))
            for at, given in done:
                for counts, u, v in given:
                    some = np.flatnonzero(counts)
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(cid[at][some]), pa.nulls(len(some), pa.int64()), pa.array(counts[some])], ["cid", "other", "n"])
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], ["cid", "other", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[int, Coder] = {}
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < 2 * BLOCK:
                continue
            b = pa.concat_batches(held)
            keys = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
            cut = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
            if cut:
                yield from of_groups(b.slice(0, cut), coders)
            held = [b.slice(cut)]
        if sum(x.num_rows for x in held):
            yield from of_groups(pa.concat_batches(held), coders)

    return ordered.mapInArrow(run, "cid bigint, other bigint, n bigint")


def let_go(spark: SparkSession) -> None:
    """Spark removes the shuffles of what is no longer used when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) per row of ``vectors``."""
    rows = vectors.select(F.col(key).alias("_key"), F.col(embedding).alias("_e"))
    classes = cut_lineage(vector_classes(rows, "_key", "_e"), "vectors")
    let_go(vectors.sparkSession)
    sizes = {r.dim: r["count"] for r in classes.groupBy("dim").count().collect()}
    plans = {dim: plan(n, dim, threshold) for dim, n in sizes.items() if n > FEW}
    parts = -(-sum(n * plans.get(dim, (1, 0, 1))[2] for dim, n in sizes.items()) // PART) or 1
    rounds = []
    for nth in range(ROUNDS if plans else 1):
        rounds.append(cut_lineage(near_places(places(classes, plans, parts, nth), threshold), "places"))
        let_go(vectors.sparkSession)
    found = cut_lineage(near_links(functools.reduce(DataFrame.unionByName, rounds), classes, plans, threshold), "links")
    let_go(vectors.sparkSession)
    counts = found.filter("n IS NOT NULL").groupBy("cid").agg(F.sum("n").alias("links"))
    roots = components(found.filter("other IS NOT NULL").select(F.col("cid").alias("u"), F.col("other").alias("v")))
    named = classes.select("cid", "id").join(roots, F.col("cid") == F.col("node")).select("cid", "id", "root")
    lowest = named.groupBy("root").agg(F.min("id").alias("lowest"))
    linked = named.join(lowest, "root").select("cid", "lowest").join(counts, "cid")
    done = classes.select("cid", "id", "n").join(linked, "cid", "left").select(
        "cid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
        F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("lowest")).alias("component_id"))
    joined = keyed(rows, "_key", "_e", vec=False).select(F.col("id").alias("_key"), "cid").join(done, "cid", "left")
    component = F.coalesce("component_id", "_key")
    return joined.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("_key") == component, F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"), "kept")


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u, min(v) AS low FROM r GROUP BY u), k AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
    e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN c ON e.vec_id = c.u LEFT JOIN k ON e.vec_id = k.u
"""
