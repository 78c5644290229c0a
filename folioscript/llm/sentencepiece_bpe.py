"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Text is segmented as the model's own encoder does: every character is a symbol,
an agenda holds the adjacent pairs that form a piece, and the best pair (score,
then position) is merged until none is left. With dropout, each candidate that
leaves the agenda is skipped if a hash of (seed, record, position, place) falls
below the rate; a skipped pair returns only as part of another merge. Every sequence
of merges spells the same characters, so all segmentations decode to the same text.

The record is its key and text, the position is the chunk's number in the text: every
occurrence of a word draws its own skips, another seed (an epoch) gives new ones, and
a repeated task gives the same. No piece of such a vocabulary crosses a space or a
line end, so text is cut into chunks there. What a chunk becomes under given skips
does not depend on the record and is remembered; only the draws are made anew.

Defined cases: null text gives null ids, decoded to null; the empty text gives no
ids; characters without a piece are spelled in bytes, and so is a literal U+2581,
which would decode to a space; repeated rows give equal ids; runs of spaces,
leading and trailing ones are kept; very long chunks take n log n steps.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from folioscript.llm.common import mix, ship, table, travels, unship

travels(__name__)
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE, SEED = 0.1, 20_240_101
MEMO = 100_000  # segmentations remembered before a fresh start
PIECE = 1 << 19  # characters of text encoded at once; a longer text stays whole
MARK = "▁"
SHORT = 32  # symbols; a chunk then has fewer than 64 candidates, a bit each
MASK, NONE, FAR, SPREAD = (1 << 64) - 1, 1 << 60, (1 << 31) - 1, 0xD6E8FEB86659FD93


class Vocabulary:
    """Pieces of a SentencePiece BPE model: id and merge rank by string, bytes by id."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.ids, self.byte_ids, self.spell = {}, [-1] * 256, [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.spell[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[piece] = i
                self.spell[i] = piece.replace(MARK, " ").encode()
        if -1 in self.byte_ids:
            raise ValueError("the model has no byte fallback")
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.ranks = {p: order[sp.get_score(i)] for p, i in self.ids.items()}
        crossing = any(re.search(f"[^{MARK}]{MARK}|\n.|.\n", p, re.S) for p in self.ids)
        self.cut = re.compile(r".+" if crossing else r" +[^ \n]*|\n|[^ \n]+", re.S)
        self.code = "H" if n <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)


def segment(symbols: str, ranks: dict[str, int], rate: float = 0.0, key: int = 0) -> list[str]:
    """Pieces of a chunk. ``key`` is the hash that decides, with a pair's place, whether its merge is skipped."""
    n = len(symbols)
    if n < 2:
        return [symbols]
    parts = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    bound = int(rate * (1 << 32))
    known, push, pop = ranks.get, heapq.heappush, heapq.heappop
    agenda = [(r, i, 2) for i, r in enumerate(map(known, map(str.__add__, symbols, symbols[1:]))) if r is not None]
    heapq.heapify(agenda)
    while agenda:
        _, i, size = pop(agenda)
        left = parts[i]
        j = after[i]
        if not left or j >= n:
            continue  # a neighbour was merged elsewhere meanwhile
        right = parts[j]
        if len(left) + len(right) != size:
            continue
        if bound and ((key ^ (i << 20) + size) * SPREAD & MASK) >> 32 < bound:
            continue
        parts[i] = left = left + right
        parts[j] = ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            grown = left + parts[k]
            r = known(grown)
            if r is not None:
                push(agenda, (r, i, len(grown)))
        k = before[i]
        if k >= 0:
            grown = parts[k] + left
            r = known(grown)
            if r is not None:
                push(agenda, (r, k, len(grown)))
    return [p for p in parts if p]


def segment_short(symbols: str, ranks: dict[str, int], rate: float = 0.0, key: int = 0) -> list[str]:
    """What :func:`segment` gives, quicker for a few symbols: the agenda is the plain list of the pairs' ranks."""
    known, bound = ranks.get, int(rate * (1 << 32))
    parts, place = list(symbols), list(range(len(symbols)))
    agenda = [known(pair, NONE) for pair in map(str.__add__, symbols, symbols[1:])]
    while agenda:
        best = min(agenda)
        if best == NONE:
            break
        k = agenda.index(best)
        grown = parts[k] + parts[k + 1]
        if bound and ((key ^ (place[k] << 20) + len(grown)) * SPREAD & MASK) >> 32 < bound:
            agenda[k] = NONE
            continue
        parts[k] = grown
        del parts[k + 1], place[k + 1], agenda[k]
        if k:
            agenda[k - 1] = known(parts[k - 1] + grown, NONE)
        if k < len(agenda):
            agenda[k] = known(grown + parts[k + 1], NONE)
    return parts


def trace(symbols: str, ranks: dict[str, int], skips: tuple[int, ...] = ()) -> tuple[list[str], list[int]]:
    """Pieces when just the candidates of the given numbers are skipped, and the places of all that left the agenda, in order."""
    known = ranks.get
    parts, place = list(symbols), list(range(len(symbols)))
    agenda = [known(pair, NONE) for pair in map(str.__add__, symbols, symbols[1:])]
    places = []
    while agenda:
        best = min(agenda)
        if best == NONE:
            break
        k = agenda.index(best)
        grown = parts[k] + parts[k + 1]
        places.append((place[k] << 20) + len(grown))
        if len(places) - 1 in skips:
            agenda[k] = NONE
            continue
        parts[k] = grown
        del parts[k + 1], place[k + 1], agenda[k]
        if k:
            agenda[k - 1] = known(parts[k - 1] + grown, NONE)
        if k < len(agenda):
            agenda[k] = known(grown + parts[k + 1], NONE)
    return parts, places


class Flat:
    """A one-dimensional array that grows."""

    def __init__(self, kind):
        self.room, self.n = np.empty(1024, kind), 0

    def add(self, values) -> int:
        """Append ``values``; the place of the first."""
        at, self.n = self.n, self.n + len(values)
        if self.n > len(self.room):
            room = np.empty(max(self.n, 2 * len(self.room)), self.room.dtype)  # what is not written yet takes no memory
            room[:at] = self.room[:at]
            self.room = room
        self.room[at : self.n] = values
        return at

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


def spans(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes at, at + 1, .. of every span, one span after the other."""
    ends = np.cumsum(size)
    return np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def bit_length(x: np.ndarray) -> np.ndarray:
    """Of 64-bit values; without runs of ones nothing is rounded up on the way."""
    return np.frexp((x & ~(x >> np.uint64(1))).astype(np.float64))[1].astype(np.int64)


class Merges:
    """Which pairs of pieces make a piece: (left id, right id) -> (rank, id), in an open table for whole arrays of pairs."""

    BITS = 20

    def __init__(self, vocabulary: Vocabulary):
        ids, ranks = vocabulary.ids, vocabulary.ranks
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[ord(" ")] = self.char[ord(MARK)]
        found = [(ids[p[:k]], ids[p[k:]], ranks[p], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        left, right, rank, made = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4
        self.keys, self.rank, self.made = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, FAR, np.int32), np.zeros(1 << self.BITS, np.int32)
        open_, step = np.arange(len(left)), 0
        key = left << 32 | right
        while len(open_):
            slot = self.slot(key[open_], step)
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[open_[free]]  # of several for one slot the last stays
            won = free & (self.keys[slot] == key[open_])
            self.rank[slot[won]], self.made[slot[won]] = rank[open_[won]], made[open_[won]]
            open_, step = open_[~won], step + 1
        self.steps = step

    def slot(self, key: np.ndarray, step: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(SPREAD) >> np.uint64(64 - self.BITS)).astype(np.int64) + step) & ((1 << self.BITS) - 1)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id) of each pair, rank FAR where it makes no piece."""
        key = left.astype(np.int64) << 32 | right
        slot = self.slot(key, 0)
        rank, made = np.full(len(key), FAR, np.int32), self.made[slot]
        have = self.keys[slot]
        same = have == key
        rank[same] = self.rank[slot[same]]
        open_ = np.flatnonzero(~same & (have != -1))
        for step in range(1, self.steps):
            if not len(open_):
                break
            slot = self.slot(key[open_], step)
            have = self.keys[slot]
            same = have == key[open_]
            rank[open_[same]], made[open_[same]] = self.rank[slot[same]], self.made[slot[same]]
            open_ = open_[~same & (have != -1)]
        return rank, made


def trace_all(merges: Merges, symbols: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`trace` of many chunks at once: (alive, ids, places, number of places) by row.

    ``symbols`` has a chunk's characters as ids in each row, -1 behind its end; bit k of ``skips`` skips candidate number k.
    """
    n, width = symbols.shape
    ids = symbols.copy()
    size = np.ones((n, width), np.int64)
    after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
    before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
    last = (symbols >= 0).sum(axis=1)
    rank, made = np.full((n, width), FAR, np.int32), np.zeros((n, width), np.int32)
    r, c = np.nonzero(symbols[:, 1:] >= 0)
    rank[r, c], made[r, c] = merges.look(ids[r, c], ids[r, c + 1])
    places, count = np.zeros((n, 2 * width), np.uint64), np.zeros(n, np.int64)
    live = np.arange(n)
    while len(live):
        k = rank[live].argmin(axis=1)
        go = rank[live, k] < FAR
        live, k = live[go], k[go]
        if not len(live):
            break
        j = after[live, k]
        places[live, count[live]] = (k << 20) + size[live, k] + size[live, j]
        gone = (skips[live] >> count[live].astype(np.uint64)) & np.uint64(1) == 1
        count[live] += 1
        rank[live[gone], k[gone]] = FAR
        row, k, j = live[~gone], k[~gone], j[~gone]
        ids[row, k] = made[row, k]
        size[row, k] += size[row, j]
        ids[row, j] = -1
        rank[row, j] = FAR
        right = after[row, j]
        after[row, k] = right
        some = right < last[row]
        rank[row, k] = FAR
        x, y, z = row[some], k[some], right[some]
        before[x, z] = y
        rank[x, y], made[x, y] = merges.look(ids[x, y], ids[x, z])
        left = before[row, k]
        some = left >= 0
        x, y, z = row[some], left[some], k[some]
        rank[x, y], made[x, y] = merges.look(ids[x, y], ids[x, z])
    return ids >= 0, ids, places, count


class Memo(dict):
    """Short chunk -> node. A node is a chunk under given skips: its ids, and the candidates that leave the agenda after the last skip.

    Skipping one of these leads to another node. All nodes lie in flat arrays, so that the draws of a whole batch of
    occurrences are made at once, a step for each further skip, and the nodes that were never met are worked out
    together. What is remembered depends on the chunk and the skips alone, never on a record.
    """

    LONG = 0  # stands for chunks that are segmented where they occur
    ROWS = 4096

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.merges = vocabulary, Merges(vocabulary)
        self.start()

    def start(self) -> None:
        self.clear()
        self.places, self.next, self.ids, self.symbols = Flat(np.uint32), Flat(np.int32), Flat(self.v.kind), Flat(np.int32)
        self.at, self.id_at, self.sym_at = (Flat(np.int32) for _ in range(3))
        self.size, self.id_size, self.sym_size = (Flat(np.int16) for _ in range(3))
        self.skips, self.odd = Flat(np.uint64), {}
        none, no_skip = np.empty(0, np.int64), np.zeros(1, np.uint64)
        for spelled in ("", MARK):
            ids = self.pack([], spelled.encode())
            self.put(none, np.zeros(1, np.int64), ids, np.array([len(ids)]), np.zeros(1, np.int64), np.zeros(1, np.int64), no_skip)
        self[MARK] = 1

    def put(self, places, sizes, ids, id_sizes, sym_at, sym_size, skips) -> int:
        """Append nodes; the number of the first. ``places`` and ``ids`` are theirs end to end."""
        first = self.at.n
        self.at.add(self.places.add(places) + np.cumsum(sizes) - sizes)
        self.size.add(sizes)
        self.next.add(np.full(len(places), -1))
        self.id_at.add(self.ids.add(ids) + np.cumsum(id_sizes) - id_sizes)
        self.id_size.add(id_sizes)
        self.sym_at.add(sym_at)
        self.sym_size.add(sym_size)
        self.skips.add(skips)
        return first

    def pack(self, pieces: list[str], spelled: bytes = b"") -> np.ndarray:
        v = self.v
        ids = list(map(v.ids.get, pieces))
        if None in ids:
            ids = [x for p, i in zip(pieces, ids, strict=True) for x in ([v.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")] if i is None else [i])]
        return np.array(ids + [v.byte_ids[b] for b in spelled], v.kind)

    def add_nodes(self, sym_at: np.ndarray, sym_size: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """Nodes for chunks given by their symbols, under the given skips."""
        out = np.empty(len(sym_at), np.int64)
        order = np.argsort(sym_size, kind="stable")
        for lo in range(0, len(order), self.ROWS):
            rows = order[lo : lo + self.ROWS]
            size = sym_size[rows]
            symbols = np.full((len(rows), max(1, int(size[-1]))), -1, np.int32)
            symbols[np.repeat(np.arange(len(rows)), size), spans(np.zeros(len(rows), np.int64), size)] = self.symbols.all[spans(sym_at[rows], size)]
            alive, ids, places, count = trace_all(self.merges, symbols, skips[rows])
            skipped = bit_length(skips[rows])  # candidates up to the last skip
            column = np.arange(places.shape[1])
            own = (column >= skipped[:, None]) & (column < count[:, None])
            first = self.put(places[own], own.sum(axis=1), ids[alive], alive.sum(axis=1), sym_at[rows], size, skips[rows])
            out[rows] = first + np.arange(len(rows))
        return out

    def add_odd(self, chunk: str, skips: tuple[int, ...] = ()) -> int:
        """The node of a chunk with characters that are no pieces."""
        pieces, places = trace(chunk.replace(" ", MARK), self.v.ranks, skips)
        places, ids = np.array(places[skips[-1] + 1 if skips else 0 :], np.uint64), self.pack(pieces)
        node = self.put(places, np.array([len(places)]), ids, np.array([len(ids)]), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint64))
        self.odd[node] = chunk, skips
        return node

    def nodes(self, chunks: list[str]) -> np.ndarray:
        """The node of each chunk without skips; long chunks are not remembered, however many there are."""
        short = [c for c in dict.fromkeys(chunks) if c not in self and len(c) <= SHORT]
        if short:
            codes = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), np.uint32)
            size = np.fromiter(map(len, short), np.int64, len(short))
            symbols = self.merges.char[codes]
            at = self.symbols.add(symbols) + np.cumsum(size) - size
            known = np.minimum.reduceat(symbols, np.cumsum(size) - size) >= 0
            made = np.empty(len(short), np.int64)
            made[known] = self.add_nodes(at[known], size[known], np.zeros(int(known.sum()), np.uint64))
            for i in np.flatnonzero(~known).tolist():
                made[i] = self.add_odd(short[i])
            self.update(zip(short, made.tolist(), strict=True))
        return np.fromiter(map(self.get, chunks, repeat(self.LONG)), np.int64, len(chunks))

    def grow(self, slots: np.ndarray) -> None:
        """Work out the nodes that skipping the candidates at ``slots`` leads to."""
        node = np.searchsorted(self.at.all, slots.astype(np.int32), side="right") - 1  # the last of those that start there; only it can have candidates
        nth = slots - self.at.all[node]
        plain = np.ones(len(slots), bool)
        if self.odd:
            for i, (k, n) in enumerate(zip(node.tolist(), nth.tolist(), strict=True)):
                if k in self.odd:
                    chunk, skips = self.odd[k]
                    self.next.room[slots[i]] = self.add_odd(chunk, (*skips, n + (skips[-1] + 1 if skips else 0)))
                    plain[i] = False
        node, nth = node[plain], nth[plain]
        before = self.skips.all[node]
        nth = nth + bit_length(before)
        self.next.room[slots[plain]] = self.add_nodes(self.sym_at.all[node], self.sym_size.all[node], before | np.uint64(1) << nth.astype(np.uint64))

    def drawn(self, nodes: np.ndarray, keys: np.ndarray, bound: int) -> np.ndarray:
        """The nodes in which occurrences with the given hashes end."""
        out, who = nodes.copy(), np.arange(len(nodes))
        while len(who):
            size = self.size.all[nodes]
            at = spans(self.at.all[nodes], size)
            with np.errstate(over="ignore"):
                skip = ((np.repeat(keys, size) ^ self.places.all[at]) * np.uint64(SPREAD)) >> np.uint64(32) < bound
            hit = np.flatnonzero(skip)
            owner = np.searchsorted(np.cumsum(size), hit, side="right")
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(hit) else hit
            place, owner = at[hit[first]], owner[first]
            new = np.unique(place[self.next.all[place] < 0])
            if len(new):
                self.grow(new)
            who, keys, nodes = who[owner], keys[owner], self.next.all[place]
            out[who] = nodes
        return out


class Encoder:
    """Texts -> ids. A text is drawn for in the stream of its record; each occurrence of a chunk draws its own skips."""

    def __init__(self, vocabulary: Vocabulary, rate: float, seed: int, stream: int, memo: Memo | None = None):
        self.v, self.rate, self.memo, self.seed, self.stream = vocabulary, rate, Memo(vocabulary) if memo is None else memo, seed, stream

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, literal marks included."""
        parts = (" " + text).split(MARK)
        chunks = self.v.cut.findall(parts[0])
        for part in parts[1:]:
            chunks.append(MARK)
            chunks += self.v.cut.findall(part)
        return chunks

    def record(self, text: str, stream: int) -> int:
        """Hash of seed, stream and text, from which all draws of a record follow."""
        return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), xxhash.xxh64_intdigest(f"{self.seed}|{stream}"))

    def occurrences(self, text: str) -> tuple[list[str], np.ndarray]:
        """The chunks of a text and each one's hash of seed, record and position."""
        chunks = self.chunks(text)
        return chunks, positions([self.record(text, self.stream)], [len(chunks)])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text], [self.stream])[0]

    def encode_all(self, texts: list[str], streams: list[int]) -> list[np.ndarray]:
        """Ids of each text; a word-start mark is put in front, as the model does. An empty text has none."""
        flat, ends = self.encode_flat(texts, streams)
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode_flat(self, texts: list[str], streams: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin; one more number for the end."""
        split = [self.chunks(t) if t else [] for t in texts]
        sizes = np.array([len(c) for c in split], np.int64)
        chunks = [c for part in split for c in part]
        if not chunks:
            return np.empty(0, self.v.kind), np.zeros(len(texts) + 1, np.int64)
        memo, bound = self.memo, int(self.rate * (1 << 32))
        if memo.at.n > MEMO:
            memo.start()
        del split
        keys = positions([self.record(t, s) for t, s in zip(texts, streams, strict=True)], sizes)
        nodes = memo.nodes(chunks)
        last = memo.drawn(nodes, keys, bound) if bound else nodes
        at, size, ids = memo.id_at.all[last].astype(np.int64), memo.id_size.all[last].astype(np.int64), memo.ids.all
        long = np.flatnonzero(nodes == memo.LONG).tolist()
        if long:
            apart = [memo.pack(segment(chunks[i].replace(" ", MARK), self.v.ranks, self.rate, int(keys[i]))) for i in long]
            size[long] = [len(x) for x in apart]
            at[long] = len(ids) + np.cumsum([0, *map(len, apart[:-1])])
            ids = np.concatenate([ids, *apart])
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids[spans(at, size)], ends


def positions(records: list[int], sizes) -> np.ndarray:
    """A hash for every position of every record."""
    sizes = np.asarray(sizes, np.int64)
    nth = spans(np.zeros(len(sizes), np.int64), sizes).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(np.repeat(np.array(records, np.uint64), sizes) + nth * np.uint64(0x9E3779B97F4A7C15))


def in_pieces(texts: list, keys: list) -> Iterator[tuple[list[str], list[int]]]:
    """Texts, null ones as empty, with the streams of their keys, in pieces of at most about PIECE characters."""
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(i)
        size += len(t or "")
        if size >= PIECE or i == len(texts) - 1:
            yield [texts[k] or "" for k in held], [stream_of(keys[k]) for k in held]
            held, size = [], 0


def decode_ids(ids, vocabulary: Vocabulary) -> bytes:
    """UTF-8 text of ids, without the mark put in front."""
    return b"".join(map(vocabulary.spell.__getitem__, ids))[1:]


def stream_of(key: object) -> int:
    return xxhash.xxh64_intdigest(str(key))


class _encoders:
    """Stream -> its encoder; all share what does not depend on the stream."""

    def __init__(self, vocabulary: Vocabulary, rate: float, seed: int):
        self.v, self.rate, self.seed, self.memo = vocabulary, rate, seed, Memo(vocabulary)

    def __getitem__(self, stream: int) -> Encoder:
        return Encoder(self.v, self.rate, self.seed, stream, self.memo)


def encode(docs: DataFrame, model: str = MODEL, rate: float = RATE, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) per row of ``docs``; rate 0 is the model's own segmentation."""
    shared = ship(docs.sparkSession, Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(unship(shared), rate, seed, 0)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            flat, sizes = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
            for piece in in_pieces(texts, keys):
                ids, ends = encoder.encode_flat(*piece)
                flat.append(ids.astype(np.int32))
                sizes.append(np.diff(ends))
            ends = np.cumsum(np.concatenate(sizes)).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)), mask=b.column(1).is_null())
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """The other columns of ``encoded`` and the decoded ``text`` in place of ``ids``."""
    shared = ship(encoded.sparkSession, Vocabulary(model))
    others = [c for c in encoded.columns if c not in (ids, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = unship(shared)
        for b in batches:
            texts = [None if x is None else decode_ids(x, vocabulary).decode("utf-8", "surrogatepass") for x in b.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(texts, pa.string())], [*others, text])

    kinds = [f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in others]
    return encoded.select(*others, ids).mapInArrow(run, ", ".join([*kinds, f"`{text}` string"]))


def round_trip(docs: DataFrame, model: str = MODEL, rate: float = RATE, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text in one pass: (key, n_pieces, ids_crc32, text_crc32, lossless).

    ids_crc32 is over the ids as little-endian 32-bit numbers, text_crc32 over the decoded UTF-8;
    all are null for a null text.
    """
    shared = ship(docs.sparkSession, Vocabulary(model))
    names = [key, "n_pieces", "ids_crc32", "text_crc32", "lossless"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = unship(shared)
        encoder = Encoder(vocabulary, rate, seed, 0)
        for b in batches:
            keys, texts, rows = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for piece in in_pieces(texts, keys):
                for t, ids in zip(piece[0], encoder.encode_all(*piece), strict=True):
                    back = decode_ids(ids.tolist(), vocabulary)
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(back), back == t.encode("utf-8", "surrogatepass")))
            rows = [(None,) * 4 if t is None else r for t, r in zip(texts, rows, strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.bool_())], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_pieces bigint, ids_crc32 bigint, text_crc32 bigint, lossless boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
