"""Toxicity by a string-kernel support vector machine with Nystrom landmarks.

The kernel of two words counts their common subsequences of three characters;
each occurrence weighs DECAY to the power of the length it spans (at most SPAN), so
an insult with gaps or inserted characters still shares most of its weight. The
kernel is normalised and raised to POWER, and the kernel of two sentences is the
sum over their words. Nystrom: landmark words stand for all; a sentence becomes
the vector of its kernels with them, times the inverse root of their own kernels.

A linear squared-hinge machine is trained on sentences: all of clean documents,
and of each toxic document the one that the machine itself finds most toxic,
chosen anew in each round. Toxic documents are also shown with a sign or letter put
into their telling words, clean ones with one into any word. The weights give every word a score, so a text is read
once and each word is scored once. A document's score is a logistic function of its
words' excess over a margin per square root of their number, fitted on what machines
trained on two thirds of the documents say of the rest.

Only labelled rows with crc32(doc_id as text) mod 4 other than 2 are learned from,
at most FIT_TOXIC and FIT_CLEAN of them (lowest hash of the id first) of up to
FIT_CHARS characters. Scoring has no such bound and reads whole texts. Labels,
ids, language and source never enter a score.

Defined cases: null, empty and blank texts get the score of no words; letters set
apart by single spaces are also read as one word; words of over WINDOW characters
score as their best window; equal texts have equal scores; without labelled rows
of both kinds every score is 0; a null doc_id counts as not held out.
"""

from __future__ import annotations

import itertools
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscript.llm.common import ship, table, travels, unship

travels(__name__)
FIT_TOXIC, FIT_CLEAN, FIT_CHARS, FIT_SENTENCES = 1500, 3000, 8000, 60_000
DECAY, SPAN, ORDER, POWER = 0.7, 7, 3, 3
HASH_BITS = 18
SIGNAL, COMMON, OTHER = 64, 16, 24  # landmarks: telling words, frequent words, other words
REGULAR, ROUNDS, MARGIN = 1e-4, 4, 0.5
FOLDS, PRIOR = 3, 1.0
TELLING = 5.2  # standard errors by which a word must be commoner in toxic documents; among thousands of words some reach 5 by chance
WINDOW = 32
MEMO = 800_000  # words whose scores a task remembers
THRESHOLD = 0.3

EDGES = re.compile(r"^\W+|\W+$")


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence, in lower case; a sentence ends with a line, or at . ! or ? before a space."""
    t = (text or "").lower().replace("\n", ". ").replace("! ", ". ").replace("? ", ". ")
    out = [w for w in map(str.split, t.split(". ")) if w]
    for w in out:
        if len(min(w, key=len)) == 1:
            w += spelled_out(w)
    return out


def shared_words(texts: list[str | None]) -> list[list[list[str]]]:
    """The sentences of each text; a word is held once, however often it occurs."""
    held: dict[str, str] = {}
    return [[[held.setdefault(w, w) for w in s] for s in sentences(t)] for t in texts]


def spelled_out(words: list[str]) -> list[str]:
    """Runs of three or more single letters, each as one word."""
    runs = "".join(w if len(w) == 1 and w.isalpha() else " " for w in words).split()
    return [r for r in runs if len(r) > 2]


def trimmed(word: str) -> str:
    return EDGES.sub("", word)


def windows(word: str) -> list[str]:
    """The word, or overlapping windows that cover a very long one."""
    return [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def subsequences(words: list[str]) -> Iterator[tuple[list[int], np.ndarray, float]]:
    """(word numbers, hashes of their subsequences with one pattern of gaps, weight), over all lengths and patterns."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    patterns = list(itertools.combinations(range(1, SPAN), ORDER - 1))
    for size, own in by.items():
        chars = np.frombuffer("".join(f"\x02{words[i]}\x03" for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), size + 2).astype(np.uint64)
        fitting = [p for p in patterns if p[-1] < size + 2]
        norm = sum((size + 2 - p[-1]) * DECAY ** (2 * (p[-1] + 1)) for p in fitting) ** 0.5
        for p in fitting:
            n = size + 2 - p[-1]
            with np.errstate(over="ignore"):
                h = chars[:, :n]
                for gap in p:
                    h = h * np.uint64(0x9E3779B1) + chars[:, gap : gap + n]
                h = (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - HASH_BITS)
            yield own, h.astype(np.int64), DECAY ** (p[-1] + 1) / norm


class Landmarks:
    """Landmark words: for every subsequence that one of them has, its weights in them."""

    def __init__(self, words: list[str]):
        self.words = words
        full: dict[int, dict[int, float]] = {}
        for own, h, w in subsequences(words):
            for row, hashes in zip(own, h.tolist(), strict=True):
                for x in hashes:
                    at = full.setdefault(x, {})
                    at[row] = at.get(row, 0.0) + w
        self.slot = np.zeros(1 << HASH_BITS, np.int32)  # 0: no landmark has it
        self.slot[list(full)] = np.arange(1, len(full) + 1)
        self.count = np.array([0, *(len(x) for x in full.values())])
        self.first = np.cumsum(self.count) - self.count
        self.mark = np.array([k for x in full.values() for k in x], np.int64)
        self.weight = np.array([v for x in full.values() for v in x.values()])

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernel of each word with each landmark."""
        out = np.zeros((len(words), len(self.words)))
        for own, h, w in subsequences(words):
            slot = self.slot[h]
            row, col = np.nonzero(slot)
            if not len(row):
                continue
            slot = slot[row, col]
            times = self.count[slot]
            at = np.repeat(self.first[slot] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            cell = np.repeat(row * len(self.words), times) + self.mark[at]
            out[own] += w * np.bincount(cell, self.weight[at], len(own) * len(self.words)).reshape(len(own), -1)
        return np.minimum(out, 1.5) ** POWER


def squared_hinge(x: np.ndarray, y: np.ndarray, share: np.ndarray, regular: float) -> np.ndarray:
    """Weights (last: bias) that minimise the weighted squared hinge loss, by Newton steps."""
    a = np.ones((len(x), x.shape[1] + 1))
    a[:, :-1] = x
    del x
    w = np.zeros(a.shape[1])
    ridge = np.full(len(w), regular)
    ridge[-1] = 1e-9
    for _ in range(30):
        gap = 1 - y * (a @ w)
        on = gap > 0
        b, s = a[on], share[on]
        gradient = ridge * w - 2 * b.T @ (s * y[on] * gap[on])
        weighed = b * s[:, None]
        step = np.linalg.solve(2 * weighed.T @ b + np.diag(ridge), gradient)
        del b, weighed
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (last: bias) of a regularised logistic regression."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    ridge = np.array([PRIOR] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Landmarks, the machine's weight of each, its bias, and the logistic function of a document's figure."""

    def __init__(self, landmarks: Landmarks | None, beta: np.ndarray | None = None, bias: float = 0.0, final: np.ndarray | None = None):
        self.landmarks, self.beta, self.bias, self.final = landmarks, beta, bias, final

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Score of each word (trimmed of signs at its ends)."""
        parts = [windows(trimmed(w)) for w in words]
        flat = [x for p in parts for x in p]
        scores = self.landmarks.kernel(flat) @ self.beta
        ends = np.cumsum([len(p) for p in parts])
        return np.maximum.reduceat(scores, np.concatenate([[0], ends[:-1]])) if len(flat) else np.empty(0)

    def figure(self, sents: list[list[str]], score: dict[str, float]) -> float:
        """What the words of a document score above the margin, per square root of their number."""
        g = np.fromiter(map(score.__getitem__, itertools.chain.from_iterable(sents)), np.float64)
        return float(np.maximum(0, g - MARGIN).sum() / np.sqrt(max(1, len(g))))

    def scores(self, texts: list[str | None], memo: dict[str, float]) -> list[float]:
        """Score of each text; ``memo`` keeps word scores, with and without signs at the ends, between calls."""
        if self.landmarks is None:
            return [0.0] * len(texts)
        docs = [sentences(t) for t in texts]
        words = set(itertools.chain.from_iterable(itertools.chain.from_iterable(docs)))
        if len(memo) > MEMO:
            memo.clear()
        bare = {w: trimmed(w) for w in words if w not in memo}
        new = [b for b in set(bare.values()) if b not in memo]
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            memo.update(zip(part, self.word_scores(part).tolist(), strict=True))
        memo.update({w: memo[b] for w, b in bare.items()})
        out = []
        for d in docs:
            z = self.figure(d, memo) * self.final[0] + self.final[1]
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out


def pick_landmarks(docs: list[list[list[str]]], toxic: np.ndarray) -> tuple[list[str], dict[str, float]]:
    """Landmark words, and the log odds of the telling ones."""
    seen = [Counter(), Counter()]
    for d, y in zip(docs, toxic, strict=True):
        seen[int(y)].update({w for w in (trimmed(x) for s in d for x in s) if 0 < len(w) <= WINDOW})
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    odds = {w: float(np.log((n + 0.5) / (n1 + 1) / ((seen[0][w] + 0.5) / (n0 + 1)))) for w, n in seen[1].items() if n >= 3}
    worth = {w: (seen[1][w] / n1 - seen[0][w] / n0) / ((seen[1][w] + seen[0][w] + 1) / (n1 + n0) * (1 / n1 + 1 / n0)) ** 0.5
             for w, o in odds.items() if o > 1.5}
    telling = sorted((w for w, z in worth.items() if z > TELLING), key=lambda w: (-worth[w], w))[:SIGNAL]
    frequent = sorted(seen[0], key=lambda w: (-seen[0][w], w))[:COMMON]
    others = sorted((w for w, n in seen[0].items() if n >= 3 and len(w) > 3), key=lambda w: (hash_of(w), w))[:OTHER]
    return list(dict.fromkeys([*telling, *frequent, *others])), {w: odds[w] for w in telling}


def disturbed(doc: list[list[str]], chosen) -> list[list[str]]:
    """The document with a sign or letter put into each word that ``chosen`` names."""
    out = []
    for nth, sent in enumerate(doc):
        now = []
        for w in sent:
            if len(w) > 3 and chosen(w):
                h = hash_of(f"{w}{nth}")
                at = 1 + h % (len(w) - 1)
                w = sys.intern(w[:at] + "-.*_x"[h // 64 % 5] + w[at:])
            now.append(w)
        out.append(now)
    return out


def with_disturbed(docs: list, toxic: np.ndarray, rows: list[int], telling) -> tuple[list, np.ndarray]:
    """The given documents; each toxic one once more with its telling words disturbed, and as many clean ones with one word in ten."""
    bad = [i for i in rows if toxic[i]]
    good = [i for i in rows if not toxic[i]][: len(bad)]
    more = [disturbed(docs[i], lambda w: trimmed(w) in telling) for i in bad] + [disturbed(docs[i], lambda w: hash_of(w) % 10 == 0) for i in good]
    return [docs[i] for i in rows] + more, np.concatenate([toxic[rows], np.ones(len(bad), bool), np.zeros(len(good), bool)])


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def fitting(at: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The sentences a machine is trained on, ``at`` naming the document of each: all, or an even choice of FIT_SENTENCES.

    Either kind of document has at least half the room if it needs it. Toxic documents stay whole, or the sentence that made them so could be missing.
    """
    bad, good = np.flatnonzero(toxic[at]), np.flatnonzero(~toxic[at])
    if len(at) > FIT_SENTENCES:
        own, size = np.unique(at[bad], return_counts=True)
        room = max(FIT_SENTENCES // 2, FIT_SENTENCES - len(good))
        if len(bad) > room:
            n = max(1, int(room / size.mean()))
            bad = bad[np.isin(at[bad], own[np.linspace(0, len(own) - 1, min(n, len(own))).astype(int)])]
        room = max(FIT_SENTENCES // 2, FIT_SENTENCES - len(bad))
        good = good[np.linspace(0, len(good) - 1, min(room, len(good))).astype(int)]
    return np.sort(np.concatenate([bad, good]))


def machine(docs: list, toxic: np.ndarray, rows: list[int]) -> tuple[Model, dict[str, float]]:
    """The word machine trained on the documents in ``rows``, and its telling words."""
    words, odds = pick_landmarks([docs[i] for i in rows], toxic[rows])
    fitted, known = with_disturbed(docs, toxic, rows, odds)
    marks = Landmarks(words)
    own = marks.kernel(words)
    values, vectors = np.linalg.eigh((own + own.T) / 2 + 1e-3 * np.eye(len(words)))
    root = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T

    sents, at = [], []
    for i, d in enumerate(fitted):
        sents += d
        at += [i] * len(d)
    at = np.array(at)
    keep = fitting(at, known)
    sents, at = [sents[k] for k in keep], at[keep]
    vocabulary = list(dict.fromkeys(trimmed(w)[:WINDOW] for s in sents for w in s))
    place = {w: k for k, w in enumerate(vocabulary)}
    kernels = np.concatenate([marks.kernel(vocabulary[lo : lo + 8192]).astype(np.float32) for lo in range(0, len(vocabulary), 8192)])
    sums = np.empty((len(sents), len(words)), np.float32)
    for k, s in enumerate(sents):
        sums[k] = kernels[[place[trimmed(w)[:WINDOW]] for w in s]].sum(axis=0)
    x = sums @ root
    del sums, kernels
    score = np.array([max(odds.get(trimmed(w), 0.0) for w in s) for s in sents])
    clean = np.flatnonzero(~known[at])
    groups = [np.flatnonzero(at == i) for i in sorted(set(at[known[at]].tolist()))]
    for _ in range(ROUNDS):
        worst = np.array([g[score[g].argmax()] for g in groups])
        rows_ = np.concatenate([worst, clean])
        y = np.concatenate([np.ones(len(worst)), -np.ones(len(clean))])
        share = np.concatenate([np.full(len(worst), 0.5 / len(worst)), np.full(len(clean), 0.5 / len(clean))])
        w = squared_hinge(x[rows_], y, share, REGULAR)
        score = x @ w[:-1] + w[-1]
    return Model(marks, root @ w[:-1], float(w[-1])), odds


def fit(texts: list[str], labels: list[int]) -> Model:
    """Train on labelled texts. The logistic function is fitted on figures that machines trained without the document gave it."""
    toxic = np.array(labels, bool)
    docs = shared_words(texts)
    rows = [i for i in range(len(docs)) if docs[i]]
    order = {i: k for kind in (True, False) for k, i in enumerate(i for i in rows if toxic[i] == kind)}
    if not rows or toxic[rows].all() or toxic[rows].sum() < FOLDS:
        return Model(None)
    figures, truth = [], []
    for fold in range(FOLDS):
        model, odds = machine(docs, toxic, [i for i in rows if order[i] % FOLDS != fold])
        checked, known = with_disturbed(docs, toxic, [i for i in rows if order[i] % FOLDS == fold], odds)
        memo: dict[str, float] = {}
        words = list({w for d in checked for s in d for w in s})
        for lo in range(0, len(words), 8192):
            part = words[lo : lo + 8192]
            memo.update(zip(part, model.word_scores(part).tolist(), strict=True))
        figures += [[model.figure(d, memo)] for d in checked]
        truth.append(known)
    final = logistic(np.array(figures), np.concatenate(truth).astype(float))
    final[0] = max(final[0], 0.0)
    model, _ = machine(docs, toxic, rows)
    model.final = final
    return model


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> list:
    """The bounded sample of labelled texts, in order of the hash of their ids."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.filter("toxic = 1").orderBy(*order).limit(FIT_TOXIC).unionByName(known.filter("toxic = 0").orderBy(*order).limit(FIT_CLEAN))
    rows = docs.select("doc_id", "text").filter(F.length("text") <= FIT_CHARS).join(ids, "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return rows.withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").collect()


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels)
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def score_texts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) per row of ``docs``."""
    shared = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        held = unship(shared)
        for b in batches:
            scores = held.scores(b.column(1).to_pylist(), memo)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], [key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; all columns stay."""
    names, place = docs.columns, docs.columns.index(text)
    shared = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        held = unship(shared)
        for b in batches:
            scores = held.scores(b.column(place).to_pylist(), memo)
            yield pa.RecordBatch.from_arrays(b.columns, names).filter(pa.array([s < THRESHOLD for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
