"""Periodic runs, document fingerprints and the prefix trie, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscript.llm import fingerprints as P
from folioscript.llm import periodic_runs as R
from folioscript.llm import prefix_trie as T

CLASH = ("key", "h", "n", "p", "q", "a", "g", "words", "runs", "block", "next", "guest", "sketch", "place", "depth", "nth", "class", "name", "top", "turns", "bytes")


def brute_runs(words):
    """Every run, from the definition."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(all(words[k] == words[k + r] for k in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = max(i, j) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_runs_equal_the_definition():
    draw = random.Random(1)
    met = 0
    for _ in range(1500):
        texts = []
        for _ in range(draw.randrange(1, 4)):
            words = []
            for _ in range(draw.randrange(6)):
                unit = [draw.choice("abc") for _ in range(draw.randrange(1, 8))]
                words += (unit * draw.randrange(1, 7))[: draw.randrange(1, 40)]
            texts.append(words)
        for words, (runs, text) in zip(texts, R.runs_of_texts([" ".join(w).encode() for w in texts]), strict=True):
            assert runs == brute_runs(words) and text.decode() == collapsed(words, runs)
            met += len(runs)
    assert met > 1000


RUN_ROWS = [(1, None), (2, ""), (None, "x x x x x x"), (3, " \n\t"), (4, "a b " * 40_000), (5, "A a " * 3), (5, "A a " * 3), (6, "one two three"),
            (7, "é\x0bé é é é é é é é é"), (8, "a a a a a"), (9, "p q " * 4 + "p " * 9)]


def test_runs_of_awkward_rows(spark, make_docs):
    docs = make_docs(RUN_ROWS, clash=True).withColumns({c: F.lit("x") for c in CLASH})
    got = R.find_runs(docs).collect()
    assert len(got) == len(RUN_ROWS)
    for row, (key, text) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.collapsed)), sorted(RUN_ROWS, key=lambda x: (x[0] or 0, len(x[1] or ""))), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want = [(0, 80_000, 2)] if key == 4 else brute_runs(words)
        assert row.doc_id == key and [tuple(r) for r in row.runs] == want and row.collapsed == collapsed(words, want)
    assert R.digest(R.find_runs(R.with_repeats(docs.limit(0)))).count() == 0


def test_the_query_equals_brute_force(spark, make_docs):
    draw = random.Random(4)
    rows = [(i, None if i % 29 == 0 else " ".join(draw.choice(["ab", "c", "dé"]) for _ in range(draw.randrange(60)))) for i in range(300)] + [(None, "z " * 9)]
    want, planted = {}, 0
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(key).encode())
        if key is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want[key] = (len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in R.digest(R.find_runs(R.with_repeats(make_docs(rows)))).collect()}
    assert got == want and planted > 20 and sum(w[0] > 0 for w in want.values()) > 30


def brute_sketch(text, words=P.WORDS, k=P.K):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    grams = {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    return sorted(hashlib.md5(g.encode()).hexdigest()[: P.DIGITS] for g in grams)[:k]


def brute_likeness(a, b, k=P.K):
    union = sorted({*a, *b})[:k]
    return len({*a} & {*b} & {*union}) / len(union) if union else 1.0


DRAW = random.Random(8)
PROSE = [(i, " ".join(DRAW.choice(["Ab", "cd", "éf", "g\nh", "ij"]) for _ in range(DRAW.randrange(1, 400)))) for i in range(0, 90, 3)]
AWKWARD = [(None, "no key"), (None, "no key"), (None, None), (7, "same key"), (7, "other text of this key"), (7, "same key"), (200, None), (201, ""), (202, " "), (203, "x y " * 20_000), (-5, "minus")]


def expected_pairs(rows):
    """Documents in descending order with the next one; rows of one key and equal text are interchangeable."""
    return rows, rows[1:] + rows[:1]


@pytest.mark.parametrize("block_rows", [2, 7, 1000])
def test_next_documents_and_sketches(spark, make_docs, block_rows):
    docs = make_docs(PROSE + AWKWARD, clash=True).withColumns({c: F.lit("x") for c in CLASH})
    hashed = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    unsigned = lambda x: x & (1 << 64) - 1
    order = sorted(PROSE + AWKWARD, key=lambda r: (r[0] is None, -(r[0] or 0), -(unsigned(hashed[r]) >> 11), -hashed[r]))
    want = sorted(((k, t or "", (n[1] or "")) for (k, t), n in zip(order, order[1:] + order[:1], strict=True)), key=str)
    got = P.with_next(docs, block_rows=block_rows).collect()
    assert sorted(((r.doc_id, r.text, r.next_text) for r in got), key=str) == want
    for r in got:
        assert list(r.sketch) == brute_sketch(r.text) and list(r.next_sketch) == brute_sketch(r.next_text)


def test_fingerprint_query_on_small_tables(spark, make_docs, tmp_path):
    for n in (0, 1, 2, len(PROSE)):
        path = str(tmp_path / f"t{n}")
        rows = PROSE[:n]
        make_docs(rows).write.parquet(f"{path}/documents.parquet")
        want = {}
        order = sorted(rows, reverse=True)
        for (key, text), (_, other) in zip(order, order[1:] + order[:1], strict=True):
            cut = len(text) // 3
            new = text[: len(text) - cut] + other[:cut]
            a, b, c = map(brute_sketch, (text, new, other))
            want[key] = (len(text), hashlib.sha256(new.encode()).hexdigest(), "".join(a), "".join(b), brute_likeness(a, b), brute_likeness(a, c))
        assert {r.doc_id: tuple(r)[1:] for r in P.op12_fingerprints(spark, path).collect()} == want


def test_sketches_merge_and_estimate(spark):
    draw = random.Random(2)
    words = [f"w{draw.randrange(10 ** 6)}" for _ in range(6000)]
    parts = [" ".join(words[i : i + 604]) for i in range(0, 6000, 600)]
    rows = spark.createDataFrame([(k % 2, i, t) for k in (0, 1) for i, t in enumerate(parts)] + [(2, 0, None), (2, 1, " ")], "g int, i int, text string")
    made = rows.withColumn("sketch", P.sketch(F.col("text")))
    merged = {r.g: list(r.sketch) for r in P.merge_groups(made, ["g"]).collect()}
    assert merged == {0: brute_sketch(" ".join(words)), 1: brute_sketch(" ".join(words)), 2: []}
    half, whole = " ".join(words[:3000]), " ".join(words)
    one = spark.createDataFrame([(half, whole)], "a string, b string").select(P.sketch(F.col("a")).alias("a"), P.sketch(F.col("b")).alias("b"))
    r = one.select(P.resemblance(F.col("a"), F.col("b")).alias("j"), P.containment(F.col("a"), F.col("b")).alias("c"), P.containment(F.col("b"), F.col("a")).alias("d"),
                   P.distinct_count(F.col("b")).alias("n"), P.merged(F.col("a"), F.col("b")).alias("m"), F.col("b")).first()
    assert abs(r.j - 0.5) < 0.14 and r.c > 0.7 and abs(r.d - 0.5) < 0.2 and abs(r.n / 5996 - 1) < 0.3 and r.m == r.b


def brute_trie(talks):
    """{path: figures} of rebuilt conversations {conv_id: [(role, text), ..]}."""
    members = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        ends = ",".join(map(str, sorted(c for c in own if len(talks[c]) == len(path))))
        out[path] = (min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children),
                     sum(not any(p != x and p[: len(x)] == x for p in below if len(p) == len(x) + 1) for x in below),
                     sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def brute_rebuilt(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def talk_rows(seed, n=60):
    draw = random.Random(seed)
    rows = [(c, t, draw.choice(["user", "assistant", None]), draw.choice(["hi", "é", None, "", "more"])) for c in range(n) if c % 7 for t in range(draw.randrange(1, 12))]
    rows += [(c, t, "user", f"same {t}") for c in range(n, n + 20) for t in range(12)] + [(None, 1, "user", "lost"), (3, None, "system", "first"), (500, 9, "user", "x")]
    return rows


TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("limit", "fan"), [(1 << 17, 1024), (40, 3), (6, 2), (1, 2)])
def test_trie_equals_brute_force(spark, limit, fan):
    rows = talk_rows(limit)
    talks = spark.createDataFrame(rows, TALK).withColumns({c: F.lit("x") for c in CLASH})
    got = T.trie(T.rebuilt(talks), limit, fan)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == names and all(t == "bigint" for _, t in got.dtypes[:-1])
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(brute_rebuilt(rows))


def test_trie_of_plain_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(T.ordered, "BLOCK_ROWS", 50)
    monkeypatch.setattr(T.ordered.rank_block, "__defaults__", (50,))
    rows = [(c, t, "user", f"turn {t}" if c < 3 or t < 100 else f"own {c}") for c in range(4) for t in range(300)] + [(9, 5, None, None), (9, 5, None, None)]
    own = {}
    for c, _, role, text in rows:
        own.setdefault(c, []).append((role or "", text or ""))
    got = T.trie(T.conversations(spark.createDataFrame(rows, TALK)), 100, 4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(own)
    none = spark.createDataFrame([], TALK)
    assert T.trie(T.rebuilt(none)).count() == 0 and T.trie(T.conversations(none)).count() == 0


def test_find_close_equals_a_scan():
    draw = random.Random(6)
    for n in (1, 2, 63, 64, 65, 700, 5000):
        for deep in (0.0, 0.5, 0.97):
            parent = np.array([-1] + [i if draw.random() < deep else draw.randrange(-1, i + 1) for i in range(n - 1)])
            opens, place = T.encode(parent)
            stack, close = [], {}
            for i, o in enumerate(opens.tolist()):
                if o:
                    stack.append(i)
                else:
                    close[stack.pop()] = i
            assert not stack and [close[i] for i in place.tolist()] == T.Parentheses(opens).find_close(place).tolist()
