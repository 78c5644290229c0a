"""Sharding, SimHash and token counts."""

import random
import zlib

import numpy as np
import pytest
import xxhash

from folioscript.llm import sharding, simhash, token_counts

ROWS = [(1, "Alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, None), (4, ""), (None, "no key"), (None, "no key"), (5, "x " * 50_000), (1, "Alpha beta gamma delta"),
        (6, " \t\n"), (7, "one"), (8, "one two")]


def test_shards_move_rows_only_into_the_new_shard(make_docs):
    rows = sharding.shard_table(make_docs([*ROWS, *[(i, f"text {i}") for i in range(100, 600)]], clash=True)).collect()
    assert len(rows) == len(ROWS) + 500
    by = {}
    for r in rows:
        assert r.grown_shard in (r.shard, sharding.SHARDS) and 0 <= r.shard < sharding.SHARDS and r.law == "key"
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert 5 < sum(r.grown_shard == sharding.SHARDS for r in rows) < 50
    want = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ROWS}
    assert want <= {(r.doc_id, r["size"], r.text_crc32) for r in rows}


def test_weights_and_shrinking(make_docs):
    docs = make_docs([(i, "t") for i in range(4000)])
    w = sharding.place(docs, [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    n = {r["shard"]: r["count"] for r in w}
    assert set(n) == {0, 1} and 2.6 < n[1] / n[0] < 3.4
    both = sharding.place(sharding.place(docs, [1.0] * 5), [1.0] * 4 + [0.0], out="fewer")
    assert both.filter("shard <> 4 AND shard <> fewer").count() == 0


def test_empty_tables(make_docs, spark):
    assert sharding.shard_table(make_docs([])).count() == 0
    assert simhash.near_classes(make_docs([])).count() == 0
    assert token_counts.count_tokens(make_docs([]), ["a"]).count() == 0


def brute_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_fingerprints_equal_the_definition():
    random.seed(3)
    for _ in range(40):
        t = " ".join(random.choice(["Ab", "cd", "É", "x\ty"]) for _ in range(random.randrange(0, 30)))
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    long = " ".join(f"w{i}" for i in range(70_000))
    assert simhash.fingerprint(long) == brute_fingerprint(long)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize(("segments", "hot"), [(2, 64), (3, 64), (4, 64), (2, 1), (3, 2), (4, 4)])
def test_classes_equal_brute_force(spark, segments, hot):
    random.seed(4)
    base = [random.getrandbits(64) for _ in range(30)]
    words = [b ^ sum(1 << k for k in random.sample(range(64), random.randrange(4))) for b in base for _ in range(8)]
    words += [base[0] ^ 1 << a ^ 1 << b for a in range(20) for b in range(a)]  # a crowded neighbourhood
    fps = sorted(set(words))
    signed = {f: int(np.uint64(f).astype(np.int64)) for f in fps}
    found = simhash.links(spark.createDataFrame([(x,) for x in signed.values()], "fp long"), segments, hot)
    assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 2 for r in found.collect())
    got = {r["node"]: r["root"] for r in simhash.components(found).collect()}
    label = {f: signed[f] for f in fps}
    for _ in fps:
        before = dict(label)
        for a in fps:
            label[a] = min(label[b] for b in fps if (a ^ b).bit_count() <= 2)
        if label == before:
            break
    assert {signed[f]: got.get(signed[f], signed[f]) for f in fps} == {signed[f]: label[f] for f in fps}


def test_balls_cover_every_pair_of_bits():
    for segments in (2, 3, 4, 5):
        edges = [64 * k // segments for k in range(segments + 1)]
        for a in range(64):
            for b in range(a + 1):
                differ = [sum(lo <= x < hi for x in {a, b}) for lo, hi in zip(edges, edges[1:], strict=False)]
                assert any(d <= r for d, r in zip(differ, simhash.radii(segments), strict=True))


def test_near_classes_cases(make_docs):
    got = {(r.doc_id, r.component_id) for r in simhash.near_classes(make_docs(ROWS, clash=True)).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (6, 3), (7, 7)} <= got


def test_a_row_without_id_bridges_others(spark, make_docs, monkeypatch):
    words = {"a": 0b0000, "b": 0b0011, "c": 0b1111, "d": 1 << 40 | 1 << 50 | 1 << 60}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, key, text, n: spark.createDataFrame(
        [(1, words["a"]), (None, words["b"]), (5, words["c"]), (None, words["d"])], "doc_id long, fp long"))
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_classes(make_docs([])).collect()), key=str)
    assert got == sorted([(1, 0, 1), (None, 3, 1), (5, 15, 1), (None, words["d"], None)], key=str)


def brute_count(word, pieces):
    i = n = 0
    longest = max(map(len, pieces))
    while i < len(word):
        for size in range(min(longest, len(word) - i), 0, -1):
            if word[i : i + size] in pieces:
                i, n = i + size, n + 1
                break
        else:
            i, n = i + 1, n + len(word[i].encode())
    return n


def test_automaton_equals_greedy_matching():
    random.seed(5)
    for alphabet, pieces in (("abcdx", ["abcd", "ab", "bcx", "a", "b", "d"]), ("ab日", ["aab", "abab", "b"]), ("aé", ["a", "aaaa", "aaé"])):
        a = token_counts.Automaton(pieces)
        for _ in range(1500):
            w = "".join(random.choice(alphabet) for _ in range(random.randrange(12)))
            assert a.count(w) == brute_count(w, set(pieces))
    assert token_counts.Automaton([]).count("ab") == 2


def test_token_counts_of_a_real_vocabulary(make_docs):
    pieces = token_counts.read_pieces()
    rows = token_counts.count_tokens(make_docs(ROWS, clash=True), pieces).collect()
    assert len(rows) == len(ROWS)
    for r, (_, t) in zip(sorted(rows, key=lambda r: (r.doc_id or 0, r.n_words)), sorted(ROWS, key=lambda x: (x[0] or 0, len((x[1] or "").split()))), strict=True):
        parts = (t or "").split()
        assert (r.n_words, r.n_tokens) == (len(parts), sum(brute_count("▁" + w, set(pieces)) for w in parts[:3]) if len(parts) <= 3 else r.n_tokens)
