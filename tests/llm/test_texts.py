"""Decontamination, SentencePiece, line dedup and toxicity."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscript.llm import decontamination as D
from folioscript.llm import line_dedup, sentencepiece_bpe, toxicity

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "er"]) for _ in range(n))


def edit_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        cur = [i + 1]
        for j, b in enumerate(t):
            cur.append(min(prev[j] + (a != b), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_leaks_equal_brute_force():
    rng = random.Random(1)
    texts = [prose(rng, 14) for _ in range(12)]
    items = D.Items(list(range(12)), texts)
    for _ in range(60):
        i = rng.randrange(12)
        s = list(texts[i])
        for _ in range(rng.randrange(int(items.edits[i]) + 4)):
            at = rng.randrange(len(s))
            s[at : at + rng.randrange(2)] = rng.choice(["", "z", "q"])
        doc = D.normal(prose(rng, 20) + " " + "".join(s) + " " + prose(rng, 20))
        best = edit_distance(texts[i], doc)
        got = [m[3] for m in items.matches(doc) if m[0] == i]
        assert bool(got) == (best <= items.edits[i]) and (not got or min(got) == best)


def test_leaks_in_a_long_document_and_repeats():
    rng = random.Random(2)
    text = prose(rng, 15)
    items = D.Items(["a"], [text])
    doc = D.normal(" ".join([prose(rng, 9000), text, prose(rng, 50_000), text, text, prose(rng, 10)]))
    got = items.matches(doc)
    assert len(doc) > D.PIECE and [doc[s:e] for _, s, e, _ in got] == [text] * 3


def test_leak_cases(spark, make_docs):
    rng = random.Random(3)
    text = prose(rng, 12)
    bench = spark.createDataFrame([(1, text), (2, None), (3, " "), (4, "tiny"), (None, text.upper())], "item_id long, text string")
    docs = make_docs([(1, f"x {text} y"), (1, f"x {text} y"), (2, None), (3, ""), (None, f"a  {text.replace(' ', chr(10))}"), (5, "a tiny thing"), (6, prose(rng, 30))], clash=True)
    rows = D.find_leaks(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0, r.edits) for r in rows) == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 0), (5, 4, 0)]
    assert sorted(r.doc_id or 0 for r in D.decontaminate(docs, bench).collect()) == [2, 3, 6]
    assert D.find_leaks(docs, bench.limit(0)).count() == 0 and D.find_leaks(docs.limit(0), bench).count() == 0


def test_slices_of_the_benchmark_find_the_same(spark, make_docs, monkeypatch):
    rng = random.Random(4)
    texts = [prose(rng, 12) for _ in range(10)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = make_docs([(i, f"{prose(rng, 9)} {t} {prose(rng, 9)}") for i, t in enumerate(texts)])
    one = sorted(map(tuple, D.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(D, "SLICE_CHARS", 300)
    assert len(one) == 10 and sorted(map(tuple, D.find_leaks(docs, bench).collect())) == one


SAMPLES = ["", " ", "a", "Hello world", "  two  spaces \n\n line\tTab ", "▁mark▁ in ▁▁ text", "日本語 🙂 é", "x" * 3000, "the " * 500, "\n", "end ", "\x00\x01"]


def test_rate_zero_is_the_models_own_segmentation():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.MODEL)
    enc = sentencepiece_bpe.Encoder(sentencepiece_bpe.Vocabulary(), 0.0, 1, 0)
    for t in SAMPLES:
        if "▁" not in t and t:
            assert enc.encode(t).tolist() == sp.encode(t)


def test_dropout_varies_and_decodes(make_docs):
    v = sentencepiece_bpe.Vocabulary()
    some = [sentencepiece_bpe.Encoder(v, 0.3, seed, 0) for seed in (1, 2)]
    rng = random.Random(6)
    text = prose(rng, 200)
    a, b = (e.encode(text).tolist() for e in some)
    assert a != b and a == sentencepiece_bpe.Encoder(v, 0.3, 1, 0).encode(text).tolist()
    docs = make_docs([*enumerate(SAMPLES), (50, None), (None, "null key"), (50, text), (51, text)], clash=True)
    encoded = sentencepiece_bpe.encode(docs, rate=0.3)
    back = sentencepiece_bpe.decode(encoded.join(docs.select("doc_id", F.col("text").alias("was")), "doc_id"))
    assert back.filter(~F.col("text").eqNullSafe(F.col("was"))).filter("doc_id <> 50").count() == 0
    digest = {r.doc_id: r for r in sentencepiece_bpe.round_trip(docs).filter("doc_id <> 50 OR doc_id IS NULL").collect()}
    assert all(r.lossless for r in digest.values()) and digest[0].n_pieces == 0
    assert sentencepiece_bpe.encode(docs.limit(0)).count() == 0


def brute_lines(docs):
    tokens = {}
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            w = line.encode().lower().split()
            if w:
                tokens[i, k] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    out, holders = defaultdict(list), defaultdict(set)
    for at in sorted(tokens):
        own = tokens[at]
        common = Counter(p for x in own for p in holders[x])
        if any(9 * n >= 4 * (len(own) + len(tokens[p])) for p, n in common.items()):
            out[at[0]].append(at[1])
        for x in own:
            holders[x].add(at)
    return out


def test_lines_equal_brute_force(spark, make_docs):
    rng = random.Random(7)
    pool = [prose(rng, n) for n in (1, 2, 4, 5, 6, 12, 30, 40, 60, 90)]

    def vary(line):
        w = line.split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        return " ".join(w)

    docs = [(i, "\n".join(rng.choice(["", vary(rng.choice(pool)), rng.choice(pool).upper(), prose(rng, 20)]) for _ in range(6))) for i in range(60)]
    table = make_docs(docs, clash=True)
    want = brute_lines(docs)
    got = {r.rid: r.removed for r in line_dedup.removed_lines(table).collect()}
    rid = {r.rid: r.doc_id for r in table.select("doc_id", line_dedup.row_id("doc_id", "text").alias("rid")).collect()}
    assert {rid[k]: [x.line for x in v] for k, v in got.items()} == dict(want)
    texts = {r.doc_id: r.text for r in line_dedup.drop_lines(table).collect()}
    for i, t in docs:
        assert texts[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, ()))


def test_line_cases(make_docs):
    docs = make_docs([(2, "same line here"), (1, "same line here\n\n\nsame line here"), (3, None), (4, ""), (None, "same line here"), (None, "same line here"), (5, "w " * 40_000)], clash=True)
    out = line_dedup.drop_lines(docs)
    got = sorted(((r.doc_id or 0), r.text if r.text is None else r.text[:20]) for r in out.filter("doc_id IS NULL OR doc_id <> 3").collect())
    assert got == [(0, "same line here"), (0, "same line here"), (1, "\n"), (2, ""), (4, ""), (5, "w w w w w w w w w w ")]
    assert out.columns == docs.columns and line_dedup.drop_lines(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(300):
        w = prose(rng, 40).split()
        if i % 4 == 0:
            for bad in ("blockhead", "nitwit"):
                w.insert(rng.randrange(len(w)), bad)
        texts.append(". ".join(" ".join(w[k : k + 8]) for k in range(0, len(w), 8)))
        labels.append(int(i % 4 == 0))
    return toxicity.fit(texts, labels)


def test_gapped_and_spaced_insults_score_high(model):
    rng = random.Random(9)
    clean = [prose(rng, 40) for _ in range(20)]
    bad = [f"{prose(rng, 8)}. {prose(rng, 3)} {w} {prose(rng, 4)}. {prose(rng, 8)}." for w in ("blockhead", "nitwit", "block-head", "n i t w i t", "bloxckhead", "NITWIT!!", "nit.wit")]
    s = model.scores([*clean, *bad, None, ""], {})
    assert max(s[:20]) < toxicity.THRESHOLD <= min(s[20:27]) and all(0 <= x <= 1 for x in s) and s[27] == s[28]


def test_kernel_equals_its_definition():
    from itertools import combinations

    def weights(word):
        w, out = f"\x02{word}\x03", defaultdict(float)
        for c in combinations(range(len(w)), 3):
            if c[-1] - c[0] < toxicity.SPAN:
                out["".join(w[i] for i in c)] += toxicity.DECAY ** (c[-1] - c[0] + 1)
        n = sum(toxicity.DECAY ** (2 * (c[-1] - c[0] + 1)) for c in combinations(range(len(w)), 3) if c[-1] - c[0] < toxicity.SPAN) ** 0.5
        return {k: v / n for k, v in out.items()}

    marks = ["idiot", "banana", "x"]
    got = toxicity.Landmarks(marks).kernel(["id.iot", "nab", "banana"])
    for i, w in enumerate(["id.iot", "nab", "banana"]):
        for j, m in enumerate(marks):
            a, b = weights(w), weights(m)
            assert got[i, j] == pytest.approx(min(1.5, sum(v * b.get(k, 0) for k, v in a.items())) ** toxicity.POWER, abs=1e-6)


def test_toxicity_cases(spark, make_docs, model):
    docs = make_docs([(1, "you nitwit"), (2, None), (3, ""), (None, "you nitwit"), (1, "you nitwit"), (4, "alpha bravo"), (5, "nitwit" + "y" * 100_000)], clash=True)
    rows = toxicity.score_texts(docs, model).collect()
    assert len(rows) == 7 and all((r.predicted == 1) == (r.score >= 0.3) for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    kept = toxicity.drop_toxic(docs, model)
    assert {2, 3, 4} <= {r.doc_id for r in kept.collect()} and 1 not in {r.doc_id for r in kept.collect()} and kept.columns == docs.columns
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in toxicity.score_texts(docs, none).collect()} == {0.0}


def test_held_out_accuracy_on_the_given_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_texts(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    hit = [r.predicted for r in rows if r.toxic]
    assert right > 0.9 and sum(hit) / len(hit) > 0.6


def test_both_agendas_merge_alike():
    rng = random.Random(10)
    v = sentencepiece_bpe.Vocabulary()
    for i in range(800):
        chunk = "▁" + "".join(rng.choice(["the", "in", "g", "ou", "é", "1", "日", "s"]) for _ in range(rng.randrange(9)))
        for rate in (0.0, 0.1, 0.7):
            key = rng.getrandbits(64)
            assert sentencepiece_bpe.segment(chunk, v.ranks, rate, key) == sentencepiece_bpe.segment_short(chunk, v.ranks, rate, key)


def test_every_occurrence_draws_its_own_skips(monkeypatch):
    v = sentencepiece_bpe.Vocabulary()
    by = sentencepiece_bpe._encoders(v, 0.3, 7)
    text = "international " * 400
    one = [tuple(sentencepiece_bpe.segment(c.replace(" ", "▁"), v.ranks, 0.3, int(k))) for c, k in zip(*by[1].occurrences(text), strict=True)]
    assert len(set(one)) > 10
    assert len({tuple(by[sentencepiece_bpe.stream_of(k)].encode("international").tolist()) for k in range(400)}) > 10
    monkeypatch.setattr(sentencepiece_bpe, "MEMO", 40)
    rng = random.Random(8)
    for stream, t in enumerate([text, prose(rng, 300), "a▁b " + "long" * 30 + " é日 ", *SAMPLES[1:]]):
        encoder = by[stream]
        want = [sentencepiece_bpe.segment(c.replace(" ", "▁"), v.ranks, 0.3, int(k)) if c != "▁" else ["\0▁"] for c, k in zip(*encoder.occurrences(t), strict=True)]
        ids = [x for pieces in want for p in pieces for x in ([v.ids[p]] if p in v.ids else [v.byte_ids[b] for b in p.removeprefix("\0").encode()] if p[0] != "\0" or len(p) > 1 else [v.byte_ids[0]])]
        assert encoder.encode(t).tolist() == ids and by[stream].encode(t).tolist() == ids


def test_what_an_encoder_remembers_stays_small(spark, make_docs):
    v, rng = sentencepiece_bpe.Vocabulary(), random.Random(5)
    encoder = sentencepiece_bpe.Encoder(v, 0.1, 7, 1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 12))) for _ in range(4000)]
    for k in range(3):
        encoder.encode(" ".join(words) + "".join(f" {'long' * 30}{k}x{i}" for i in range(50)))
    memo = encoder.memo
    assert memo.at.n > 4000 and all(len(c) <= sentencepiece_bpe.SHORT for c in memo)
    flats = [f for f in vars(memo).values() if isinstance(f, sentencepiece_bpe.Flat)]
    assert sum(f.all.nbytes for f in flats) <= 30 * memo.at.n + 8 * memo.places.n + 4 * memo.symbols.n + 4 * memo.ids.n
    texts = ["a b", None, "", " ".join(words[:300]), "é日 " + "long" * 30, None]
    got = {r["doc_id"]: r["ids"] for r in sentencepiece_bpe.encode(make_docs([(i, t) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        one = sentencepiece_bpe.Encoder(v, sentencepiece_bpe.RATE, sentencepiece_bpe.SEED, sentencepiece_bpe.stream_of(i))
        assert got[i] == (None if t is None else one.encode(t).tolist())


def test_toxicity_learns_from_both_kinds_when_the_sentences_are_bounded(monkeypatch):
    """Toxic documents alone fill the bound: clean ones still teach, and held-out texts are ranked."""
    rng = random.Random(17)

    def text(bad):
        lines = [prose(rng, 6) for _ in range(8)]
        if bad:
            lines[rng.randrange(8)] += " you moron " + rng.choice(["idiot", "scum"])
        return ". ".join(lines)

    labels = [int(k % 2 == 0) for k in range(240)]
    texts = [text(y) for y in labels]
    monkeypatch.setattr(toxicity, "FIT_SENTENCES", 600)
    at = [i for i, t in enumerate(texts) for _ in t.split(". ")]
    keep = toxicity.fitting(np.array(at), np.array(labels, bool))
    assert len(keep) <= 600 and 200 <= sum(labels[at[k]] for k in keep) <= 300
    model = toxicity.fit(texts[:160], labels[:160])
    s = model.scores(texts[160:], {})
    good, bad = ([x for x, y in zip(s, labels[160:], strict=True) if y == k] for k in (0, 1))
    assert max(good) < toxicity.THRESHOLD <= min(bad)


def test_toxicity_training_holds_each_word_once():
    texts = ["the same words. the same again", "again the same", None, ""]
    docs = toxicity.shared_words(texts)
    assert docs == [toxicity.sentences(t) for t in texts]
    words = [w for d in docs for s in d for w in s]
    assert len({id(w) for w in words}) == len(set(words)) < len(words)
