"""The whole pipeline against brute-force versions of its decisions, and the registry."""

import random

import __spark_entry__ as entry
import corpus_pipeline
from folioscript.llm import decontamination, near_dedup, sentencepiece_bpe, simhash, toxicity
from test_texts import brute_lines

DIR = "/root/testdata/sf0.001"


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in entry.queries()


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + corpus_pipeline.SHINGLE_WORDS]) for i in range(max(1, len(w) - 4)))


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    # The given documents, and near copies of some of them: a word in sixty is another one.
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    draw, given = random.Random(6), docs.filter("n_chars > 2000").orderBy("doc_id").limit(6).collect()
    copies = []
    for k, r in enumerate(given):
        words = r.text.replace("\n", " ").split()
        for at in draw.sample(range(len(words)), len(words) // 60 + 1):
            words[at] = f"other{at}"
        copies.append((10_000 + k, " ".join(words), r.lang, r.source, r.n_chars))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.unionByName(spark.createDataFrame(copies, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("labels", "benchmark"))
    model = toxicity.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [x for x, s in zip(rows, model.scores([t for _, t in rows], {}), strict=True) if s < toxicity.THRESHOLD]
    gone = brute_lines(rows)
    rows = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))) for i, t in rows]
    texts = dict(rows)
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        before = dict(label)
        for i, a in sets.items():
            label[i] = min(label[j] for j, b in sets.items() if 5 * len(a & b) >= 4 * len(a | b))
        if label == before:
            break
    assert any(label[i] != i and (simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[label[i]], 5)).bit_count() > 2 for i in label)
    rows = [(i, t) for i, t in rows if label[i] == i]
    items = decontamination.Items(*map(list, zip(*((r.item_id, r.text) for r in bench.collect()), strict=True)))
    rows = [(i, t) for i, t in rows if not items.matches(decontamination.normal(t))]
    encoders = sentencepiece_bpe._encoders(sentencepiece_bpe.Vocabulary(), sentencepiece_bpe.RATE, sentencepiece_bpe.SEED)
    want = {i: encoders[sentencepiece_bpe.stream_of(i)].encode(t).tolist() for i, t in rows}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_stages_on_awkward_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "text of no one"), (3, "a b c d e f g h"), (4, "a b c d e f g h"), (4, "a b c d e f g h"), (5, "q " * 30_000)], clash=True)
    for rows in (docs, docs.limit(0)):
        at, columns = rows, rows.columns
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, DIR)
            assert name == "encode" or at.columns == columns
        assert at.count() == (0 if rows is not docs else 5)


def test_near_dedup_links_at_a_similarity_of_four_fifths(spark, make_docs):
    draw = random.Random(5)
    base = [f"w{draw.randrange(10 ** 6)}" for _ in range(200)]

    def edited(words, n):
        out = list(words)
        for at in draw.sample(range(len(out)), n):
            out[at] = f"e{draw.randrange(10 ** 6)}"
        return out

    texts = [" ".join(edited(base, n)) for n in (0, 1, 2, 3, 4, 5, 6, 9, 30)]
    chain = [base[k : k + 150] + [f"t{i}" for i in range(50)] for k in (0, 10, 20, 30)]
    rows = list(enumerate([*texts, *(" ".join(c) for c in chain), " ", "", None, "own text", "own  Text", *texts[:2]], 1)) + [(None, texts[0]), (4, "another text of this key")]

    def tokens(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = [(i, t, tokens(t)) for i, t in rows if i is not None and t is not None]
    label = list(range(len(sets)))
    for _ in sets:
        label = [min(label[j] for j, b in enumerate(sets) if 5 * len(a[2] & b[2]) >= 4 * len(a[2] | b[2])) for a in sets]
    least = {g: min(i for (i, _, _), x in zip(sets, label, strict=True) if x == g) for g in label}
    want = [(i, t) for (i, t, _), g in zip(sets, label, strict=True) if i == least[g]] + [(i, t) for i, t in rows if i is None or t is None]
    far = [simhash.fingerprint(t, 5) ^ simhash.fingerprint(texts[0], 5) for t in texts[1:4]]
    assert any(x.bit_count() > 2 for x in far) and 8 < len(want) < len(rows) - 5
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, make_docs(rows), DIR).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_leaks_go_by_row(spark, make_docs):
    leak = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text
    rows = [(None, leak), (None, "clean text of no one"), (1, leak), (1, "another text under this key"), (2, None)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_leaked(spark, make_docs(rows), DIR).collect()]
    assert sorted(got, key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_near_dedup_takes_its_first_candidates_from_simhash(spark, make_docs, monkeypatch):
    draw = random.Random(11)
    prints = [draw.getrandbits(62) for _ in range(30)]
    prints += [p ^ 1 << draw.randrange(62) ^ 1 << draw.randrange(62) for p in prints[:20]] + prints[5:9] + [prints[20] ^ 7]
    pairs = {(r.sid, r.xsid) for r in near_dedup.simhash_pairs(spark.createDataFrame(list(enumerate(prints)), "sid long, fp long")).collect()}
    root = list(range(len(prints)))
    for _ in prints:
        root = [min(root[j] for j in range(len(prints)) if j == i or (i, j) in pairs or (j, i) in pairs) for i in range(len(prints))]
    want = list(range(len(prints)))
    for _ in prints:
        want = [min(want[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(prints))]
    assert root == want and len(set(root)) < len(prints) - 20 and all(a < b for a, b in pairs)

    seen = []
    true_pairs = near_dedup.simhash_pairs
    monkeypatch.setattr(near_dedup, "simhash_pairs", lambda p: seen.append({r.fp for r in p.collect()}) or true_pairs(p))
    texts = ["one two three four five six seven", "one two three four five six eight", "ONE two  three four five six\nseven"]
    got = corpus_pipeline.drop_near_duplicates(spark, make_docs(list(enumerate(texts))), DIR)
    assert sorted(r.doc_id for r in got.collect()) == [0, 1]
    assert {f % (1 << 64) for f in seen[0]} == {simhash.fingerprint(t, 5) for t in texts[:2]}
