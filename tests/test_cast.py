import random

from pyspark.sql import functions as F

from folioscript.operators import cast as C
from folioscript.operators import voices as V

VOICE = "id string, ordinal long, name string, gender string, age string, accent string"
CAST = "id long, book_id long, name string, gender string, age_range string, accent_hint string, heritage string, is_narrator boolean, dialogue_share long"


def small_world(spark, n=120):
    rng = random.Random(11)
    voices = [(f"v{i}", i, f"V {i}", rng.choice(["male", "female", "neutral", None]), rng.choice(["young", "old", "middle_aged", None]), rng.choice(["irish", "indian", None, ""])) for i in range(14)]
    cast = [(i, 0 if i % 3 == 0 else i % 4, f"C{i}", rng.choice(["male", "female", "unknown"]), rng.choice(["child", "60s", ""]), rng.choice(["Irish", "Welsh", ""]), "", i < 4, rng.randrange(300)) for i in range(n)]
    return voices, cast, spark.createDataFrame(voices, VOICE), spark.createDataFrame(cast, CAST)


def test_distinct_voices_equals_the_sequential_walk(spark):
    voices, cast, vdf, cdf = small_world(spark)
    got = {r["id"]: r["voice_id"] for r in V.distinct_voices(cdf, vdf).collect()}
    assert len(got) == len(cast)
    family = lambda t: {"irish": "irish", "indian": "indian", "welsh": "welsh"}.get((t or "").lower())
    bucket = lambda t: {"child": "young", "60s": "old", "young": "young", "old": "old", "middle_aged": "middle"}.get(t)
    for book in {c[1] for c in cast}:
        taken = set()
        for c in sorted((c for c in cast if c[1] == book), key=lambda c: (not c[7], -c[8], c[2], c[0])):
            g = lambda v: not v[3] or c[3] == "unknown" or v[3] == c[3]
            a = lambda v: {bucket(c[4]), bucket(v[4])} != {"young", "old"}
            want = family(c[5])
            exact = lambda v: want is not None and family(v[5]) == want
            near = lambda v: want is None or family(v[5]) is None or exact(v)
            free = lambda v: v[0] not in taken
            pools = [[v for v in voices if t(v)] for t in (
                lambda v: g(v) and a(v) and exact(v) and free(v), lambda v: g(v) and a(v) and exact(v), lambda v: g(v) and a(v) and near(v) and free(v),
                lambda v: g(v) and a(v) and near(v), lambda v: g(v) and a(v) and free(v), lambda v: g(v) and a(v), lambda v: g(v) and free(v), g, lambda v: True)]
            pick = next(p[0] for p in pools if p)[0]
            taken.add(pick)
            assert got[c[0]] == pick


def test_alias_components_with_a_hub(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(80)]
    data = [(1, n, ["HUB"] if i % 3 == 0 else [rng.choice(names) for _ in range(rng.randrange(2))] + [" "]) for i, n in enumerate(names)]
    data += [(2, f"c{i}", [f"c{i + 1}"]) for i in range(40)]
    got = {(r[0], r[1]): r[2] for r in C.alias_components(spark.createDataFrame(data, "book_id long, name string, aliases array<string>")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for b, n, al in data:
        find((b, n.lower()))
        for x in al:
            if x.strip():
                lo, hi = sorted([find((b, n.lower())), find((b, x.strip().lower()))])
                parent[hi] = lo
    assert got == {k: find(k)[1] for k in list(parent)}


def test_dedupe_aliases(spark):
    df = spark.createDataFrame([(["Bob", " bob ", "", "ROB", "Rob", " Al"], "Rob")], "a array<string>, n string")
    assert df.select(C.dedupe_aliases(F.col("a"), F.col("n"))).first()[0] == ["Bob", "Al"]


def test_names_beat_aliases_and_share_breaks_ties(spark):
    cast = spark.createDataFrame([(1, 1, "Hugo (child)", ["Hugo"], 10, False), (2, 1, "Hugo (adult)", ["Hugo"], 30, False), (3, 1, "Ann", [], 1, False), (4, 1, "Bea", ["Ann"], 99, False), (5, 1, "Narrator", [], 0, True)],
                                 "id long, book_id long, name string, aliases array<string>, dialogue_share long, is_narrator boolean")
    got = {r["key"]: r["character_id"] for r in C.name_dictionary(cast).collect()}
    assert got == {"hugo (child)": 1, "hugo (adult)": 2, "hugo": 2, "ann": 3, "bea": 4}


def test_share_blocks_are_even_on_shares_of_zero_to_one(spark):
    rng = random.Random(3)
    rows = [(i, 1, rng.random() ** 4, i == 0) for i in range(4000)] + [(9000 + i, 2, 0.5, False) for i in range(10)]
    cast = spark.createDataFrame(rows, "id long, book_id long, dialogue_share double, is_narrator boolean").withColumn("name", F.concat(F.lit("n"), F.col("id")))
    blocks = C.with_share_block(cast, rows=100)
    sizes = [r["count"] for r in blocks.filter("book_id = 1").groupBy("_share").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 60
    falling = [r._share for r in blocks.filter("book_id = 1").orderBy(F.col("dialogue_share").desc()).collect()]
    assert falling == sorted(falling) and {r._share for r in blocks.filter("book_id = 2").collect()} == {0}
    order = {r.id: r.position for r in C.cast_order(cast).filter("book_id = 1").collect()}
    want = sorted((r for r in rows if r[1] == 1), key=lambda r: (not r[3], -r[2], f"n{r[0]}", r[0]))
    assert [order[r[0]] for r in want] == list(range(4000))


def test_needles_are_found_through_the_index(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("abc ") for _ in range(rng.randrange(9)))) for i in range(300)] + [(300, None), (301, "ünïcode")]
    needles = ["a", "ab", "abc", "abca", "c a", "zz", "b", "ïc", "ünïcode!", "abcabcabc", " "]
    got = {tuple(r) for r in V.containing(spark.createDataFrame([(n,) for n in needles * 2], "needle string"), spark.createDataFrame(texts, "key long, hay string")).collect()}
    assert got == {(n, k) for n in needles for k, t in texts if t is not None and n in t}


def test_shortlists_equal_a_scan(spark):
    rng = random.Random(5)
    voices = [(f"v{i}", i // 2, rng.choice(["Ann Lee", "Bob", "Cy"]), rng.choice(["male", "Female", None, "robot"]), rng.choice(["young", "middle aged", "old", None]), rng.choice(["Irish", "british", None, "US southern"]),
               rng.choice(["calm", None]), "A voice", rng.choice(["news", "narration"])) for i in range(400)]
    vdf = spark.createDataFrame(voices, "id string, ordinal long, name string, gender string, age string, accent string, descriptive string, description string, use_case string")
    reqs = [(i, rng.choice(["male", "FEMALE", "neutral", None, "", "robot", "alien"]), rng.choice([None, "ir", "Brit", "", "us", "nowhere"]), rng.choice([None, "young", "OLD", ""]),
             rng.choice([None, "calm", "", "ann", "n", "xyz", "a voice na"]), rng.choice([None, 3, 99])) for i in range(150)]
    rdf = spark.createDataFrame(reqs, "request_id long, gender string, accent string, age string, query string, limit int")
    got = {}
    for r in V.search_catalog(rdf, vdf).orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append(r.id)
    bucket = lambda a: next((x for x in ("young", "old", "middle") if x in (a or "")), "")
    for i, g, a, age, q, lim in reqs:
        g, a, age, q = (x.strip().lower() if x else "" for x in (g, a, age, q))
        hits = [v for v in sorted(voices, key=lambda v: (v[1], v[0]))
                if (g in ("", "neutral") or not v[3] or v[3].lower() == g) and a in (v[5] or "").lower() and (not age or bucket(v[4]) in ("", age))
                and q in " ".join([v[2], v[6] or "", v[7] or "", v[8] or "", v[5] or ""]).lower()]
        assert got.get(i, []) == [v[0] for v in hits][: min(lim or 14, 25)], (i, g, a, age, q)


def test_walk_takes_pools_as_arrays_of_numbers():
    from itertools import count

    import numpy as np
    import pandas as pd

    steps = pd.DataFrame([(7, i, p, k, -1) for p, (i, k) in zip(count(0, 2), [(10, 0), (11, 0), (12, 1), (13, 1), (14, 1)])], columns=["book_id", "id", "position", "kind", "voice"])
    fixed = pd.DataFrame([(7, 0, 1, -1, 5)], columns=steps.columns)
    pools = pd.DataFrame({"book_id": [7, 7], "kind": [0, 1], "voices": [np.array([4, 5, 6]), np.array([6, 4, 9])]})
    got = V._take_in_order(pd.concat([steps, fixed]), pools)
    assert got.values.tolist() == [[7, 10, 4], [7, 11, 6], [7, 12, 9], [7, 13, 6], [7, 14, 6]]
