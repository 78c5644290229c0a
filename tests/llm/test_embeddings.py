"""The index of embedding_dedup: cells, signs that travel, blocks, forests."""

import math

import numpy as np
import pytest

from folioscript.llm import embedding_dedup as E


def pairs_at(cosine, n, dim, seed):
    rng = np.random.default_rng(seed)
    x, z = E.unit_rows(rng.standard_normal((2 * n, dim))).reshape(2, n, dim)
    return x, cosine * x + math.sqrt(1 - cosine**2) * E.unit_rows(z - (z * x).sum(1, keepdims=True) * x)


@pytest.mark.parametrize("n", [10**5, 15 * 10**6, 10**9])
def test_places_of_a_vector_stay_few(n):
    assert E.plan(n, 64)[2] * E.ROUNDS <= 48  # before, 44, 135 and 347 tables with the whole vector in each


@pytest.mark.parametrize(("n", "dim"), [(10**5, 64), (15 * 10**6, 64), (10**6, 8), (10**6, 3), (10**6, 200)])
def test_pairs_at_the_threshold_share_a_cell(n, dim):
    coder = E.Coder(dim, *E.plan(n, dim))
    a, b = (coder.all_cells(v) for v in pairs_at(0.9, 3000, dim, 11))
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() >= 0.996
    assert all(len(set(row)) == len(row) for row in a[:50].tolist())
    a, b = (coder.all_cells(v) for v in pairs_at(0.96, 1000, dim, 12))
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() >= 0.999


def test_cells_of_unrelated_vectors_hold_about_alike_many():
    width, slices, _ = E.plan(10**6, 64)
    coder = E.Coder(64, width, slices, 4)
    x = E.unit_rows(np.random.default_rng(4).standard_normal((20_000, 64)))
    sizes = np.unique(np.concatenate([coder.all_cells(x[lo : lo + 1000]).ravel() for lo in range(0, 20_000, 1000)]), return_counts=True)[1].astype(float)
    even = sizes.sum() / (E.ROUNDS * E.TABLES * (2 * width) ** slices)
    assert (sizes * (sizes - 1)).sum() / sizes.sum() <= 1.15 * even


@pytest.mark.parametrize("block", [8, 1024])
def test_partners_are_those_the_signs_allow(monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng, apart = np.random.default_rng(1), math.acos(0.9) / math.pi
    most = int(E.SIGNS * apart + E.EPS * math.sqrt(E.SIGNS * apart * (1 - apart)))
    for _ in range(20):
        n = int(rng.integers(2, 400))
        cells = rng.integers(-5, rng.integers(1, 60), n)
        v = rng.standard_normal((n, E.SIGNS))
        v[n // 2 :] = v[: n - n // 2] + rng.standard_normal((n - n // 2, E.SIGNS)) * 0.6
        signs = np.ascontiguousarray(np.packbits(v > 0, axis=1).view(np.uint64).T)
        near = ((v[:, None] > 0) != (v[None] > 0)).sum(2) <= most
        assert (E.partners(cells, signs, 0.9) == (near & (cells[:, None] == cells) & ~np.eye(n, dtype=bool)).any(axis=1)).all()


def test_forests_agree():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.01, 0.05, 0.5):
        links, ids = rng.random((30, 41)) < share, rng.permutation(71).astype(np.int64)
        square = np.zeros((71, 71), bool)
        square[:30, 30:] = links
        i, j = np.nonzero(square)
        want = [x.tolist() for x in E.forest(square, ids)]
        assert [x.tolist() for x in E.forest_across(links, ids[:30], ids[30:])] == want == [x.tolist() for x in E.forest_of(i, j, ids)]


def test_links_through_the_index_equal_brute_force(spark, monkeypatch):
    for name, value in {"FEW": 16, "BUCKET": 4, "BLOCK": 16, "SMALL": 6, "PART": 512, "WHOLE": 60}.items():
        monkeypatch.setattr(E, name, value)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 64))
    vecs = [base[k % 40] + rng.standard_normal(64) * rng.choice([0.02, 0.2, 0.3]) for k in range(400)]
    vecs += [base[0] + rng.standard_normal(64) * 0.03 for _ in range(90)]  # a close group of many blocks
    vecs += [v.astype(np.float32) for v in rng.standard_normal((300, 64))]
    vecs += [vecs[0], vecs[0] * 4.0, -vecs[0], vecs[401]]
    short = [rng.standard_normal(3) for _ in range(60)]
    rows = [(k, v.tolist()) for k, v in enumerate(vecs + short)] + [(None, vecs[1].tolist()), (900, None), (901, [])]
    assert E.plan(len(vecs), 64)[1] > 0
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert len(got) == len(rows)
    n, low = {}, {}
    for group in (vecs + [vecs[1]], short):
        first = 0 if group is not short else len(vecs)
        x = E.unit_rows(np.array(group))
        near = x @ x.T >= 0.9
        label = np.arange(len(x))
        for _ in range(len(x)):
            label = np.where(near, label, len(x)).min(axis=1)
        ids = [first + k for k in range(len(x))]
        if group is not short:
            ids[-1] = None
        for k, i in enumerate(ids):
            n[i], low[i] = int(near[k].sum()) - 1, int(label[k]) + first
    for i, links, component, kept in got:
        if i is not None and i >= 900:
            assert (links, component, kept) == (0, i, True)
        else:
            assert (links, component, kept) == (n[i], low[i], i is None or i == low[i])


def test_equal_vectors_are_one_class_whatever_their_type(spark):
    rows = [(1, [0.0, 1.5]), (2, [-0.0, 1.5]), (3, [0.1, 1.5]), (4, [0.1, 1.5]), (5, [float("nan"), 1.0]), (6, [1e300, 1.0])]
    for kind in ("double", "float"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        got = sorted((r.id, r.n, r.dim) for r in E.vector_classes(df).collect())
        assert got == [(1, 2, 2), (3, 2, 2)] + ([(6, 1, 2)] if kind == "double" else [])
