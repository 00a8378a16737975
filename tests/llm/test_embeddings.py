"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from veriloom.llm import pca_tiles
from veriloom.llm.pca_tiles import near_vectors, unite


def wanted(rows):
    """vec_id, n_links, component_id and kept by comparing all pairs."""
    width = max([len(v) for _, v in rows if v], default=0)
    x = np.zeros((len(rows), width))
    for i, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all():
            x[i, : len(v)] = v
    norm = np.linalg.norm(x, axis=1)
    x[norm > 0] /= norm[norm > 0][:, None]
    links = (x @ x.T >= 0.9) & ~np.eye(len(rows), dtype=bool)
    seen, out = {}, []
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in np.nonzero(links[todo.pop()])[0]:
                    if j not in group:
                        group.add(int(j))
                        todo.append(int(j))
            least = min((rows[g][0] for g in group if rows[g][0] is not None), default=None)
            seen |= dict.fromkeys(group, least)
        out.append((rows[i][0], int(links[i].sum()), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def planted(n, dim, seed):
    """Lone vectors, chains whose ends aren't linked, a large group of near copies, exact and scaled copies."""
    rng = np.random.default_rng(seed)
    x = [list(v) for v in rng.normal(size=(n, dim))]
    centre = rng.normal(size=dim)
    x += [list(centre + 0.2 * rng.normal(size=dim)) for _ in range(n // 3)]
    x += [list(centre)] * 20 + [[2.5 * c for c in x[0]], [-c for c in x[0]]]
    if dim > 1:
        u, w = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
        x += [list(np.cos(t) * u + np.sin(t) * w) for t in np.arange(0, 3, 0.4)]
    return [(int(k), [float(np.float32(c)) for c in v]) for k, v in zip(rng.permutation(len(x)), x, strict=True)]


@pytest.mark.parametrize("kind,dim,per_cell,block", [("float", 64, 4096, 16_384), ("double", 24, 30, 40), ("float", 7, 25, 1000), ("double", 1, 30, 16)])
def test_all_pairs(spark, monkeypatch, kind, dim, per_cell, block):
    monkeypatch.setattr(pca_tiles, "PER_CELL", per_cell)
    monkeypatch.setattr(pca_tiles, "BLOCK", block)
    monkeypatch.setattr(pca_tiles, "TILE", 32)
    rows = planted(240, dim, dim)
    assert got(near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(5))) == wanted(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0]), (None, [1.0, 0.1]), (None, [0.0, -1.0]), (None, None),
        (9, [0.95, 0.3]), (10, [-0.0, 1e-200]), (11, [0.0, 1e200]), (12, [0.0, 3.0, 0.0]), (13, [0.0, 3.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, 1, b"", "x") for r in rows], "vec_id long, embedding array<double>, node int, payload binary, `cell` string")
    have = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    assert {(k, 0, k, True) for k in range(1, 7)} <= have
    assert {(7, 4, 7, True), (8, 4, 7, False), (None, 4, 7, False), (None, 0, None, True), (9, 4, 7, False)} <= have
    assert {(10, 3, 10, True), (11, 3, 10, False), (12, 3, 10, False), (13, 3, 10, False)} <= have
    assert len(near_vectors(df).collect()) == len(rows)
    assert near_vectors(df.limit(0)).collect() == []
    assert got(near_vectors(df.filter("vec_id < 5").select("vec_id", "embedding"))) == [(k, 0, k, True) for k in range(1, 5)]


def test_labels_meet():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 60, (2, 45))
        label = np.arange(60)
        for k in range(0, 45, 9):
            unite(label, a[k : k + 9], b[k : k + 9])
        want = np.arange(60)
        for _ in range(60):
            for x, y in zip(a, b, strict=True):
                want[want == max(want[x], want[y])] = min(want[x], want[y])
        assert (label == want).all()


def test_bound_leaves_out_pairs():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64))
    x[150:] = x[:150] + 0.1 * x[:150] * rng.normal(size=(150, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = pca_tiles.linked(x, x, lambda k: x[k], lambda k: x[k])
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(map(tuple, np.argwhere(x @ x.T >= 0.9).tolist()))
