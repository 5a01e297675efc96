"""Whitening and clustering against brute force in exact arithmetic."""

import hashlib
import math
import os
import random
from fractions import Fraction

import numpy as np
import pytest

from detectra.llm import kdtree, queries, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, x string, cluster int, component int, hash string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", 1, 2, "h") for i, v in rows], SCHEMA).repartition(3)


def odd_rows(seed=0, n=300, d=64):
    r = random.Random(seed)
    center = [[r.gauss(0, 1) for _ in range(d)] for _ in range(7)]
    rows = [(i, [float(np.float32(c + r.gauss(0, 0.2))) for c in center[i % 7]]) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(100)] + [rows[5]] * 3
    rows += [(None, rows[7][1]), (None, [0.5] * d), (2000, None), (2001, [None] + [0.0] * (d - 1)), (2002, [float("nan")] + [0.0] * (d - 1)), (2003, [float("inf")] * d), (2004, [1.0] * (d - 1)), (2005, []), (2006, [0.0] * d)]
    return rows


def usable(rows, d):
    return [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]


def lloyd(rows, k=40, rounds=5, scale=256):
    points = [(i, [math.floor(scale * c) for c in v]) for i, v in rows]
    order = sorted(points, key=lambda p: (hashlib.sha256(f"2:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p[1]))
    centers = [list(p) for _, p in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p: min(range(len(centers)), key=lambda j: (far(p, centers[j]), j))
    for _ in range(rounds):
        own = [near(p) for _, p in points]
        for j in range(len(centers)):
            mine = [p for (_, p), o in zip(points, own) if o == j]
            if mine:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine)]
    own = [near(p) for _, p in points]
    dist = [far(p, centers[o]) for (_, p), o in zip(points, own)]
    total = [sum(x for x, o in zip(dist, own) if o == j) for j in range(len(centers))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i if i is not None else -1), o, x, total[o], sum(dist), sha[o]) for (i, _), o, x in zip(points, own, dist))


def clustered(df):
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_clusters_as_brute_force(spark, monkeypatch):
    rows = odd_rows()
    want = lloyd(usable(rows, 64))
    assert clustered(kdtree.cluster(frame(spark, rows))) == want
    assert len({w[1] for w in want}) > 7


def test_few_rows_ties_and_no_rows(spark):
    rows = [(i, [float(i % 3)] * 64) for i in range(9)]
    assert clustered(kdtree.cluster(frame(spark, rows))) == lloyd(rows)
    assert clustered(kdtree.cluster(frame(spark, rows), k=4)) == lloyd(rows, k=4)
    assert clustered(kdtree.cluster(frame(spark, []))) == []


def test_large_entries_are_exact(spark):
    r = random.Random(1)
    rows = [(i, [float(np.float32(r.choice([1, -1]) * 3e7 + r.random() * 1e6)) for _ in range(4)]) for i in range(60)]
    got = clustered(kdtree.cluster(frame(spark, rows), k=5, dim=4))
    want = [tuple(x if not isinstance(x, int) or x < 2**63 else None for x in w) for w in lloyd(rows, k=5)]
    assert got == want


def test_trees_prune_and_keep_ties():
    r = np.random.default_rng(0)
    points = r.integers(-9, 9, (3000, 3))
    tree = kdtree.Tree(kdtree.build(np.arange(3000), points), 9)
    c = r.integers(-9, 9, (12, 3))
    label, far = tree.labels(c)
    want = ((points[:, None] - c) ** 2).sum(2)
    assert (label == want[tree.ids].argmin(1)).all() and (far == want[tree.ids].min(1)).all()
    alone = [node for node, which in tree.walk(c) if isinstance(which, int)]
    assert alone and sum(tree.end[n] - tree.start[n] for n in alone) > 100
    for k, (n, inertia, total) in tree.sums(c).items():
        own = want.argmin(1) == k
        assert (n, inertia, total) == (own.sum(), want[own].min(1).sum(), points[own].sum(0).tolist())


def whitened(df):
    return {(r["vec_id"], r["component"]): r for r in df.collect()}


def reference(rows):
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(v, total)) for i, v in x.items()}
    centred = lambda v: np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, total)])
    c = np.stack([centred(v) for v in fit])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return n, deviation, values[::-1], vectors[:, ::-1], {i: centred(v) for i, v in x.items()}


def test_whitening_as_dense_eigenvectors(spark):
    rows = [(i, v) for i, v in odd_rows() if i is not None]
    n, deviation, values, components, centred = reference(usable(rows, 64))
    got = whitened(whiten.whiten(frame(spark, rows)))
    assert {k for k in got} == {(i, c) for i in deviation for c in range(1, 17)}
    sign = {c: np.sign(got[(0, c)]["whitened"] * (centred[0] @ components[:, c - 1])) for c in range(1, 17)}
    for (i, c), r in got.items():
        assert (r["n"], int(r["deviation"])) == (n, deviation[i])
        assert r["whitened"] == pytest.approx(sign[c] * (centred[i] @ components[:, c - 1]) / math.sqrt(values[c - 1]), abs=1e-6)
        assert r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9


def test_whitening_of_few_equal_or_no_rows(spark):
    rows = [(i, [float(i), float(i * i % 5), 1.0]) for i in range(4)]
    got = whitened(whiten.whiten(frame(spark, rows)))
    assert {c for _, c in got} == {1, 2}
    assert whiten.whiten(frame(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    assert whiten.whiten(frame(spark, [])).count() == 0
    assert whiten.whiten(frame(spark, [(1, None), (2, [])])).count() == 0


def test_deviations_beyond_a_long_are_exact(spark):
    rows = [(i, [float(np.float32(1e13 * (i % 7))), float(i)]) for i in range(20)]
    n, deviation, *_ = reference(rows)
    got = whitened(whiten.whiten(frame(spark, rows)))
    assert {i: int(r["deviation"]) for (i, c), r in got.items()} == deviation and max(deviation.values()) > 2**63


def test_lanczos_restarts_and_converges():
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.standard_normal((200, 200)))[0]
    for values in (np.r_[[5.0] * 6, np.zeros(194)], np.r_[np.linspace(9, 8, 20), np.full(180, 1e-3)], np.ones(200)):
        v = (q * values) @ q.T
        found, vectors, passes = whiten.lanczos(lambda x: v @ x, 200, 8, 4, 1)
        assert found == pytest.approx(np.sort(values)[::-1][:8], abs=1e-10)
        assert np.abs(v @ vectors - vectors * found).max() < 1e-9
        assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_queries(spark):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert clustered(queries.QUERIES["op13_centroid_clustering"](spark, SF)) == lloyd(usable(table, 64))
    n, deviation, values, components, centred = reference(usable(table, 64))
    out = queries.QUERIES["op11_embedding_whitening"](spark, SF)
    assert dict(out.dtypes)["deviation"] == "bigint"
    got = whitened(out)
    assert len(got) == 16 * len(deviation)
    for (i, c), r in got.items():
        assert (r["n"], r["deviation"]) == (n, deviation[i])
        assert abs(r["whitened"]) == pytest.approx(abs(centred[i] @ components[:, c - 1]) / math.sqrt(values[c - 1]), abs=1e-6)
        assert r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9
