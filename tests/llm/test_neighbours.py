import struct

import numpy as np

from scrinium.llm import neighbours as N


def blob(v):
    return struct.pack(f"<{len(v)}f", *v)


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((n // 8, 64))
    return (c[rng.integers(0, len(c), n)] + 0.15 * rng.standard_normal((n, 64))) * rng.uniform(0.3, 5, (n, 1))


def test_partition_is_balanced_and_routes(spark):
    x = clustered(4000)
    _, rows = N.unit_rows([blob(v) for v in x])
    near = N.graph(rows)
    label = N.balanced_partition(rows, near, 13)
    sizes = np.bincount(label, minlength=13)
    assert sizes.min() > 0.8 * sizes.mean() and sizes.max() < 1.2 * sizes.mean()
    assert (label[near] == label[:, None]).mean() > 0.6


def test_recall_against_brute_force(spark, monkeypatch):
    x = clustered(3000, 1)
    df = spark.createDataFrame([(int(k), blob(v)) for k, v in enumerate(x)], "id long, vettore binary").repartition(4)
    got = {}
    for r in N.nearest_vectors(df, target=150, sample=2000).collect():
        got.setdefault(r.id, set()).add(r.vicino)
    assert len(got) == 3000 and all(len(v) == 5 for v in got.values())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    true = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(got[k] & set(true[k])) / 5 for k in range(3000)]) >= 0.9


def test_equal_vectors_blocks_and_invalid_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = np.random.default_rng(2)
    one = blob([1.0] + [0.0] * 63)
    rows = [(k, one) for k in range(40)] + [(100 + k, blob(rng.standard_normal(64))) for k in range(30)] + [(5, one), (900, None), (901, b"abc"), (902, blob([0.0] * 64)), (903, blob([float("nan")] * 64)), (904, blob([float("inf")] + [0.0] * 63)), (905, blob([1.0] * 32)), (None, one)]
    got = {}
    for r in N.nearest_vectors(spark.createDataFrame([(*r, 1) for r in rows], "id long, vettore binary, vicino int")).collect():
        got.setdefault(r.id, []).append(r.vicino)
    assert set(got) == {*range(40), *range(100, 130)} and all(len(v) == 5 for v in got.values())
    assert sorted(got[3]) == [0, 1, 2, 4, 5] and sorted(got[39]) == [0, 1, 2, 3, 4]
    u = {k: np.frombuffer(b, "<f4") / np.linalg.norm(np.frombuffer(b, "<f4")) for k, b in rows[:70]}
    for q in range(100, 130):
        want = sorted((k for k in u if k != q), key=lambda k: (-round(float(u[k] @ u[q]), 5), k))[:5]
        assert sorted(got[q]) == sorted(want)


def test_small_tables(spark):
    df = spark.createDataFrame([(1, blob([1.0] * 64)), (2, blob([1.0] * 63 + [0.0]))], "id long, vettore binary")
    assert sorted(tuple(r)[:2] for r in N.nearest_vectors(df).collect()) == [(1, 2), (2, 1)]
    assert [tuple(r) for r in N.neighbour_pairs(N.nearest_vectors(df)).collect()] == [(1, 2)]
    assert N.nearest_vectors(df.limit(1)).count() == 0
    assert N.nearest_vectors(df.limit(0)).count() == 0


def test_two_levels_keep_leaves_small_and_recall(spark):
    x = clustered(6000, 5)
    df = spark.createDataFrame([(int(k), blob(v)) for k, v in enumerate(x)], "id long, vettore binary").repartition(4)
    _, u = N.unit_rows([blob(v) for v in x])
    vectors = N.valid_vectors(df)
    index = N.fitted_index(vectors, 6000, sample=4000, target=60, parts=12)
    assert index.below is not None and 80 <= index.first[-1] <= 144
    home, row, leaf = index.visits(u)
    assert np.bincount(home).max() < 6 * 60 and (np.bincount(row) == N.PROBES).all()
    assert len({(a, b) for a, b in zip(row.tolist(), leaf.tolist(), strict=True)}) == len(row)
    got = {}
    for r in N.nearest_vectors(df, sample=4000, target=60, parts=12).collect():
        got.setdefault(r.id, set()).add(r.vicino)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    true = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(got.get(k, set()) & set(true[k])) / 5 for k in range(6000)]) >= 0.9
