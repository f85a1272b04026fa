"""Clustering by popcounts over bit planes, against plain integer arithmetic."""

import hashlib

import numpy as np
import pytest

from tidemark.llm import centroids
from tidemark.llm.queries import ORACLES


def by_brute_force(rows, clusters=16, rounds=3, scale=64):
    kept = [
        (i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]

    def name(row):
        return (row[0] is None, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest() if row[0] is not None else "")
    means = [v for _, v in sorted(kept, key=name)[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            away = [sum((a - b) ** 2 for a, b in zip(v, m)) for m in means]
            out.append((away.index(min(away)), min(away)))
        return out
    for _ in range(rounds):
        at = assign()
        for c in range(len(means)):
            own = [v for (_, v), (k, _) in zip(kept, at) if k == c]
            if own:
                means[c] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    total = sum(d for _, d in at)
    each = [sum(d for k, d in at if k == c) for c in range(len(means))]
    return sorted(
        ((i, c, d, each[c], total, hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for (i, _), (c, d) in zip(kept, at)), key=str)


def vectors(n, seed=1, size=0.2):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(0, size, 64).astype(np.float32)]) for i in range(n)]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "'p' as planes", "1 as cluster", "2 as distance", "'n' as name").repartition(4)
    return sorted(map(tuple, centroids.cluster(df, **options).collect()), key=str)


ODD = vectors(40) + [
    (3, None), (50, []), (51, [1.0] * 63), (52, [1.0] * 65), (53, [float("nan")] + [0.0] * 63), (54, [float("inf")] + [0.0] * 63),
    (55, [None] + [0.0] * 63), (None, [0.25] * 64), (None, [0.25] * 64), (7, [0.5] * 64), (56, [0.0] * 64), (56, [0.0] * 64), (-1, [-1.0] * 64),
    (57, [1e6] + [-1e6] * 63), (58, [2e7] + [0.1] * 63)]


@pytest.mark.parametrize("clusters, rounds", [(16, 3), (1, 2), (5, 0), (100, 2)])
def test_odd_vectors_by_brute_force(spark, clusters, rounds):
    rows = [r for r in ODD if r[0] != 7] + [(7, [0.5] * 64)]
    assert found(spark, rows, clusters=clusters, rounds=rounds) == by_brute_force(rows, clusters, rounds)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [1.0] * 64) for i in range(20)]
    out = found(spark, rows)
    assert out == by_brute_force(rows) and {r[1] for r in out} == {0}


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(1, [float(k)] * 64) for k in range(5)]
    assert len(set(found(spark, rows, clusters=5, rounds=1))) == 5


def test_values_beyond_64_bit_sums(spark):
    rows = [(1, [1e9] * 64), (2, [-1e9] * 64), (3, [1e300] * 64), (4, [0.0] * 64)]
    out = found(spark, rows, clusters=2, rounds=1)
    assert len(out) == 4 and all(0 <= r[2] <= centroids.LONGEST and r[4] == centroids.LONGEST for r in out)


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []


def test_planes_hold_the_values_and_their_products():
    rng = np.random.default_rng(2)
    for most in (1, 7, 300, 2 ** 20, 2 ** 40, 2 ** 62):
        a, b = rng.integers(-most, most + 1, (9, 64)), rng.integers(-most, most, (5, 64))
        p, q = centroids.pack(a), centroids.pack(b)
        assert (centroids.unpack(p) == a).all() and (centroids.unpack(centroids.widen(p, p.shape[1] + 1)) == a).all()
        exact = a.astype(object) @ b.astype(object).T
        assert (centroids.dots(p, q).astype(object) == exact).all()
        assert (centroids.squares(p).astype(object) == (a.astype(object) ** 2).sum(axis=1)).all()
    assert "op13_bit_plane_clusters" in ORACLES
