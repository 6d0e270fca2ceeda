"""Centroids by filtering against comparing every vector with every centroid."""

import hashlib
import math

import numpy as np
import pytest

from lodestone.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_rows(rows, k, rounds, size, scale):
    kept = [(i, [math.floor(scale * x) for x in map(float, np.float32(v))]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    middle = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middle))
    for _ in range(rounds):
        of = [far(v)[1] for _, v in kept]
        for n in set(of):
            own = [v for (_, v), m in zip(kept, of, strict=True) if m == n]
            middle[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, *far(v)[::-1]) for i, v in kept]
    inertia = {n: sum(d for _, m, d in last if m == n) for n in range(k)}
    return [(i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, middle[n])).encode()).hexdigest()) for i, n, d in last]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("tree", [7, 64, 8192])
def test_clusters_equal_plain_ones_and_odd_rows(spark, tree):
    rng = np.random.default_rng(tree)
    rows = [(k, (rng.integers(0, 4, 3) * 2 + rng.normal(0, 0.1, 3)).tolist()) for k in range(300)]
    # equal vectors in numbers, ties, shared and null ids, and rows that take no part
    rows += [(1000 + k, [1.0, 1.0, 1.0]) for k in range(120)] + [(2000 + k, [float(k % 2), 0.0, -1.0]) for k in range(40)]
    rows += [(5, [0.5, 0.5, 0.5]), (5, [0.5, 0.5, 0.5]), (None, [3.0, 3.0, 3.0]), (7, None), (8, []), (9, [1.0, None, 2.0]), (10, [float("nan")] * 3), (11, [float("inf"), 0.0, 0.0]), (12, [1.0] * 4), (13, [-0.0, 0.0, -0.001])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).withColumn("cluster", df_col(2)).withColumn("ids", df_col(3)).repartition(3)
    got = centroids.cluster(df, 6, 4, 3, 256, tree=tree)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert in_order(got.collect()) == in_order(plain_rows(rows, 6, 4, 3, 256))


def df_col(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_few_none_and_too_large_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [5.0, 5.0], 0), (3, [1e30, 0.0], 0)], SCHEMA)
    assert in_order(centroids.cluster(df.where("vec_id < 3"), 40, 2, 2).collect()) == in_order(plain_rows([(1, [1.0, 2.0]), (2, [5.0, 5.0])], 40, 2, 2, 256))
    assert centroids.cluster(df, 40, 5, 64).count() == 0 == centroids.cluster(df.limit(0), 40, 5, 2).count()
    with pytest.raises(Exception, match="is not under"):
        centroids.cluster(df, 40, 1, 2).collect()


def test_nodes_are_assigned_whole_and_large_components_exactly():
    rng = np.random.default_rng(1)
    middle = rng.integers(-1000, 1000, (10, 8))
    points = np.concatenate([m + rng.integers(-3, 4, (200, 8)) for m in middle])
    for factor in (1, 10_000):  # the second is beyond what doubles hold
        tree, order = centroids.Tree.of(points * factor)
        whole, loose, labels = tree.assign(middle * factor)
        assert sum(int(tree.nodes[n, 1] - tree.nodes[n, 0]) for n, _ in whole) + len(loose) == len(points)
        assert len(whole) < 40 and len(loose) < 300 and (tree.points == points[order] * factor).all()
        of = np.empty(len(points), int)
        of[loose] = labels
        for n, c in whole:
            of[tree.nodes[n, 0] : tree.nodes[n, 1]] = c
        far = ((tree.points[:, None].astype(object) - (middle * factor)[None].astype(object)) ** 2).sum(2)
        assert (of == far.argmin(1)).all()
        assert (centroids.distances(tree.points[:50], middle * factor) == far[:50].astype(np.int64)).all()
