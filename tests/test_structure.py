"""Linkage and embedding beside plain versions."""

import itertools
import random

import numpy as np
import pytest

from vicinage.operators import embedding, graph_vectorizer, linkage, motifs
from vicinage.operators.options import GraphOptions
from vicinage.sources import corpora as C


def slow_linkage(points):
    """Merges by repeatedly joining the two clusters of the closest points."""
    gap = lambda x, y: round(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5, 5)
    edges = sorted((gap(x, y), min(i, j), max(i, j)) for (i, x), (j, y) in itertools.combinations(points, 2))
    root, out = {i: i for i, _ in points}, []
    for distance, low, high in edges:
        a, b = sorted((root[low], root[high]))
        if a != b:
            root = {i: a if r == b else r for i, r in root.items()}
            out.append((len(out) + 1, a, b, distance, sum(r == a for r in root.values())))
    return out


@pytest.mark.parametrize("k, block", [(1, 5), (3, 1000)])
def test_linkage_of_clumps(spark, k, block):
    """Clumps and copies, so that nearest others are soon all inside a component and points must look further."""
    pick = random.Random(k)
    middles = [[pick.uniform(-9, 9) for _ in range(3)] for _ in range(6)]
    points = [(10 * i, [round(x + pick.gauss(0, 0.4), 1) for x in pick.choice(middles)]) for i in range(40)]
    points += [(700 + i, points[i][1]) for i in range(4)]
    tree = linkage.spanning_tree(spark.createDataFrame(points, "id long, vector array<double>"), k)
    assert sorted(map(tuple, linkage.merges(tree, block).collect())) == slow_linkage(points)


def test_linkage_of_few_points(spark):
    for n in (0, 1):
        assert linkage.single_linkage(spark.createDataFrame([(k, [1.0]) for k in range(n)], "id long, vector array<double>")).collect() == []


def test_singular_values_equal_numpy(spark, small):
    features = graph_vectorizer.vectorize(*C.name_graphs(spark, small), GraphOptions(r=1, d=1, nbits=20)).cache()
    placed, values = embedding.truncated_svd(features, 4)
    rows = features.collect()
    ids, names = sorted({r["graph_id"] for r in rows}), sorted({r["feature"] for r in rows})
    matrix = np.zeros((len(ids), len(names)))
    for r in rows:
        matrix[ids.index(r["graph_id"]), names.index(r["feature"])] = r["value"]
    left, true, _ = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(values, true[:4], atol=1e-3)
    got = np.array([list(r)[1:] for r in sorted(placed.collect())])
    assert np.allclose(abs((got / values).T @ left[:, :4]).round(2), np.eye(4), atol=0.05)


def test_svd_of_few_directions(spark):
    rows = [(k, 1, float(k)) for k in range(5)] + [(k, 2, 2.0 * k) for k in range(5)]
    placed, values = embedding.truncated_svd(spark.createDataFrame(rows, "graph_id long, feature long, value double"), 3)
    assert len(values) == 1 and abs(values[0] - 150**0.5) < 1e-9 and placed.columns == ["graph_id", "c0"]
    assert embedding.truncated_svd(spark.createDataFrame([], "graph_id long, feature long, value double"))[0].collect() == []


def test_stretches_over_segments(spark):
    """Runs that cross segments of all lengths, beside all runs."""
    pick, rows, best = random.Random(6), [], {}
    for key in range(30):
        values = [pick.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 2.0]) * pick.choice([1, 1, -1 if key % 3 else 1]) for _ in range(pick.choice([1, 2, 7, 40]))]
        if key % 5 == 0:
            values = [-abs(v) - 1 for v in values]
        best[key] = max(sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1))
        rows += [(key, k // 4, k, v) for k, v in enumerate(values)]
    pick.shuffle(rows)
    found = motifs.max_stretches(spark.createDataFrame(rows, "id long, segment long, k long, x double"), "id", "segment", ["k"], "x")
    assert {r["id"]: r["score"] for r in found.collect()} == best


def test_trees_of_blocks_are_few_and_have_the_tree(spark):
    """Copies and ties; the trees of two blocks have fewer edges than all pairs, and no point is asked for again."""
    pick = random.Random(6)
    points = [(k * 7 % 60, [float(pick.randrange(4)) for _ in range(2)]) for k in range(60)]
    frame = spark.createDataFrame(points, "id long, vector array<double>")
    found = {tuple(r) for r in linkage.near_edges(frame, 20).collect()}
    assert len(found) <= 3 * 59
    ids, x = np.array([i for i, _ in points]), np.array([v for _, v in points]).T
    assert set(zip(*linkage._tree(ids, x), strict=True)) <= found
    assert [(k + 1, d) for k, d in enumerate(sorted(r[3] for r in slow_linkage(points)))] == [(k + 1, d) for k, d in enumerate(sorted(linkage._tree(ids, x)[2]))]
