"""Weighted paths, k-means and quantiles beside plain versions."""

import heapq
import math
import random

import numpy as np
import pytest
from compare import spark_rows, sql_rows
from pyspark.mllib.clustering import KMeans, KMeansModel
from pyspark.mllib.linalg import Vectors

from vicinage.operators import clusters, learning, paths, quantiles
from vicinage.plans import registry


def dijkstra(lines, root):
    near, done, heap = {}, {}, [(0.0, root)]
    for a, b, x in lines:
        near.setdefault(a, []).append((b, x))
        near.setdefault(b, []).append((a, x))
    while heap:
        far, v = heapq.heappop(heap)
        if v not in done:
            done[v] = far
            for b, x in near.get(v, []):
                heapq.heappush(heap, (far + x, b))
    return done


@pytest.mark.parametrize("delta", [None, 50.0])
def test_paths_equal_dijkstra(spark, delta):
    """Two graphs with long detours, zero lengths, doubled edges, a loop and lone vertices."""
    pick = random.Random(5)
    lines = {g: [(k, k + 1, pick.choice([0.0, 0.25, 1.0])) for k in range(12)] + [(pick.randrange(13), pick.randrange(13), pick.choice([0.5, 3.0, 9.0])) for _ in range(12)] for g in (1, 2)}
    lines[2] = lines[2][3:]
    vertices = spark.createDataFrame([(g, v) for g in (1, 2) for v in range(15)], "graph_id long, vid long")
    edges = spark.createDataFrame([(g, a, b, x) for g, rows in lines.items() for a, b, x in rows], "graph_id long, src long, dst long, len double")
    found = {(r["graph_id"], r["root"], r["vid"]): r["distance"] for r in paths.shortest_paths(vertices, edges, "len", delta=delta).collect()}
    true = {(g, root, v): far for g in (1, 2) for root in range(15) for v, far in dijkstra(lines[g], root).items()}
    assert found.keys() == true.keys() and all(math.isclose(found[k], true[k], abs_tol=1e-9) for k in true)


def test_paths_in_narrow_buckets(spark):
    """All edges but one are longer than a bucket, and a detour of short ones beats a long edge."""
    lines = [(0, 1, 0.1), (1, 2, 0.5), (0, 2, 0.9), (2, 3, 0.3)]
    vertices = spark.createDataFrame([(1, v) for v in range(4)], "graph_id long, vid long")
    edges = spark.createDataFrame([(1, *line) for line in lines], "graph_id long, src long, dst long, len double")
    rows = paths.shortest_paths(vertices, edges, "len", roots=vertices.filter("vid = 0"), delta=0.2).collect()
    true = dijkstra(lines, 0)
    assert {r["vid"] for r in rows} == true.keys() and all(math.isclose(r["distance"], true[r["vid"]], abs_tol=1e-9) for r in rows)


def test_paths_of_chosen_roots_and_odd_edges(spark):
    vertices = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "graph_id long, vid long")
    edges = spark.createDataFrame([(1, 0, 1, None), (1, 1, 2, 2.0)], "graph_id long, src long, dst long, len double")
    rows = paths.shortest_paths(vertices, edges, "len", roots=vertices.filter("vid = 0"))
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 0, 0, 0.0), (1, 0, 1, 1.0), (1, 0, 2, 3.0)]
    assert sorted(r["distance"] for r in paths.normalized(rows).collect()) == [0.0, 1 / 3, 1.0]
    assert paths.shortest_paths(vertices, edges.limit(0)).count() == 3
    assert paths.shortest_paths(vertices.limit(0), edges.limit(0)).count() == 0
    for wrong in (-1.0, float("nan"), float("inf")):
        bad = spark.createDataFrame([(1, 0, 1, wrong)], edges.schema)
        with pytest.raises(Exception, match="negative or not finite"):
            paths.shortest_paths(vertices, bad, "len").collect()


@pytest.mark.parametrize("small", [0, 40, 256])
def test_paths_of_small_and_large_graphs(spark, monkeypatch, small):
    """Graphs of 1 to 30 vertices; small ones need no steps, and either way has the paths of plain search."""
    monkeypatch.setattr(paths, "SMALL", small)
    monkeypatch.setattr(paths, "CELLS", 60)
    stepped, steps = [], paths.stepped_paths
    monkeypatch.setattr(paths, "stepped_paths", lambda roots, *a: stepped.extend(r[0] for r in roots.select("graph_id").distinct().collect()) or steps(roots, *a))
    pick = random.Random(small)
    sizes = {g: n for g, n in enumerate([1, 2, 2, 5, 5, 30], 10)}
    lines = {g: [(pick.randrange(n), pick.randrange(n), pick.choice([0.0, 0.1, 0.2, 1.7])) for _ in range(2 * n)] for g, n in sizes.items()}
    vertices = spark.createDataFrame([(g, v) for g, n in sizes.items() for v in range(n)], "graph_id long, vid long")
    edges = spark.createDataFrame([(g, a, b, x) for g, rows in lines.items() for a, b, x in rows], "graph_id long, src long, dst long, len double")
    true = {(g, root, v): far for g, n in sizes.items() for root in range(n) for v, far in dijkstra(lines[g], root).items()}
    most = {g: max(far for (h, _, _), far in true.items() if h == g) for g in sizes}
    for shares in (False, True):
        found = {tuple(r)[:3]: r["distance"] for r in paths.shortest_paths(vertices, edges, "len", shares=shares).collect()}
        assert found.keys() == true.keys() and all(math.isclose(found[k], (true[k] / most[k[0]] if most[k[0]] else 0.0) if shares else true[k], abs_tol=1e-9) for k in true)
    assert set(stepped) == {0: set(sizes), 40: {15}, 256: set()}[small]


def test_kmeans_equals_mllib_from_one_start(spark):
    """Sparse rows around five middles; feature numbers are apart, so that rows share few of them."""
    draw = np.random.default_rng(2)
    middle = draw.normal(0, 4, (5, 12)) * (draw.random((5, 12)) < 0.5)
    data = np.array([middle[k % 5] + draw.normal(0, 1, 12) * (middle[k % 5] != 0) for k in range(120)])
    rows = [(k, 7 * j, float(x)) for k, row in enumerate(data) for j, x in enumerate(row) if x]
    start = [(c, 7 * j, float(x)) for c in range(5) for j, x in enumerate(data[c * 3]) if x]
    found, centers = clusters.kmeans(spark.createDataFrame(rows, "id long, feature long, value double"), ["id"], iterations=15, start=spark.createDataFrame(start, "center int, feature long, value double"))
    model = KMeans.train(spark.sparkContext.parallelize([Vectors.dense(r) for r in data]), 5, maxIterations=15, initialModel=KMeansModel([Vectors.dense(data[c * 3]) for c in range(5)]), epsilon=1e-12)
    for r in found.collect():
        assert r["cluster"] == model.predict(Vectors.dense(data[r["id"]]))
        assert np.allclose(r["distances"], [np.linalg.norm(data[r["id"]] - c) for c in model.clusterCenters], atol=1e-4)
    for r in centers.collect():
        assert math.isclose(model.clusterCenters[r["center"]][r["feature"] // 7], r["value"], abs_tol=1e-9)


def test_first_centers_differ_and_may_be_few(spark):
    rows = spark.createDataFrame([(k, 1, float(k % 3)) for k in range(30)], "id long, feature long, value double")
    assert sorted(r["value"] for r in clusters.first_centers(rows, ["id"], 3).collect()) == [0.0, 1.0, 2.0]
    found, _ = clusters.kmeans(rows, ["id"], 8)
    assert {len(r["distances"]) for r in found.collect()} == {3} and all(min(r["distances"]) == 0 for r in found.collect())
    assert clusters.kmeans(rows.limit(0), ["id"], 2)[0].collect() == []


def test_vectors_of_vertices_become_labels(spark):
    rows = [(1, k, "x", [float(k // 4) * 10, 1.0]) for k in range(8)] + [(1, 8, "x", None), (1, 9, "x", [])]
    found = learning.vector_relabel(spark.createDataFrame(rows, "graph_id long, vid long, label string, vec array<double>"), 2).collect()
    by = {r["vid"]: r for r in found}
    assert len({by[k]["label"] for k in range(4)}) == len({by[k]["label"] for k in range(4, 8)}) == 1 and by[0]["label"] != by[7]["label"]
    assert all(max(by[k]["vec"]) == 1.0 and math.isclose(min(by[k]["vec"]), 1 / 11) for k in range(8))
    assert by[8]["label"] is None and by[9]["vec"] is None


def test_quantiles_equal_sorted_values(spark):
    pick, rows, points = random.Random(4), [], {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    makers = [lambda: pick.gauss(0, 1), lambda: 10 ** pick.uniform(-300, 300), lambda: float(pick.randrange(3)), lambda: pick.choice([-1.7e308, 1.7e308, 0.0]), lambda: 5.0]
    true = {}
    for key in range(10):
        values = [makers[key % 5]() for _ in range([1, 2, 501, 1000][key % 4])]
        true[key] = sorted(values)
        rows += [(key, v) for v in values] + [(key, None)]
    rows += [(99, None), (None, 1.0)]
    pick.shuffle(rows)
    found = {r["key"]: r for r in quantiles.quantiles(spark.createDataFrame(rows, "key long, x double"), "key", "x", points).collect()}
    assert found.keys() == true.keys() | {99} and all(found[99][p] is None for p in points)
    for key, values in true.items():
        for name, p in points.items():
            at = (len(values) - 1) * p
            low, high = values[math.floor(at)], values[math.ceil(at)]
            assert low <= found[key][name] <= high or math.isinf(high - low)
            if not math.isinf(high - low):
                assert math.isclose(found[key][name], low + (high - low) * (at - math.floor(at)), rel_tol=1e-9)


def test_quantiles_of_infinite_values(spark):
    """The greatest value is NaN, and infinite ones are values as others."""
    rows = [(1, x) for x in (float("-inf"), -2.0, 3.0, 4.0, float("inf"), float("inf"), float("nan"))]
    wanted = spark.createDataFrame([(1, k) for k in range(7)], "key long, rank long")
    found = sorted((r["rank"], str(r["x"])) for r in quantiles.order_statistics(spark.createDataFrame(rows, "key long, x double"), "key", "x", wanted).collect())
    assert [x for _, x in found] == ["-inf", "-2.0", "3.0", "4.0", "inf", "inf", "nan"]


@pytest.mark.parametrize("name", ["weighted_paths", "score_percentiles"])
def test_queries_at_a_larger_size(spark, medium, name):
    import __spark_entry__

    __spark_entry__.queries()
    assert spark_rows(registry.QUERIES[name](spark, medium)) == sql_rows(registry.SQL[name], medium)
