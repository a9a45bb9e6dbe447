"""All pairs by blocks, beside plain loops."""

import itertools
import random

from vicinage.operators import gaps, links


def test_non_edges_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 4)
    pick = random.Random(3)
    sizes = {1: 30, 2: 1, 3: 9}
    edges = {(g, *sorted(pick.sample(range(n), 2))) for g, n in sizes.items() for _ in range(n * 2) if n > 1} | {(1, 0, v) for v in range(1, 25)}
    vertices = spark.createDataFrame([(g, v, "x") for g, n in sizes.items() for v in range(n)], "graph_id long, vid long, label string")
    lines = spark.createDataFrame([(g, *((u, v) if k % 2 else (v, u)), "-") for k, (g, u, v) in enumerate(sorted(edges))], "graph_id long, src long, dst long, label string")
    found = links.non_edges(vertices, lines)
    assert sorted(map(tuple, found.collect())) == [(g, u, v) for g, n in sizes.items() for u, v in itertools.combinations(range(n), 2) if (g, u, v) not in edges]
    assert "LeftAnti" not in found._jdf.queryExecution().executedPlan().toString()


def test_gaps_by_blocks(spark, monkeypatch):
    """Copies, a null vector, one with a null, an empty one and one of another size."""
    monkeypatch.setattr(gaps, "BLOCK", 5)
    monkeypatch.setattr(gaps, "QUERIES", 2)
    pick = random.Random(4)
    rows = [(k, [pick.choice([0.0, 0.5, 1.25]) for _ in range(3)]) for k in range(40)] + [(40, None), (41, [1.0, None, 2.0]), (42, []), (43, [1.0]), (44, [])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")

    def gap(x, y):
        if x is None or y is None or len(x) != len(y) or None in x + y:
            return None
        return round(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5, 5)

    plain = [(i, j, gap(x, y)) for i, x in rows if i % 4 == 0 for j, y in rows if i != j]
    key = lambda r: (r[0], r[2] is not None, r[2] or 0, r[1])
    queries = vectors.filter("id % 4 = 0")
    for small in (200, 0):
        monkeypatch.setattr(gaps, "SMALL", small)
        assert sorted(map(tuple, gaps.gaps(queries, vectors).collect()), key=key) == sorted(plain, key=key)
    best = [r for _, group in itertools.groupby(sorted(plain, key=key), lambda r: r[0]) for r in itertools.islice(group, 5)]
    assert sorted((tuple(r)[:3] for r in gaps.nearest(queries, vectors, 5).collect()), key=key) == best


def test_paths_between_equal_vertices(spark, monkeypatch):
    """Stars joined in a ring, leaves of two middles, lone vertices: plain search has the same hops, and copies are not searched."""
    monkeypatch.setattr(links, "PART", 4)
    lines = [(0, 1), (1, 2), (2, 0), (2, 3)] + [(v % 3, 10 + v) for v in range(20)] + [(x, 40 + v) for v in range(9) for x in (0, 3)]
    near = {v: set() for v in [*range(4), *range(10, 30), *range(40, 49), 60, 61]}
    for a, b in lines:
        near[a].add(b)
        near[b].add(a)
    searched, plain = [], links.distances
    monkeypatch.setattr(links, "distances", lambda roots, *a: searched.append(roots.count()) or plain(roots, *a))
    vertices = spark.createDataFrame([(5, v) for v in near if v not in (3, 12)], "graph_id long, vid long")  # two ends are no vertices
    edges = spark.createDataFrame([(5, a, b, "-") for a, b in lines], "graph_id long, src long, dst long, label string")
    for depth in (0, 1, 3):
        want = []
        for root in set(near) - {3, 12}:
            hops, level = {root: 0}, {root}
            for hop in range(1, depth + 1):
                level = {y for x in level for y in near[x]} - set(hops)
                hops |= dict.fromkeys(level, hop)
            want += [(5, root, v, h) for v, h in hops.items()]
        assert sorted(map(tuple, links.path_lengths(vertices, edges, depth).collect())) == sorted(want)
    assert searched == [10] * 3
