"""Queries without SQL against plain versions or what must hold of them."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from vicinage.functions.lineage import cut
from vicinage.operators import align, graph_vectorizer, motifs
from vicinage.operators.options import GraphOptions
from vicinage.plans import data_queries


def run(spark, small, name):
    return entry_module.queries()[name](spark, small)


def area(rows):
    """Share of (positive, negative) pairs in the right order."""
    good, bad = ([m for y, m in rows if y == k] for k in (1, 0))
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize("name", ["fit_predict", "sequence_predict"])
def test_classifiers_fit_their_labels(spark, small, name):
    rows = run(spark, small, name).collect()
    assert len(rows) == spark.read.parquet(f"{small}/part.parquet").count()
    assert area([(r["label"], r["margin"]) for r in rows]) > 0.9
    if name == "fit_predict":
        assert all(r["prediction"] == int(r["margin"] > 0) for r in rows if abs(r["margin"]) > 1e-3)


def test_regression_explains_length(spark, small):
    rows = [(r["length"], r["prediction"]) for r in run(spark, small, "regress").collect()]
    mean = sum(y for y, _ in rows) / len(rows)
    assert sum((y - p) ** 2 for y, p in rows) < 0.5 * sum((y - mean) ** 2 for y, _ in rows)


def test_validation(spark, small):
    folds = run(spark, small, "cross_val_auc").collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3, 4]
    assert all(0.5 < r["auc"] <= 1 and 0 < r["average_precision"] <= 1 for r in folds)
    curve = sorted((r["fraction"], r["fold"], r["train_auc"], r["test_auc"]) for r in run(spark, small, "learning_curve").collect())
    assert len(curve) == 50 and {r[0] for r in curve[-5:]} == {1} and all(0 <= r[3] <= 1 and r[2] > 0.9 for r in curve)


def test_labels_are_nearest_centres(spark, small):
    rows = run(spark, small, "auto_label").collect()
    assert rows and all(len(r["vec"]) == 4 and 0 <= min(r["vec"]) for r in rows)
    assert all(math.isclose(r["vec"][int(r["label"])], min(r["vec"]), rel_tol=1e-6, abs_tol=1e-9) for r in rows)
    assert {r["cluster"] for r in run(spark, small, "cluster").collect()} <= set(range(8))


def test_matching_is_stable(spark, small):
    """No two vertices would both rather have each other, by rank with ties by id."""
    g = data_queries._names_by_twos(spark, small)
    gaps = {}
    for r in align.vertex_distances(graph_vectorizer.vertex_vectorize(g[0], g[1], data_queries.BASE), g[2]).collect():
        gaps.setdefault(r["pair_id"], {})[r["a_vid"], r["b_vid"]] = r["distance"]
    found = {}
    for r in run(spark, small, "stable_match").collect():
        found.setdefault(r["pair_id"], {})[r["a_vid"]] = r["b_vid"]
    assert found.keys() == gaps.keys()
    for pair, gap in gaps.items():
        own, back = found[pair], {b: a for a, b in found[pair].items()}
        assert len(back) == len(own) == min(len({a for a, _ in gap}), len({b for _, b in gap}))
        for (a, b), d in gap.items():
            a_rather = a not in own or (d, b) < (gap[a, own[a]], own[a])
            b_rather = b not in back or (d, a) < (gap[back[b], b], back[b])
            assert not (a_rather and b_rather)


def test_stretches_equal_plain_search(spark, small):
    def largest(x):
        return max((sum(x[i : j + 1]), -i, -j) for i in range(len(x)) for j in range(i, len(x)))

    scores = data_queries._event_scores(spark, small).filter(F.size("score") < 60).collect()
    got = {}
    for r in motifs.iterated_max_subarrays(data_queries._event_scores(spark, small), 2, 10).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r
    assert scores
    for row in scores:
        best, begin, end = largest(list(row["score"]))
        first = got.get(row["id"], {}).get(0)
        if -end + begin + 1 >= 2 and best > 0 and -end + begin + 1 + 2 <= 10:
            assert first is not None and math.isclose(first["score"], best, abs_tol=1e-6)
        for r in got.get(row["id"], {}).values():
            assert r["size"] == r["end"] - r["begin"] <= 10 and r["motif"] == "".join(row["tokens"][r["begin"] : r["end"]])


def paths(names):
    vertices = [(i, k, c) for i, name in names.items() for k, c in enumerate(name)]
    edges = [(i, k, k + 1, "-") for i, name in names.items() for k in range(len(name) - 1)]
    return vertices, edges


def test_alignment_of_equal_and_shorter_graphs(spark):
    vertices, edges = paths({1: "abcdef", 2: "abcdef", 3: "bcd", 4: "abcdefg"})
    v = spark.createDataFrame(vertices, "graph_id long, vid long, label string")
    e = spark.createDataFrame(edges, "graph_id long, src long, dst long, label string")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 4, 3)], "pair_id long, a_id long, b_id long")
    found = cut(align.match(v, e, pairs, complexity=2, max_depth=3))
    rows = {(r["pair_id"], r["a_vid"]): r["b_vid"] for r in found.collect()}
    assert {k[1]: b for k, b in rows.items() if k[0] == 1} == {k: k for k in range(6)}
    second = {k[1]: b for k, b in rows.items() if k[0] == 2}
    assert set(second) <= set(range(7)) and len(set(second.values())) == len(second) <= 3 and set(second.values()) <= set(range(3))
    quality = {r["pair_id"]: r["quality"] for r in align.matching_quality(v, e, pairs, found).collect()}
    assert quality[1] == 1.0 and 0 <= quality[2] <= 1


def test_searches_find_a_setting(spark, monkeypatch):
    """With a matching that is right at complexity 2 only."""
    vertices, edges = paths({1: "abca", 2: "abca"})
    v = spark.createDataFrame(vertices, "graph_id long, vid long, label string")
    e = spark.createDataFrame(edges, "graph_id long, src long, dst long, label string")
    pairs = spark.createDataFrame([(1, 1, 2)], "pair_id long, a_id long, b_id long")
    right = spark.createDataFrame([(1, k, k) for k in range(4)], "pair_id long, a_vid long, b_vid long")
    monkeypatch.setattr(align, "match", lambda v, e, p, complexity, order, depth: right if complexity == 2 else right.limit(0))
    start = spark.createDataFrame([(1, 1, 1, 1)], "pair_id long, complexity int, order int, max_depth int")
    best = align.line_search(v, e, pairs, start, n_iter=1, ranges=((3, 2), (1,), (2,))).first()
    assert (best["quality"], best["complexity"], best["order"], best["max_depth"]) == (1.0, 2, 1, 2)


def test_lifted_vectors_keep_linearity(spark):
    """Doubling the vectors doubles the features."""
    rows = [(1, k, "ab"[k % 2], [float(k), 1.0]) for k in range(4)]
    v = spark.createDataFrame(rows, "graph_id long, vid long, label string, vec array<double>")
    e = spark.createDataFrame([(1, k, k + 1, "-") for k in range(3)], "graph_id long, src long, dst long, label string")
    options = GraphOptions(r=1, d=1, nbits=16, discrete=False, normalization=False, inner_normalization=False)
    sums = [{r["feature"]: r["value"] for r in graph_vectorizer.vectorize(x, e, options).collect()} for x in (v, v.withColumn("vec", F.transform("vec", lambda y: 2 * y)))]
    assert sums[0].keys() == sums[1].keys() and all(math.isclose(2 * sums[0][f], sums[1][f], abs_tol=1e-9) for f in sums[0])
