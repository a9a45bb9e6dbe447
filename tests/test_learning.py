"""Validation, estimates and selection of models on a few small vectors, beside plain Python."""

import math
import random

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from vicinage.operators import graph_vectorizer, learning, sampling
from vicinage.operators.options import GraphOptions, SequenceOptions, described
from vicinage.sources import corpora, formats

FAST = {"iterations": 5}


@pytest.fixture(scope="module")
def vectors(spark):
    """Forty rows; feature 1 tells the label, others are noise."""
    draw = random.Random(3)
    rows = [(k, k % 2, SparseVector(8, sorted({1 + k % 2: 1.0, 3 + draw.randrange(4): 0.5}.items()))) for k in range(40)]
    return spark.createDataFrame(rows, ["id", "label", "features"]).cache()


def test_estimates_of_scores_equal_plain_ones(spark, vectors):
    scored = [(1, 0.5), (1, -0.2), (0, -0.3), (0, 0.1), (1, 0.9)]
    row = learning.estimated(spark.createDataFrame(scored, "label int, margin double")).first()
    pairs = [(g, b) for y, g in scored if y for z, b in scored if not z]
    assert math.isclose(row["auc"], sum(g > b for g, b in pairs) / len(pairs))
    assert row["accuracy"] == 0.6
    one, report = learning.estimate_model(learning.fit(vectors, **FAST), vectors)
    assert one.first()["auc"] == 1
    assert sorted((r["class"], r["support"], r["f1"]) for r in report.collect()) == [(0, 20, 1), (1, 20, 1)]


def test_relabelled_graphs_and_selection(spark):
    names = spark.createDataFrame([(k, list("abcabc" if k % 2 else "xyzxyz")) for k in range(12)], "id long, tokens array<string>")
    vertices, edges = corpora.paths(names)
    options = GraphOptions(r=0, d=1, nbits=8)
    rows = learning.auto_relabel(vertices, edges, options, 3).collect()
    assert len(rows) == 72 and {r["label"] for r in rows} <= {"0", "1", "2"} and {len(r["vec"]) for r in rows} == {3}
    assert all(math.isclose(r["vec"][int(r["label"])], min(r["vec"]), abs_tol=1e-9) for r in rows)
    targets = names.select(F.col("id").alias("graph_id"), (F.col("id") % 2).cast("int").alias("label"))
    best, scores = learning.model_selection(vertices, edges, targets, options, n_iter=1, radii=(1,), distances=(0,), count=2)
    assert (best.r, best.d) == (1, 0) and [tuple(r) for r in scores.collect()] == [(1, 0, 1.0)]


def test_options():
    for wrong in ({"nbits": 0}, {"nbits": 40}, {"r": -1}, {"min_d": -1}):
        with pytest.raises(ValueError):
            GraphOptions(**wrong)
        with pytest.raises(ValueError):
            SequenceOptions(**wrong)
    options = GraphOptions(r=1, weights_dict=((0, 1, 1.0),))
    assert GraphOptions.loaded(options.saved()) == options
    assert described({"b": 1, "a": "x\ny"}) == "         a: x y\n         b: 1"
    assert len(described({"a": "x" * 200}, full=False)) == 127


def test_graphs_without_vertices_fail(spark):
    graphs, vertices = spark.range(2).withColumnRenamed("id", "graph_id"), spark.createDataFrame([(0, 0)], "graph_id long, vid long")
    assert graph_vectorizer.without_empty(graphs.filter("graph_id = 0"), vertices).count() == 1
    with pytest.raises(Exception, match="graph without vertices: 1"):
        graph_vectorizer.without_empty(graphs, vertices).collect()


def test_processes_need_a_weight_each(spark):
    with pytest.raises(ValueError):
        sampling.pre_processed(spark.range(1), [lambda d: d], [])


def test_gspan_files(spark, tmp_path):
    vertices = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "graph_id long, vid long, label string")
    edges = spark.createDataFrame([(1, 0, 1, "-")], "graph_id long, src long, dst long, label string")
    formats.write_gspan(vertices, edges, f"{tmp_path}/g")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/g").collect()] == ["t # 1", "v 0 a", "v 1 b", "e 0 1 -"]
