"""Features that copies share, beside those of each graph or sequence by itself; joins of exploded rows."""

import random

import pytest
from compare import spark_rows

import __spark_entry__ as entry_module
from vicinage.operators import graph_vectorizer as G
from vicinage.operators import sequence_vectorizer as S
from vicinage.operators.copies import shared
from vicinage.operators.options import GraphOptions, SequenceOptions


def graphs(spark, copies):
    """Six kinds of weighted graphs, one of them with an edge given twice, one with a lone vertex."""
    pick, vertices, edges = random.Random(5), [], []
    for kind in range(6):
        own = [(v, pick.choice("ab"), pick.choice([1.0, 0.5, None])) for v in range(1 if kind == 5 else 4)]
        lines = [(v - 1, v, "-", pick.choice([None, 2.0])) for v in range(1, len(own))] * (2 if kind in (0, 1) else 1)
        for copy in range(copies * (20 if kind == 2 else 1)):
            vertices += [(kind + 6 * copy, *row) for row in own]
            edges += [(kind + 6 * copy, *row) for row in lines]
    pick.shuffle(vertices)
    pick.shuffle(edges)
    return spark.createDataFrame(vertices, "graph_id long, vid long, label string, weight double"), spark.createDataFrame(edges, "graph_id long, src long, dst long, label string, weight double")


@pytest.mark.parametrize("copies", [1, 3])
def test_copies_of_graphs(spark, copies):
    vertices, edges = graphs(spark, copies)
    options = GraphOptions(r=1, d=2, nbits=20)
    for make, keys in ((G.vectorize, ["graph_id"]), (G.vertex_vectorize, ["graph_id", "vid"])):
        plain = G.normalized(G.rooted_features(vertices, edges, options), keys, options)
        assert spark_rows(make(vertices, edges, options)) == spark_rows(plain)


@pytest.mark.parametrize("copies", [1, 3])
def test_copies_of_sequences(spark, copies):
    """One id has two sequences, of which other ids have one each."""
    kinds = [(["a", "b", "c"], [1.0, 0.0, 2.0]), (["a", "b", "c"], None), (["a"], [3.0]), (["a,b", "c"], [1.0, 1.0])]
    rows = [(10 * c + k, *kind) for c in range(copies) for k, kind in enumerate(kinds)] + [(7, *kinds[0]), (7, *kinds[2])]
    sequences, options = spark.createDataFrame(rows, "id long, tokens array<string>, weights array<double>"), SequenceOptions(r=1, d=1, nbits=20)
    assert spark_rows(S.vectorize(sequences, options)) == spark_rows(G.normalized(S._pairs(sequences, options), ["id"], options))
    assert spark_rows(S.position_vectorize(sequences, options)) == spark_rows(S._of_positions(S._pairs(sequences, options), options))


def test_only_one_of_each_kind_is_worked_on(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(10)] + [(k, "ab"[k % 2]) for k in range(2)], "id long, token string")
    seen = []

    def make(one):
        seen.append(sorted({r["id"] for r in one.collect()}))
        return one

    assert shared("id", (rows,), make).count() == 12
    assert seen == [[0, 1, 2, 3]]


@pytest.mark.parametrize("name", ["annotate_null", "line_serialize_graph"])
def test_exploded_rows_are_not_broadcast(spark, small, name):
    """Spark takes a name's vertices for as small as the name; their joins would gather all of them in the driver."""
    assert "Broadcast" not in entry_module.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["max_common_subgraph", "largest_common_fraction"])
def test_matched_vertices_are_not_broadcast(spark, small, name):
    """The same of the vertices and edges of all pairs of names."""
    assert "Broadcast" not in entry_module.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
