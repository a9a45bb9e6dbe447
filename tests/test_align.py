"""Common subgraphs of long paths."""

from compare import spark_rows, sql_rows

import __spark_entry__ as entry_module
from vicinage.operators import align


def test_long_names_stay_whole(spark, tmp_path):
    names = ["a" * 40, "a" * 60, "ab" * 45, "ab" * 20 + "c" + "ab" * 20, "x"]
    spark.createDataFrame(list(enumerate(names, 1)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = entry_module.queries()["max_common_subgraph"](spark, str(tmp_path))
    assert spark_rows(found) == sql_rows(entry_module.oracle_sql()["max_common_subgraph"], tmp_path)
    assert found.filter("pair_id = 2").first()["largest"] == 40


def test_lone_vertices_are_no_common_parts(spark):
    """Two equal graphs of one edge and a lone vertex: two of three vertices are in common, and have kept neighbours."""
    vertices = spark.createDataFrame([(g, v, "c") for g in (1, 2) for v in range(3)], "graph_id long, vid long, label string")
    edges = spark.createDataFrame([(g, 0, 1, "-") for g in (1, 2)], "graph_id long, src long, dst long, label string")
    pairs = spark.createDataFrame([(7, 1, 2)], "pair_id long, a_id long, b_id long")
    matching = spark.createDataFrame([(7, v, v) for v in range(3)], "pair_id long, a_vid long, b_vid long")
    assert [tuple(r) for r in align.common_subgraphs(vertices, edges, pairs, matching).collect()] == [(7, 0, 2)]
    for found in (align.matching_neighborhoods_fraction, align.largest_common_fraction, align.matching_quality):
        assert abs(found(vertices, edges, pairs, matching).first()[1] - 2 / 3) < 1e-12


def test_parts_are_joined_by_edges_of_the_second_graph(spark):
    """a has two edges apart; b has another one between them, which connects the common part."""
    vertices = spark.createDataFrame([(g, v, "c") for g in (1, 2) for v in range(4)], "graph_id long, vid long, label string")
    edges = spark.createDataFrame([(1, 0, 1, "-"), (1, 2, 3, "-"), (2, 0, 1, "-"), (2, 2, 3, "-"), (2, 1, 2, "-")], "graph_id long, src long, dst long, label string")
    pairs = spark.createDataFrame([(7, 1, 2)], "pair_id long, a_id long, b_id long")
    matching = spark.createDataFrame([(7, v, v) for v in range(4)], "pair_id long, a_vid long, b_vid long")
    assert [tuple(r) for r in align.common_subgraphs(vertices, edges, pairs, matching).collect()] == [(7, 0, 4)]
    assert align.matching_neighborhoods_fraction(vertices, edges, pairs, matching).first()[1] == 1


def test_equal_pairs_are_matched_once(spark, monkeypatch):
    """Four kinds of names, a copy of each pair many times over, and a pair of its own: one pair of a kind is vectorized, all get its rows."""
    names = ["abcab", "bcabc", "cab", "abcabca"]
    texts = {k: names[k % 4] for k in range(40)} | {40: "bbcabx", 41: "ab"}
    vertices = spark.createDataFrame([(g, v, c) for g, t in texts.items() for v, c in enumerate(t)], "graph_id long, vid long, label string")
    edges = spark.createDataFrame([(g, v - 1, v, "-") for g, t in texts.items() for v in range(1, len(t))], "graph_id long, src long, dst long, label string")
    pairs = spark.createDataFrame([(k, k + 1, k) for k in range(0, 42, 2)], "pair_id long, a_id long, b_id long")
    sizes, make = [], align.vertex_vectorize

    def watched(v, e, options):
        sizes.append(v.select("graph_id").distinct().count())
        return make(v, e, options)

    monkeypatch.setattr(align, "vertex_vectorize", watched)
    found = spark_rows(align.match(vertices, edges, pairs, 2, 3, 3))
    assert sizes == [6, 6]
    assert found == spark_rows(align._matched(vertices, edges, pairs, 2, 3, 3, 16)) and sizes[2:] == [42, 42]
