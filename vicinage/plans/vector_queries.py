"""Queries of the graph and sequence vectorizers, kernels and annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinage.functions.lineage import stored
from vicinage.operators import annotate, graph_vectorizer, kernel, sequence_vectorizer
from vicinage.operators.options import GraphOptions, SequenceOptions
from vicinage.plans.reference_sql import graph_ctes, sequence_ctes
from vicinage.plans.registry import query, rounded
from vicinage.sources import corpora as C

BASE = GraphOptions(r=1, d=1, nbits=20)
VALUE = "round(value, 6) + 0.0 AS value"


def _graph(name: str, corpus, sql: tuple[str, str], options: GraphOptions, by_vertex: bool = False) -> None:
    make = graph_vectorizer.vertex_vectorize if by_vertex else graph_vectorizer.vectorize
    query(name, lambda spark, sf: rounded(make(*corpus(spark, sf), options), "value"), graph_ctes(sql, options, by_vertex) + f" SELECT graph_id, {'vid, ' if by_vertex else ''}feature, {VALUE} FROM result")


_graph("graph_vectorize", C.name_graphs, C.NAMES_SQL, BASE)
_graph("graph_vectorize_r2d2", C.name_graphs, C.NAMES_SQL, BASE.set_params(r=2, d=2))
_graph("graph_vectorize_positional", C.name_graphs, C.NAMES_SQL, BASE.set_params(positional=True))
_graph("graph_vectorize_context", C.name_graphs, C.NAMES_SQL, BASE.set_params(use_only_context=True))
_graph("graph_vectorize_weights_dict", C.name_graphs, C.NAMES_SQL, BASE.set_params(r=2, d=2, weights_dict=((0, 1, 1.0), (1, 2, 2.0), (2, 2, 0.5))))
_graph("graph_vectorize_auto_weights", C.name_graphs, C.NAMES_SQL, BASE.set_params(r=2, d=2, auto_weights=True))
_graph("graph_vectorize_min_rd", C.name_graphs, C.NAMES_SQL, BASE.set_params(r=2, d=2, min_r=1, min_d=1))
_graph("graph_vectorize_no_norm", C.name_graphs, C.NAMES_SQL, BASE.set_params(normalization=False, inner_normalization=False))
_graph("vertex_vectorize", C.name_graphs, C.NAMES_SQL, BASE, by_vertex=True)
_graph("word_graph_vectorize", C.word_graphs, C.WORDS_SQL, BASE)
_graph("graph_vectorize_weighted", C.order_graphs, C.ORDERS_SQL, BASE.set_params(d=2))
_graph("graph_vectorize_nested", C.role_graphs, C.ROLES_SQL, BASE)
_graph("graph_vectorize_vec", C.vector_graphs, C.VECTORS_SQL, BASE.set_params(discrete=False, normalization=False))


def _sequence(name: str, corpus, sql: str, options: SequenceOptions, weighted: bool = False, by_position: bool = False) -> None:
    make = sequence_vectorizer.position_vectorize if by_position else sequence_vectorizer.vectorize
    query(name, lambda spark, sf: rounded(make(corpus(spark, sf), options), "value"), sequence_ctes(sql, options, weighted, by_position) + f" SELECT id, {'pos, ' if by_position else ''}feature, {VALUE} FROM result")


SEQUENCE = SequenceOptions(nbits=20)
_sequence("sequence_vectorize", C.names, C.PART_SQL, SEQUENCE)
_sequence("sequence_vectorize_weighted", C.event_sequences, C.EVENTS_SQL, SEQUENCE.set_params(r=2, d=2), weighted=True)
_sequence("sequence_vectorize_context", C.names, C.PART_SQL, SEQUENCE.set_params(use_only_context=True))
_sequence("sequence_vectorize_min_d1", C.names, C.PART_SQL, SEQUENCE.set_params(min_d=1, min_r=1))
_sequence("sequence_vectorize_weights_dict", C.names, C.PART_SQL, SEQUENCE.set_params(weights_dict=((0, 0, 1.0), (1, 2, 3.0))))
_sequence("sequence_vectorize_per_position", C.names, C.PART_SQL, SEQUENCE.set_params(r=2, d=1), by_position=True)


def _similarity(spark, sf):
    features = sequence_vectorizer.vectorize(C.names(spark, sf), SEQUENCE)
    return rounded(sequence_vectorizer.similarity(features, features.filter("id = 1")), "similarity")


query("sequence_similarity", _similarity, sequence_ctes(C.PART_SQL, SEQUENCE) + " SELECT r.id, round(sum(r.value * coalesce(o.value, 0)), 6) + 0.0 AS similarity FROM result r LEFT JOIN (SELECT feature, value FROM result WHERE id = 1) o USING (feature) GROUP BY r.id")


def _names_vectors(spark, sf):
    """Vectors of all names, and of the queries."""
    rows = stored(graph_vectorizer.vectorize(*C.name_graphs(spark, sf), BASE))
    return rows, rows.filter("graph_id % 50 = 0")


query(
    "kernel_matrix", lambda spark, sf: rounded(kernel.kernel_matrix(*_names_vectors(spark, sf)), "k"),
    graph_ctes(C.NAMES_SQL, BASE) + ", few AS (SELECT * FROM result WHERE graph_id % 50 = 0), ids AS (SELECT DISTINCT graph_id FROM result) SELECT a.graph_id AS i, b.graph_id AS j, round(coalesce(k, 0), 6) + 0.0 AS k FROM ids a CROSS JOIN ids b LEFT JOIN (SELECT x.graph_id AS p, y.graph_id AS q, sum(x.value * y.value) AS k FROM few x JOIN result y USING (feature) GROUP BY ALL) z ON z.p = a.graph_id AND z.q = b.graph_id WHERE a.graph_id % 50 = 0",
)
query(
    "kernel_topk", lambda spark, sf: rounded(kernel.nearest(*reversed(_names_vectors(spark, sf)), 3), "k"),
    graph_ctes(C.NAMES_SQL, BASE) + ", z AS (SELECT x.graph_id AS i, y.graph_id AS j, round(sum(x.value * y.value), 6) + 0.0 AS k FROM result x JOIN result y USING (feature) WHERE x.graph_id % 50 = 0 AND x.graph_id <> y.graph_id GROUP BY ALL) SELECT i, j, k, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY k DESC, j) AS rank FROM z) WHERE rank <= 3",
)
query(
    "annotate_null", lambda spark, sf: rounded(annotate.annotate(*C.name_graphs(spark, sf), BASE), "importance", "weight"),
    f"WITH v AS ({C.NAMES_SQL[0]}) SELECT graph_id, vid, label, 1 AS class, round(1.0::DOUBLE / (2 * count(*) OVER (PARTITION BY graph_id) - 1), 6) + 0.0 AS importance, round(1.0::DOUBLE / (2 * count(*) OVER (PARTITION BY graph_id) - 1), 6) + 0.0 AS weight FROM v",
)
_LINEAR = graph_ctes(C.NAMES_SQL, BASE, by_vertex=True) + ", margins AS (SELECT graph_id, vid, sum(value * (feature % 7 - 3) / 10.0::DOUBLE) + 0.05 AS m FROM result GROUP BY ALL) "
query(
    "annotate_linear",
    lambda spark, sf: rounded(annotate.annotate(*C.name_graphs(spark, sf), BASE, annotate.Linear(((F.col("feature") % 7) - 3) / F.lit(10.0), 0.05), threshold=0.0, scale=2.0), "importance", "weight"),
    _LINEAR + "SELECT v.graph_id, v.vid, v.label, CASE WHEN round(m, 9) > 0 THEN 1 ELSE -1 END AS class, round(greatest(m, 0), 6) + 0.0 AS importance, round(2 * abs(greatest(m, 0)), 6) + 0.0 AS weight FROM v JOIN margins USING (graph_id, vid)",
)
query(
    "annotate_regression",
    lambda spark, sf: rounded(annotate.annotate(*C.name_graphs(spark, sf), BASE, annotate.Linear(((F.col("feature") % 7) - 3) / F.lit(10.0), -0.05, regression=True)), "importance", "weight"),
    _LINEAR.replace("+ 0.05", "- 0.05") + "SELECT v.graph_id, v.vid, v.label, CASE WHEN round(m, 9) >= 0 THEN 1 ELSE -1 END AS class, round(m, 6) + 0.0 AS importance, round(abs(m), 6) + 0.0 AS weight FROM v JOIN margins USING (graph_id, vid)",
)
_INTERCEPTS = (0.05, -0.1, 0.2)
_SCORES = ", ".join(f"round(sum(value * ((feature * {k + 1}) % 7 - 3) / 10.0::DOUBLE) + {b}, 9) AS s{k}" for k, b in enumerate(_INTERCEPTS))


def _multiclass(spark, sf):
    weights = F.array(*[((F.col("feature") * (k + 1)) % 7 - 3) / F.lit(10.0) for k in range(len(_INTERCEPTS))])
    return rounded(annotate.annotate(*C.name_graphs(spark, sf), BASE, annotate.Multiclass(weights, _INTERCEPTS)), "importance", "weight")


query(
    "annotate_multiclass", _multiclass,
    graph_ctes(C.NAMES_SQL, BASE, by_vertex=True) + f", scores AS (SELECT graph_id, vid, {_SCORES} FROM result GROUP BY ALL), decided AS (SELECT *, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS class FROM scores), "
    f"sized AS (SELECT *, list_value(0.05::DOUBLE, -0.1::DOUBLE, 0.2::DOUBLE)[class + 1] AS b, count(*) OVER (PARTITION BY graph_id) + (SELECT count(*) FROM ({C.NAMES_SQL[1]}) k WHERE k.graph_id = decided.graph_id) AS n FROM decided) "
    "SELECT v.graph_id, v.vid, v.label, CAST(class AS INTEGER) AS class, round(greatest(s0, s1, s2) - b + b / n, 6) + 0.0 AS importance, round(abs(greatest(s0, s1, s2) - b + b / n), 6) + 0.0 AS weight FROM v JOIN sized USING (graph_id, vid)",
)
