"""Queries of trained models. SQL can't fit them, so their rows are tested by invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.functions.lineage import cut, many
from vicinage.operators import graph_vectorizer, learning, metrics, sequence_vectorizer, training
from vicinage.operators.options import GraphOptions, SequenceOptions
from vicinage.plans.registry import query, rounded
from vicinage.sources import corpora as C

BITS = 14
NAMES = GraphOptions(r=1, d=1, nbits=BITS)


def _vectors(s: SparkSession, sf: str) -> DataFrame:
    """Vectors of the part names; label 1 for names before m."""
    features = graph_vectorizer.vectorize(*C.name_graphs(s, sf), NAMES)
    labels = C.table(s, sf, "part").select(F.col("p_partkey").alias("graph_id"), (F.col("p_name") < "m").cast("int").alias("label"), F.length("p_name").cast("double").alias("length"))
    return learning.as_vectors(features, ["graph_id"], BITS).join(many(labels), "graph_id")


def _examples(s: SparkSession, sf: str) -> DataFrame:
    """The same as rows of features and values."""
    labels = C.table(s, sf, "part").select(F.col("p_partkey").alias("graph_id"), (F.col("p_name") < "m").cast("int").alias("label"))
    return cut(training.examples(graph_vectorizer.vectorize(*C.name_graphs(s, sf), NAMES), labels, "graph_id"))


def _decided(rows: DataFrame, key: str, train: str = "true") -> DataFrame:
    """Margins of all examples under a model of those that the condition takes."""
    models = training.fitted(rows.filter(train), key, BITS)
    return training.margins(training.masked(rows, [F.lit(True)]), models, key)


def _predicted(s: SparkSession, sf: str) -> DataFrame:
    return _decided(_examples(s, sf), "graph_id").select("graph_id", "label", F.round("margin", 4).alias("margin"), (F.col("margin") > 0).cast("int").alias("prediction"))


def _regressed(s: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(s, sf).cache()
    return learning.regress(vectors, "length").transform(vectors).select("graph_id", "length", F.round("prediction", 4).alias("prediction"))


query("fit_predict", _predicted)
query("regress", _regressed)
query("cross_val_auc", lambda s, sf: rounded(training.cross_validated_auc(_examples(s, sf), "graph_id", BITS), "auc", "average_precision"))
query("learning_curve", lambda s, sf: rounded(training.learning_curve(_examples(s, sf), "graph_id", BITS), "train_auc", "test_auc"))
query("bias_variance", lambda s, sf: rounded(training.bias_variance(_examples(s, sf), "graph_id", BITS), "mean", "std"))
query("predictive_performance", lambda s, sf: rounded(training.predictive_performance(_examples(s, sf), "graph_id", BITS), "average_precision"))
query("model_search", lambda s, sf: rounded(training.search(_examples(s, sf), "graph_id", BITS)[3], "mean", "deviation"))
query("cluster", lambda s, sf: learning.cluster(graph_vectorizer.vectorize(*C.name_graphs(s, sf), NAMES), ["graph_id"], 8).select("graph_id", "cluster"))


def _relabelled(s: SparkSession, sf: str) -> DataFrame:
    vertices, edges = C.vector_graphs(s, sf)
    return learning.auto_label(graph_vectorizer.vertex_vectorize(vertices, edges, NAMES), 4)


query("auto_label", _relabelled)
query("vector_relabel", lambda s, sf: (lambda rows: rows.select("graph_id", "vid", "label", F.transform("vec", lambda x: F.round(x, 6)).alias("vec")))(learning.vector_relabel(C.vector_graphs(s, sf)[0], 4)))


def _sequence_predictions(s: SparkSession, sf: str) -> DataFrame:
    features = sequence_vectorizer.vectorize(C.names(s, sf), SequenceOptions(r=1, d=1, nbits=BITS))
    labels = C.table(s, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_name") < "m").cast("int").alias("label"))
    return _decided(cut(training.examples(features, labels, "id")), "id").select("id", "label", F.round("margin", 4).alias("margin"))


query("sequence_predict", _sequence_predictions)


def _reports(s: SparkSession, sf: str) -> DataFrame:
    """A model of the even ids on the odd ones."""
    scored = _decided(_examples(s, sf), "graph_id", "graph_id % 2 = 0").filter("graph_id % 2 = 1")
    return metrics.class_report(scored.withColumn("prediction", (F.col("margin") > 0).cast("int")), "label", "prediction")


def _selection(s: SparkSession, sf: str) -> DataFrame:
    labels = C.table(s, sf, "part").select(F.col("p_partkey").alias("graph_id"), (F.col("p_name") < "m").cast("int").alias("label"))
    return learning.model_selection(*C.name_graphs(s, sf), labels, NAMES, n_iter=3, radii=(1,), distances=(0, 1), count=2)[1]


query("estimate_model", _reports)
query("model_selection", _selection)
query("auto_relabel", lambda s, sf: learning.auto_relabel(*C.name_graphs(s, sf), NAMES, 4))
