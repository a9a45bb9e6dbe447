"""Importance of vertices and positions under a linear model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.functions.lineage import many, spread
from vicinage.operators.graph_vectorizer import vertex_vectorize
from vicinage.operators.neighborhoods import simple_edges
from vicinage.operators.options import GraphOptions, SequenceOptions
from vicinage.operators.sequence_vectorizer import position_vectorize


@dataclass(frozen=True)
class Linear:
    """A linear model: a weight as an expression of ``feature``, or a DataFrame (feature, weight), and an intercept."""

    weight: Column | DataFrame
    intercept: float = 0.0
    regression: bool = False

    def margins(self, features: DataFrame, *keys: str) -> DataFrame:
        """keys, margin: one sparse dot product an instance."""
        if isinstance(self.weight, DataFrame):
            rows = features.join(self.weight.select("feature", "weight"), "feature", "left").withColumn("_w", F.coalesce("weight", F.lit(0.0)))
        else:
            rows = features.withColumn("_w", self.weight)
        return rows.groupBy(*keys).agg((F.sum(F.col("value") * F.col("_w")) + self.intercept).alias("margin"))

    def sign(self, margin: Column) -> Column:
        """1 or -1; margins are summed in no fixed order, so nine places of them count."""
        margin = F.round(margin, 9)
        return F.when(margin >= 0 if self.regression else margin > 0, 1).otherwise(-1)


@dataclass(frozen=True)
class Multiclass:
    """Linear scores of several classes: an array of weights, one a class, as an expression of ``feature`` or a DataFrame (feature, weights)."""

    weights: Column | DataFrame
    intercepts: tuple[float, ...]

    def best(self, features: DataFrame, *keys: str) -> DataFrame:
        """keys, scores: the score of each class, to nine places."""
        if isinstance(self.weights, DataFrame):
            rows = features.join(self.weights.select("feature", F.col("weights").alias("_w")), "feature", "left")
        else:
            rows = features.withColumn("_w", self.weights)
        dot = lambda k: F.sum(F.col("value") * F.coalesce(F.col("_w")[k], F.lit(0.0)))
        return rows.groupBy(*keys).agg(F.array(*[F.round(dot(k) + b, 9) for k, b in enumerate(self.intercepts)]).alias("scores"))

    def decided(self, scored: DataFrame) -> DataFrame:
        """``scored`` (scores, n) with class, that of the largest score (the first of equal ones), and margin.

        The margin is the score in which the intercept counts one n-th, n being the number of the graph's vertices and edges.
        """
        intercepts = F.array(*map(F.lit, self.intercepts))
        scored = scored.withColumn("scores", F.coalesce("scores", intercepts))
        scored = scored.withColumn("class", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
        own = F.get(intercepts, F.col("class"))
        return scored.withColumn("margin", F.array_max("scores") - own + own / F.col("n"))


def annotate(vertices: DataFrame, edges: DataFrame, options: GraphOptions, model: Linear | Multiclass | None = None, reweight: float = 1.0, threshold: float | None = None, scale: float = 1.0, vertex_features: bool = False) -> DataFrame:
    """graph_id, vid, label, class, importance, weight [, vector] of every vertex.

    Without a model, importance is one over the number of vertices and edges. weight mixes |importance| with the old
    weight by ``reweight``; with 0, or without an old weight, it is |importance|.
    """
    keys, vertices = ["graph_id", "vid"], many(vertices)
    features = vertex_vectorize(vertices, edges, options) if model or vertex_features else None
    n = vertices.select("graph_id").unionByName(simple_edges(edges).select("graph_id")).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    if model is None:
        scored = vertices.join(n, "graph_id").withColumn("margin", 1.0 / F.col("n")).withColumn("class", F.lit(1))
    elif isinstance(model, Multiclass):
        scored = model.decided(vertices.join(n, "graph_id").join(model.best(features, *keys), keys, "left"))
    else:
        scored = vertices.join(model.margins(features, *keys), keys, "left").withColumn("margin", F.coalesce("margin", F.lit(float(model.intercept))))
        scored = scored.withColumn("class", model.sign(F.col("margin")))
    importance = F.col("margin") if threshold is None else F.greatest(F.col("margin"), F.lit(threshold))
    scored = scored.withColumn("importance", importance)
    weight = F.abs("importance")
    if "weight" in vertices.columns and reweight != 0:
        weight = F.when(F.col("weight").isNotNull(), reweight * weight + (1 - reweight) * F.col("weight")).otherwise(weight)
    out = scored.select(*keys, "label", "class", "importance", (weight * scale).alias("weight"))
    if vertex_features:
        vectors = features.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("feature").cast("string"), "value"))).alias("vector"))  # of one vertex
        out = out.join(vectors, keys, "left")
    return out


def annotate_sequences(sequences: DataFrame, options: SequenceOptions, model: Linear | None = None, probability: bool = False) -> DataFrame:
    """id, pos, token, importance: 1 without a model, else the margin of the position's features or its logistic probability."""
    sequences = spread(sequences, "id")
    tokens = sequences.select("id", F.posexplode("tokens").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
    if model is None:
        return tokens.withColumn("importance", F.lit(1.0))
    margins = model.margins(position_vectorize(sequences, options), "id", "pos")
    margin = F.coalesce("margin", F.lit(float(model.intercept)))
    importance = 1 / (1 + F.exp(-margin)) if probability else margin
    return tokens.join(margins, ["id", "pos"], "left").select("id", "pos", "token", importance.alias("importance"))
