"""Statistics of classes, features, scores and degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinage.operators.neighborhoods import both_ways, simple_edges
from vicinage.operators.quantiles import quantiles


def class_stats(df: DataFrame, column: str) -> DataFrame:
    """class, n, fraction of the rows."""
    counts = df.groupBy(F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))


def describe_features(features: DataFrame, key: str = "graph_id") -> DataFrame:
    """One row: instances, distinct features, mean number of features an instance."""
    row = features.agg(F.countDistinct(key).alias("instances"), F.countDistinct("feature").alias("width"), F.count(F.lit(1)).alias("n"))
    return row.select("instances", "width", (F.col("n") / F.col("instances")).alias("mean_features"))


def score_percentiles(df: DataFrame, key: str, score: str) -> DataFrame:
    """key, p50, p25, p75, p10, p90 with linear interpolation; no task holds the scores of a key."""
    return quantiles(df, key, score, {"p50": 0.5, "p25": 0.25, "p75": 0.75, "p10": 0.1, "p90": 0.9})


def average_and_deviation(df: DataFrame, key: str, score: str) -> DataFrame:
    """key, average and population deviation."""
    return df.groupBy(key).agg(F.avg(score).alias("average"), F.stddev_pop(score).alias("deviation"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, vid, degree over all different neighbours; 0 for isolated vertices."""
    found = both_ways(simple_edges(edges)).groupBy("graph_id", F.col("a").alias("vid")).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select("graph_id", "vid").join(found, ["graph_id", "vid"], "left").select("graph_id", "vid", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, n_vertices, n_edges, n_non_edges, max_degree, median_degree."""
    rows = degrees(vertices, edges).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_vertices"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.max("degree").alias("max_degree"), F.percentile("degree", 0.5).alias("median_degree"))
    every = (F.col("n_vertices") * (F.col("n_vertices") - 1) / 2).cast("long")
    return rows.select("graph_id", "n_vertices", "n_edges", (every - F.col("n_edges")).alias("n_non_edges"), "max_degree", "median_degree")


def degree_histogram(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(vertices, edges).groupBy("graph_id", "degree").agg(F.count(F.lit(1)).alias("n"))


def label_ranks(vertices: DataFrame) -> DataFrame:
    """label, rank: place among the distinct labels over their number, as a colour scale takes it."""
    labels = vertices.select("label").distinct()
    place = F.row_number().over(Window.orderBy("label")) - 1
    return labels.select("label", (place / F.count(F.lit(1)).over(Window.partitionBy())).alias("rank"))
