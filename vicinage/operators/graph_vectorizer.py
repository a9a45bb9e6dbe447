"""Explicit features of labelled, weighted and nested graphs: pairs of neighbourhoods by radius and distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions.hashing import feature_id, text_hash
from vicinage.functions.lineage import many, spread
from vicinage.operators.copies import shared
from vicinage.operators.neighborhoods import both_ways, neighborhoods, simple_edges, surroundings, weighted_graphs, with_columns
from vicinage.operators.options import GraphOptions

#: Vertices, about, of a graph whose lifted features one task makes.
BLOCK = 64


def _prepared(vertices: DataFrame, edges: DataFrame, options: GraphOptions) -> tuple[DataFrame, DataFrame, bool]:
    """Vertices and simple edges with their weights filled in; whether any weights are there."""
    weighted = "weight" in vertices.columns or "weight" in edges.columns
    vertices = with_columns(many(vertices), weight="double", vec="array<double>", svec="map<string,double>")
    edges = simple_edges(edges)
    if weighted:
        graphs = weighted_graphs(vertices, edges).withColumn("weighted", F.lit(True))
        fill = lambda df: df.join(graphs, "graph_id", "left").withColumn("weighted", F.coalesce("weighted", F.lit(False))).withColumn("weight", F.when(F.col("weighted"), F.coalesce("weight", F.lit(1.0))).otherwise(F.lit(1.0)))
        vertices, edges = many(fill(vertices)), many(fill(edges))
    else:
        vertices, edges = (df.withColumn("weighted", F.lit(False)) for df in (vertices, edges))
    if options.positional:
        # Edges are numbered behind the vertices, in the order of their ends.
        last = vertices.groupBy("graph_id").agg(F.max("vid").alias("last"))
        edges = edges.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy("u", "v"))).join(last, "graph_id").withColumn("eid", F.col("last") + F.col("rank"))
        edges = many(edges)
    return vertices, edges, weighted


def rooted_features(vertices: DataFrame, edges: DataFrame, options: GraphOptions) -> DataFrame:
    """graph_id, vid (the pair's first vertex), r, d, feature, value: counts or weights to be summed, not normalised."""
    r, d = options.radius, options.distance
    vertices, edges, weighted = _prepared(vertices, edges, options)
    found, items = surroundings(vertices, edges, max(r, d), r, options.nbits, options.positional)
    near = neighborhoods(items, r, weighted)
    span = found.filter(F.col("hops").between(options.min_d, d))
    pairs = span.select("graph_id", F.col("root").alias("v"), F.col("vid").alias("u"), F.col("hops").alias("d"), F.lit(1.0).alias("cw"))
    if "nesting" in edges.columns:
        nests = both_ways(edges.filter("nesting")).select("graph_id", F.col("a").alias("v"), F.col("b").alias("root"), F.col("weight").alias("cw"))
        pairs = pairs.unionByName(nests.join(span, ["graph_id", "root"]).select("graph_id", "v", F.col("vid").alias("u"), F.col("hops").alias("d"), "cw"))
    side = lambda x: near.select("graph_id", F.col("root").alias(x), F.col("hashes").alias(f"h{x}"), (F.col("sizes") if weighted else F.lit(None).cast("array<double>")).alias(f"w{x}"))
    pairs = pairs.join(side("v"), ["graph_id", "v"]).join(side("u"), ["graph_id", "u"])
    if weighted:
        pairs = pairs.join(vertices.select("graph_id", F.col("vid").alias("v"), "weighted"), ["graph_id", "v"])
    else:
        pairs = pairs.withColumn("weighted", F.lit(False))
    rows = pairs.withColumn("r", F.explode(F.sequence(F.lit(options.min_r), F.lit(r))))
    at = lambda c: F.get(F.col(c), F.col("r"))
    rows = rows.select("graph_id", F.col("v").alias("vid"), "r", "d", "cw", "weighted", at("hv").alias("a"), at("hu").alias("b"), at("wv").alias("wa"), at("wu").alias("wb")).filter("a is not null and b is not null")
    buckets = options.bucket_weights
    if buckets is not None:
        allowed = [F.lit(f"{i},{j}") for (i, j), w in buckets.items() if w]
        rows = rows.filter(F.concat_ws(",", F.col("r").cast("string"), F.col("d").cast("string")).isin(*allowed) if allowed else F.lit(False))
    full = F.col("cw") * F.when(F.col("weighted"), F.col("wa") + F.col("wb")).otherwise(1.0)
    half = F.col("cw") * F.when(F.col("weighted"), F.col("wb")).otherwise(1.0)
    twice_r, twice_d = 2 * F.col("r"), 2 * F.col("d")
    context = F.struct(feature_id(options.nbits, F.col("b"), twice_r, twice_d).alias("feature"), half.alias("value"))
    pair = F.struct(feature_id(options.nbits, F.least("a", "b"), F.greatest("a", "b"), twice_r, twice_d).alias("feature"), full.alias("value"))
    kinds = F.array(context) if options.use_only_context else F.array(pair, context)
    rows = rows.filter(full != 0).select("graph_id", "vid", "r", "d", F.explode(kinds).alias("f")).select("graph_id", "vid", "r", "d", "f.feature", "f.value")
    if options.discrete:
        return rows
    return _lifted(rows.groupBy("graph_id", "vid", "r", "d", "feature").agg(F.sum("value").alias("value")), vertices, options)


def _lifted(rows: DataFrame, vertices: DataFrame, options: GraphOptions) -> DataFrame:
    """Features times the real numbers of their first vertex: ``vec`` moves the id along, ``svec`` hashes its keys in.

    Without ``vec`` features stay, without ``svec`` they are added once more. Both are linear, so equal features are left
    to be summed. A vertex gives thousands of rows of a few: blocks of vertices are dealt before these are made, so that
    each task makes its share, and sums what the vertices of a block have in common before it is shuffled.
    """
    mask = (1 << options.nbits) - 1
    entry = lambda key, x: F.struct(key.cast("string").alias("key"), x.cast("double").alias("value"))
    again = F.when(F.size("svec") > 0, F.concat(F.array(entry(F.lit(None), F.lit(1.0))), F.map_entries(F.col("svec").cast("map<string,double>")))).otherwise(F.array(entry(F.lit(None), F.lit(2.0))))
    found = rows.join(vertices.select("graph_id", "vid", "vec", "svec"), ["graph_id", "vid"], "left")
    found = spread(found.withColumn("_block", F.floor(F.col("vid") / BLOCK)), "graph_id", "_block").withColumn("again", again)
    passed = ["graph_id", "vid", "r", "d"]
    dense = found.select(*passed, "feature", "value", "again", F.posexplode_outer("vec").alias("i", "x"))
    at = F.when(F.col("i").isNull(), F.col("feature")).otherwise(F.pmod(F.col("feature") + F.col("i"), F.lit(mask))).cast("long")
    dense = dense.select(*passed, at.alias("feature"), F.when(F.col("i").isNull(), F.col("value")).otherwise(F.col("value") * F.col("x")).alias("value"), F.explode("again").alias("e"))
    keyed = F.when(F.col("e.key").isNull(), F.col("feature")).otherwise(text_hash(F.col("feature"), F.col("e.key")).bitwiseAND(mask) + 1)
    return dense.select(*passed, keyed.alias("feature"), (F.col("value") * F.col("e.value")).alias("value"))


def normalized(rows: DataFrame, keys: list[str], options: GraphOptions) -> DataFrame:
    """keys, feature, value after the norm of each (r, d) and the norm of each instance; 0 where a norm is 0.

    Sums are shuffled by feature, so an instance of most of the rows is spread; its different features, at most
    2 ** nbits for each (r, d), then meet by instance for all that follows.
    """
    ratio = lambda value, norm: F.when(norm > 0, value / norm).otherwise(0.0)
    rows = rows.groupBy(*keys, "r", "d", "feature").agg(F.sum("value").alias("value"))
    if options.inner_normalization or options.normalization:
        rows = rows.repartition(*keys)
    if options.inner_normalization:
        rows = rows.withColumn("value", ratio(F.col("value"), F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(*keys, "r", "d")))))
        buckets = options.bucket_weights
        if buckets and type(options) is GraphOptions:
            scale = F.create_map(*[x for (i, j), w in buckets.items() for x in (F.lit(f"{i},{j}"), F.lit(float(w) ** 0.5))])
            rows = rows.withColumn("value", F.col("value") * scale[F.concat_ws(",", F.col("r").cast("string"), F.col("d").cast("string"))])
    rows = rows.groupBy(*keys, "feature").agg(F.sum("value").alias("value"))
    if options.normalization:
        rows = rows.withColumn("value", ratio(F.col("value"), F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(*keys)))))
    return rows


def vectorize(vertices: DataFrame, edges: DataFrame, options: GraphOptions = GraphOptions()) -> DataFrame:
    """graph_id, feature, value: one sparse vector a graph. Graphs without vertices have no rows."""
    return shared("graph_id", (vertices, edges), lambda v, e: normalized(rooted_features(v, e, options), ["graph_id"], options))


def vertex_vectorize(vertices: DataFrame, edges: DataFrame, options: GraphOptions = GraphOptions()) -> DataFrame:
    """graph_id, vid, feature, value: one sparse vector a vertex, normalised by itself."""
    return shared("graph_id", (vertices, edges), lambda v, e: normalized(rooted_features(v, e, options), ["graph_id", "vid"], options))


def without_empty(graphs: DataFrame, vertices: DataFrame) -> DataFrame:
    """``graphs`` (graph_id, ...); the job fails where one of them has no vertex."""
    full = vertices.select("graph_id").distinct().withColumn("_full", F.lit(True))
    wrong = F.raise_error(F.concat(F.lit("graph without vertices: "), F.col("graph_id").cast("string")))
    return graphs.join(full, "graph_id", "left").filter(F.when(F.col("_full"), True).otherwise(wrong.cast("boolean"))).drop("_full")
