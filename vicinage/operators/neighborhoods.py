"""Bounded breadth-first search and neighbourhood hashes as joins and grouped aggregation.

Radius and distance r and d count edges. Neighbourhood shells are doubled: vertices at 2h, and an edge whose nearer end
is at h at 2h + 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.functions.hashing import list_hash, text_hash
from vicinage.functions.lineage import cut, few, many, spread

KEYS = ["graph_id", "root"]
#: Steps from a vertex, about, that one task follows; those of a vertex with more are dealt to parts.
STEPS = 64


def with_columns(df: DataFrame, **defaults: str) -> DataFrame:
    """Add the named columns, as nulls of the given type, where they are missing."""
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in defaults.items() if name not in df.columns})


def simple_edges(edges: DataFrame) -> DataFrame:
    """One row an unordered pair of different vertices: graph_id, u < v, label, weight, nesting."""
    edges = with_columns(edges, weight="double", nesting="boolean").filter("src <> dst")
    kept = F.min(F.struct(F.coalesce("nesting", F.lit(False)).alias("nesting"), "label", "weight")).alias("e")
    return many(edges.groupBy("graph_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(kept).select("graph_id", "u", "v", "e.*"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: graph_id, a, b and the other columns."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("ends")
    return edges.select("graph_id", "u", "v", ends, *[c for c in edges.columns if c not in ("graph_id", "u", "v")]).select("graph_id", "u", "v", "ends.a", "ends.b", *[c for c in edges.columns if c not in ("graph_id", "u", "v")])


def _in_parts(rows: DataFrame, hubs: DataFrame, part: Column) -> DataFrame:
    return rows.join(hubs, ["graph_id", "vid"], "left").withColumn("part", part).drop("parts")


def distances(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """graph_id, root, vid, hops up to ``depth`` hops from the roots (graph_id, vid) over edges that don't nest.

    A new frontier can only meet the last two, so only these are taken out of it. Each level is cut off from the plan
    of those before it, and the search ends with the first empty one. The steps from a hub are in parts, to each of
    which the rows at the hub go, so no task follows all of them from all of these rows.
    """
    steps = both_ways(edges.filter(~F.col("nesting"))).select("graph_id", F.col("a").alias("vid"), F.col("b").alias("next"))
    hubs, place = None, ["graph_id", "vid", "part"]
    if not edges.isStreaming and not roots.isStreaming:
        hubs = cut(steps.groupBy("graph_id", "vid").agg(F.ceil(F.count(F.lit(1)) / STEPS).alias("parts")).filter("parts > 1"))
        hubs = None if hubs.isEmpty() else few(hubs, 100_000)
    if hubs is not None:
        steps = _in_parts(steps, hubs, F.pmod(F.xxhash64("next"), F.coalesce("parts", F.lit(1))))
        steps = spread(steps, *place)
    level = roots.select("graph_id", F.col("vid").alias("root"), "vid")
    levels, before = [level.withColumn("hops", F.lit(0))], None
    for hop in range(depth):
        seen = level if before is None else level.unionByName(before)
        if hubs is None:
            near = level.join(steps, ["graph_id", "vid"])
        else:
            at = _in_parts(level, hubs, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
            near = many(spread(at, *place)).join(steps, place)
        fresh = near.select(*KEYS, F.col("next").alias("vid")).distinct().join(seen, [*KEYS, "vid"], "left_anti")
        before, level = level, fresh
        if 0 < hop < depth - 1:
            level = cut(fresh)
            if level.isEmpty():
                break
        levels.append(level.withColumn("hops", F.lit(hop + 1)))
    return reduce(DataFrame.unionByName, levels)


def surroundings(vertices: DataFrame, edges: DataFrame, depth: int, radius: int, nbits: int, positional: bool = False) -> tuple[DataFrame, DataFrame]:
    """Breadth-first search from every vertex over edges that don't nest. Both ends of an edge must be vertices.

    Returns (graph_id, root, vid, hops) up to ``depth`` hops, and the items of the shells up to twice the radius:
    (graph_id, root, shell, h, weight) of the vertices and edges there. What an item needs comes with the step to it, so
    nothing is joined to the rows found. An item is a label with its vertex's degree (2 for an edge), or with its place
    before the root if positional.
    """
    label = text_hash(F.col("label")).bitwiseAND((1 << nbits) - 1) + 1
    marked = lambda mark: label if positional else text_hash(label, mark)
    degree = both_ways(edges).groupBy("graph_id", F.col("a").alias("vid")).agg(F.count(F.lit(1)).alias("degree"))
    own = vertices.join(degree, ["graph_id", "vid"], "left").select("graph_id", "vid", marked(F.coalesce("degree", F.lit(0))).alias("h"), "weight")
    passed = ["u", "v", "edge_h", "edge_weight", *(["eid"] if positional else [])]
    lines = edges.filter(~F.col("nesting")).select("graph_id", "u", "v", marked(F.lit(2)).alias("edge_h"), F.col("weight").alias("edge_weight"), *(["eid"] if positional else []))
    steps = both_ways(lines).withColumnsRenamed({"a": "vid", "b": "next"}).join(own.withColumnRenamed("vid", "next"), ["graph_id", "next"])
    level = own.select("graph_id", F.col("vid").alias("root"), "vid", "h", "weight")
    levels, met, before = [level.withColumn("hops", F.lit(0))], [], None
    for hop in range(depth):
        near = steps.withColumn("root", F.col("vid")) if hop == 0 else level.select(*KEYS, "vid").join(steps, ["graph_id", "vid"])
        if hop < radius:
            met.append(near.select(*KEYS, *passed, F.lit(2 * hop + 1).alias("shell")))
        fresh = near.select(*KEYS, F.col("next").alias("vid"), "h", "weight")
        if hop > 0:
            seen = level.unionByName(before).select(*KEYS, "vid")
            fresh = fresh.distinct().join(seen, [*KEYS, "vid"], "left_anti")
        before, level = level, cut(fresh) if 0 < hop < depth - 1 else fresh
        levels.append(level.withColumn("hops", F.lit(hop + 1)))
    found = reduce(DataFrame.unionByName, levels)
    node = text_hash(F.col("h"), F.col("root") - F.col("vid")) if positional else F.col("h")
    items = found.filter(F.col("hops") <= radius).select(*KEYS, (2 * F.col("hops")).alias("shell"), node.alias("h"), "weight")
    if met:
        edge = text_hash(F.col("edge_h"), F.col("root") - F.col("eid")) if positional else F.col("edge_h")
        between = reduce(DataFrame.unionByName, met)
        if len(met) > 1:  # an edge is met again from its farther end
            between = between.groupBy(*KEYS, *passed).agg(F.min("shell").alias("shell"))
        items = items.unionByName(between.select(*KEYS, "shell", edge.alias("h"), F.col("edge_weight").alias("weight")))
    return found.select(*KEYS, "vid", "hops"), items


def weighted_graphs(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id of the graphs in which a vertex or an edge has a weight other than null and 0."""
    has = F.coalesce("weight", F.lit(0.0)) != 0
    return vertices.filter(has).select("graph_id").union(edges.filter(has).select("graph_id")).distinct()


def neighborhoods(items: DataFrame, radius: int, weights: bool = False) -> DataFrame:
    """graph_id, root and arrays over radius 0..r: ``hashes`` and, with ``weights``, ``sizes``; null where the search ends before.

    A shell's hash is that of its items' sorted hashes, a neighbourhood's that of the shells up to twice the radius.
    """
    item = F.struct("shell", "h", *(["weight"] if weights else []))
    roots = items.groupBy(*KEYS).agg(F.sort_array(F.collect_list(item)).alias("items"))  # of one neighbourhood
    shell = lambda k: list_hash(F.transform(F.filter("items", lambda i: i["shell"] == k), lambda i: i["h"]))
    roots = roots.withColumns({"last": F.element_at("items", -1)["shell"], "shells": F.array(*map(shell, range(2 * radius + 1)))})
    reached = lambda k, value: F.when(F.col("last") >= 2 * k, value)
    hashes = F.array(*[reached(k, list_hash(F.slice("shells", 1, 2 * k + 1))) for k in range(radius + 1)])
    if not weights:
        return roots.select(*KEYS, hashes.alias("hashes"))
    part = lambda k, odd: F.transform(F.filter("items", lambda i: (i["shell"] <= 2 * k) & (i["shell"] % 2 == odd)), lambda i: i["weight"])
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0)))
    logs = lambda values: total(F.transform(values, lambda x: F.when(x > 0, F.ln(x))))
    root_weight = F.col("items")[0]["weight"]
    size = lambda nodes, edges: (root_weight + total(nodes)) / (1 + F.size(nodes)) * F.when(F.array_min(edges) == 0, 0.0).otherwise(F.exp(logs(edges) / (1 + F.size(edges))))
    sizes = F.array(*[reached(k, size(part(k, 0), part(k, 1))) for k in range(radius + 1)])
    return roots.select(*KEYS, hashes.alias("hashes"), sizes.alias("sizes"))
