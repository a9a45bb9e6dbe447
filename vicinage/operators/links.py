"""Degree filters, shortest paths and data sets for link prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.functions.lineage import cut, few, many, spread
from vicinage.operators.neighborhoods import both_ways, distances, simple_edges
from vicinage.operators.sampling import drawn, placed
from vicinage.operators.statistics import degrees


def induced(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges both of whose ends are among the vertices."""
    ids = vertices.select("graph_id", "vid")
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("vid", end), ["graph_id", end], "left_semi")
    return edges


def degree_filter(vertices: DataFrame, edges: DataFrame, threshold: int, at_least: bool = True) -> tuple[DataFrame, DataFrame]:
    """The subgraph of the vertices of a degree of at least the threshold, or of one below it."""
    found = degrees(vertices, edges).filter(F.col("degree") >= threshold if at_least else F.col("degree") < threshold)
    kept = vertices.join(found.select("graph_id", "vid"), ["graph_id", "vid"], "left_semi")
    return kept, induced(kept, edges)


#: Neighbours, at most, of vertices that are looked at for equal ones, and vertices, about, of a part of a kind.
NEAR, PART = 8, 1024


def _kinds(vertices: DataFrame, lines: DataFrame) -> DataFrame:
    """graph_id, vid, real, first: the smallest vertex that has the same neighbours; itself for those of none, or more than NEAR.

    An end of an edge that is no vertex is not real.
    """
    steps = both_ways(lines).select("graph_id", F.col("a").alias("vid"), F.col("b").alias("next"))
    low = steps.groupBy("graph_id", "vid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= NEAR).select("graph_id", "vid")
    near = cut(steps.join(many(low), ["graph_id", "vid"], "left_semi").groupBy("graph_id", "vid").agg(F.sort_array(F.collect_list("next")).alias("near")))  # NEAR at most
    first = near.join(many(near.groupBy("graph_id", "near").agg(F.min("vid").alias("first"))), ["graph_id", "near"]).select("graph_id", "vid", "first")
    every = vertices.select("graph_id", "vid", F.lit(True).alias("real")).unionByName(steps.select("graph_id", "vid", F.lit(False).alias("real"))).groupBy("graph_id", "vid").agg(F.max("real").alias("real"))
    return cut(every.join(many(first), ["graph_id", "vid"], "left").select("graph_id", "vid", "real", F.coalesce("first", "vid").alias("first")))


def path_lengths(vertices: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """graph_id, root, vid, hops of all pairs up to ``depth`` hops apart.

    Vertices of the same neighbours have the same hops to all others, and 2 to each other. Where half of all or more
    are such copies, only the first of each kind is searched from and met, and each two parts of kinds within reach are
    unfolded in one task, so that no pair of copies is shuffled.
    """
    lines = simple_edges(edges).withColumn("nesting", F.lit(False))
    kinds = _kinds(vertices, lines)
    if 2 * kinds.filter("vid = first").count() > kinds.count():
        return distances(vertices, lines, depth)
    own = kinds.filter("vid = first").select("graph_id", "vid")
    for end in "uv":
        lines = lines.join(many(own.withColumnRenamed("vid", end)), ["graph_id", end], "left_semi")
    found = cut(distances(own, lines, depth).select("graph_id", "root", "vid", "hops"))
    sizes = kinds.groupBy("graph_id", "first").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    parts = kinds.join(many(sizes), ["graph_id", "first"]).groupBy("graph_id", "first", F.pmod(F.xxhash64("vid"), F.col("parts")).alias("part")).agg(F.collect_list("vid").alias("vids"), F.collect_list(F.when(F.col("real"), F.col("vid"))).alias("roots"))  # of one part
    parts = cut(parts)
    side = lambda x: many(parts.select("graph_id", F.col("first").alias(x), F.col("part").alias(f"{x}_part"), f"{x}s"))
    met = found.join(side("root"), ["graph_id", "root"]).join(side("vid"), ["graph_id", "vid"])
    met = spread(met, "graph_id", "root", "vid", "root_part", "vid_part")
    pairs = met.select("graph_id", "hops", "vids", F.explode("roots").alias("root")).select("graph_id", "hops", "root", F.explode("vids").alias("vid"))
    hops = F.when((F.col("hops") == 0) & (F.col("root") != F.col("vid")), 2).otherwise(F.col("hops"))
    return pairs.select("graph_id", "root", "vid", hops.alias("hops")).filter(F.col("hops") <= depth)


def non_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, u < v of the pairs without an edge; their number is the square of a graph's vertices by definition.

    Vertices are dealt to blocks, and each two blocks meet apart. A vertex brings its neighbours in the other block
    along, so no pair is shuffled.
    """
    blocks = few(cut(vertices.groupBy("graph_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))))
    block = lambda v: F.pmod(F.xxhash64(v), F.col("blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    own = many(vertices.select("graph_id", "vid")).join(blocks, "graph_id")
    near = simple_edges(edges).join(blocks, "graph_id").groupBy("graph_id", "u", block("v").alias("to")).agg(F.collect_list("v").alias("near"))  # of one block
    a = own.select("graph_id", F.col("vid").alias("u"), block("vid").alias("from"), every.alias("to")).join(near, ["graph_id", "u", "to"], "left")
    b = own.select("graph_id", F.col("vid").alias("v"), every.alias("from"), block("vid").alias("to"))
    return a.join(many(b), ["graph_id", "from", "to"]).filter("u < v and (near is null or not array_contains(near, v))").select("graph_id", "u", "v")


#: Vertices of a block, about.
BLOCK = 4096

#: Primes; the first one that doesn't divide a graph's number of pairs steps through all of them.
STEPS = (1_000_000_007, 998_244_353, 2_147_483_647, 1_000_000_009)


def _numbered(vertices: DataFrame, edges: DataFrame, ratio: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """graph_id, vid, rank (0, 1, ...) of vertices by a hash, and graph_id, n, n_pairs, wanted, step, shift of graphs with edges.

    wanted: how many non-edges the graph is to give, ratio times its edges or all that there are.
    """
    ranks = placed(vertices.select("graph_id", "vid").distinct(), drawn(f"{seed}v", "graph_id", "vid"), ["vid"], "graph_id").select("graph_id", "vid", (F.col("place") - 1).alias("rank"), F.col("total").alias("n"))
    m = simple_edges(edges).groupBy("graph_id").agg(F.count(F.lit(1)).alias("m"))
    graphs = ranks.groupBy("graph_id").agg(F.max("n").alias("n")).join(m, "graph_id").withColumn("n_pairs", F.floor(F.col("n") * (F.col("n") - 1) / 2))
    step = F.coalesce(*[F.when(F.col("n_pairs") % p != 0, F.lit(p)) for p in STEPS]).cast("decimal(38,0)")
    wanted = F.least(F.col("m") * ratio, F.col("n_pairs") - F.col("m"))
    return ranks.drop("n"), graphs.select("graph_id", "n", "n_pairs", "m", wanted.alias("wanted"), step.alias("step"), (drawn(f"{seed}p", "graph_id") % F.col("n_pairs")).alias("shift"))


def sampled_non_edges(vertices: DataFrame, edges: DataFrame, ratio: int = 10, seed: int = 1) -> DataFrame:
    """graph_id, u < v: ratio times as many pairs without an edge as there are edges, or all there are.

    All pairs of a graph's n vertices have numbers: number p joins the vertices of rank p % n and that plus p // n + 1,
    modulo n. The k-th draw is number (step * k + shift) % n_pairs, so no pair comes twice and each one comes. As many
    draws as are wanted and as could be edges meet the edges in an anti join; the first ones that are left are taken,
    and the pairs that are never drawn are never made.
    """
    ranks, graphs = _numbered(vertices, edges, ratio, seed)
    draws = F.least(F.col("wanted") + F.col("m"), F.col("n_pairs"))
    rows = graphs.filter("wanted > 0").select("graph_id", "n", "n_pairs", "wanted", "step", "shift", draws.alias("draws"))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("draws") - 1) / DRAWS))))
    rows = rows.withColumn("k", F.explode(F.sequence(F.col("at") * DRAWS, F.least(F.col("draws"), (F.col("at") + 1) * DRAWS) - 1)))
    number = ((F.col("step") * F.col("k").cast("decimal(19,0)") + F.col("shift")) % F.col("n_pairs")).cast("long")
    one, away = F.col("number") % F.col("n"), F.floor(F.col("number") / F.col("n")) + 1
    drawn_ = rows.withColumn("number", number).select("graph_id", "wanted", "k", one.alias("x"), ((one + away) % F.col("n")).alias("y"))
    for x in "xy":
        drawn_ = drawn_.join(ranks.select("graph_id", F.col("rank").alias(x), F.col("vid").alias(f"vid_{x}")), ["graph_id", x])
    pairs = drawn_.select("graph_id", "wanted", "k", F.least("vid_x", "vid_y").alias("u"), F.greatest("vid_x", "vid_y").alias("v"))
    left = pairs.join(simple_edges(edges).select("graph_id", "u", "v"), ["graph_id", "u", "v"], "left_anti")
    return placed(left, F.col("k"), ["k"], "graph_id").filter("place <= wanted").select("graph_id", "u", "v")


#: Draws that one row is unfolded to at a time.
DRAWS = 65_536


def link_split(vertices: DataFrame, edges: DataFrame, test_proportion: float = 0.3, ratio: int = 10, seed: int = 1) -> DataFrame:
    """graph_id, u, v, y, is_test: edges (1) and at most ratio times as many non-edges (0), drawn without repeats, split each class."""
    positive = simple_edges(edges).select("graph_id", "u", "v", F.lit(1).alias("y"))
    negative = sampled_non_edges(vertices, edges, ratio, seed).withColumn("y", F.lit(0))
    rows = placed(positive.unionByName(negative), drawn(f"{seed}s", "graph_id", "u", "v"), ["u", "v"], "graph_id", "y")
    return rows.select("graph_id", "u", "v", "y", (F.col("place") <= F.floor(F.col("total") * test_proportion)).alias("is_test"))


def neighborhood_pairs(vertices: DataFrame, edges: DataFrame, pairs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """The graph around each pair (pair_id, graph_id, u, v): what is within the radius of either end, without their edge.

    graph_id of the result is the pair's id. A vertex ``#`` is joined to both ends by edges ``#``; its id is one over
    the graph's largest.
    """
    hops = path_lengths(vertices, edges, radius).select("graph_id", "root", "vid")
    ends = pairs.select("pair_id", "graph_id", F.explode(F.array("u", "v")).alias("root"))
    inside = ends.join(hops, ["graph_id", "root"]).select("pair_id", "graph_id", "vid").distinct()
    own = inside.join(vertices, ["graph_id", "vid"]).select(F.col("pair_id").alias("graph_id"), "vid", "label")
    lines = simple_edges(edges).select("graph_id", "u", "v", "label")
    kept = lines.join(inside.select("pair_id", "graph_id", F.col("vid").alias("u")), ["graph_id", "u"]).join(inside.select("pair_id", "graph_id", F.col("vid").alias("v")), ["pair_id", "graph_id", "v"])
    kept = kept.join(pairs.select("pair_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["pair_id", "u", "v"], "left_anti")
    hub = pairs.join(vertices.groupBy("graph_id").agg((F.max("vid") + 1).alias("hub")), "graph_id")
    added = hub.select("pair_id", F.explode(F.array("u", "v")).alias("u"), F.col("hub").alias("v"), F.lit("#").alias("label")).distinct()
    new_edges = kept.select("pair_id", "u", "v", "label").unionByName(added).select(F.col("pair_id").alias("graph_id"), F.col("u").alias("src"), F.col("v").alias("dst"), "label")
    return own.unionByName(hub.select(F.col("pair_id").alias("graph_id"), F.col("hub").alias("vid"), F.lit("#").alias("label"))), new_edges


def prediction_overlay(edges: DataFrame, predicted: DataFrame) -> DataFrame:
    """u, v, color: found edges, missed ones and false ones. Both sides have u, v."""
    truth, said = edges.select("u", "v").distinct().withColumn("t", F.lit(True)), predicted.select("u", "v").distinct().withColumn("p", F.lit(True))
    color = F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), "limegreen").when(F.col("t").isNotNull(), "crimson").otherwise("gray")
    return truth.join(said, ["u", "v"], "full").select("u", "v", color.alias("color"))
