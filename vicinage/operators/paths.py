"""Shortest paths over weighted edges: all of a small graph in one task, those of a large one by delta-stepping.

Delta-stepping joins all searches with edges, bucket after bucket of distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.functions.lineage import cut, few, many, stored
from vicinage.operators.neighborhoods import both_ways

PLACE = ["graph_id", "root", "vid"]
#: Roots and edges, together, of a graph that is small.
SMALL = 256
#: Numbers, about, of the matrices that are worked on at a time.
CELLS = 1 << 18


def _length(edges: DataFrame, length: str | None) -> Column:
    long = F.lit(1.0) if length is None else F.coalesce(F.col(length).cast("double"), F.lit(1.0))
    return F.when((long >= 0) & (long < float("inf")), long).otherwise(F.raise_error(F.lit("the length of an edge is negative or not finite")))


def lengths_of(edges: DataFrame, length: str | None = None) -> DataFrame:
    """graph_id, u < v, length: the shortest of the edges between two different vertices; 1 where it is null or not named."""
    ends = edges.filter("src <> dst").select("graph_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), _length(edges, length).alias("length"))
    return ends.groupBy("graph_id", "u", "v").agg(F.min("length").alias("length"))


def _matrices(rows: pa.StructArray, of: np.ndarray) -> Iterator[tuple]:
    """Graphs of one size: their numbers, vertices, which of these are roots, and the lengths between neighbours."""
    a, root = rows.field("a").to_numpy(), rows.field("b").is_null().to_numpy(zero_copy_only=False)
    ends = rows.field("b").fill_null(0).to_numpy()
    graph, vid = np.concatenate([of, of[~root]]), np.concatenate([a, ends[~root]])
    order = np.lexsort((vid, graph))
    new = np.append(True, (np.diff(graph[order]) != 0) | (np.diff(vid[order]) != 0))
    node = np.empty(len(graph), np.int64)
    node[order] = np.cumsum(new) - 1
    vid, owner = vid[order][new], graph[order][new]
    first = np.searchsorted(owner, np.arange(of[-1] + 1))
    size = np.diff(np.append(first, len(owner)))
    is_root = np.zeros(len(vid), bool)
    is_root[node[: len(a)][root]] = True
    u, v, long = node[: len(a)][~root], node[len(a) :], rows.field("length").fill_null(0).to_numpy()[~root]
    for n in np.unique(size):
        every, step = np.flatnonzero(size == n), max(1, CELLS // int(n * n))
        for graphs in (every[k : k + step] for k in range(0, len(every), step)):
            place = np.full(len(size), -1)
            place[graphs] = np.arange(len(graphs))
            own = np.flatnonzero(place[owner[u]] >= 0)
            g, x, y = place[owner[u[own]]], u[own] - first[owner[u[own]]], v[own] - first[owner[u[own]]]
            near = np.full((len(graphs), n, n), np.inf)
            np.minimum.at(near, (g, x, y), long[own])
            np.minimum.at(near, (g, y, x), long[own])
            at = first[graphs][:, None] + np.arange(n)
            yield graphs, vid[at], is_root[at], near


def _searched(near: np.ndarray) -> np.ndarray:
    """Distances from every vertex: edges are followed from all vertices in turn until no distance falls."""
    found = np.full(near.shape, np.inf)
    found[:, np.arange(near.shape[1]), np.arange(near.shape[1])] = 0
    while True:
        before = found.copy()
        for k in range(near.shape[1]):
            np.minimum(found, found[:, :, k, None] + near[:, k, None, :], out=found)
        if np.array_equal(before, found):
            return found


def _of_small(rows: DataFrame, shares: bool) -> DataFrame:
    """The paths of graphs whose roots (a) and edges (a, b, length) are few; a graph's rows meet in one row."""
    graphs = rows.groupBy("graph_id").agg(F.collect_list(F.struct("a", "b", "length")).alias("rows"))  # SMALL at most
    kind = rows.schema["graph_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            lists = batch.column("rows")
            of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            for graphs, vid, is_root, near in _matrices(lists.flatten(), of):
                far = _searched(near)
                told = np.isfinite(far) & is_root[:, :, None]
                if shares:
                    most = np.where(told, far, 0).max((1, 2))[:, None, None]
                    far = np.divide(far, most, out=np.zeros_like(far), where=most > 0)
                g, root, to = np.nonzero(told)
                yield pa.RecordBatch.from_arrays([batch.column("graph_id").take(pa.array(graphs[g])), pa.array(vid[g, root]), pa.array(vid[g, to]), pa.array(far[g, root, to])], [*PLACE, "distance"])

    return graphs.mapInArrow(run, f"graph_id {kind}, root long, vid long, distance double")


def shortest_paths(vertices: DataFrame, edges: DataFrame, length: str | None = None, roots: DataFrame | None = None, delta: float | None = None, shares: bool = False) -> DataFrame:
    """graph_id, root, vid, distance from each root (graph_id, vid) to all vertices it reaches, itself at 0 included.

    edges (graph_id, src, dst) go both ways; ``length`` names the column of their lengths. roots: all vertices if None.
    Both ends of an edge are to be vertices. A negative, infinite or NaN length ends the query with an error. With
    ``shares`` distances are as normalized() makes them.

    Graphs of at most SMALL roots and edges are searched by matrices, many in one task; see stepped_paths() for others.
    """
    start = (vertices if roots is None else roots).select("graph_id", F.col("vid").cast("long").alias("a"))
    start = start.withColumns({"b": F.lit(None).cast("long"), "length": F.lit(None).cast("double")})
    ends = edges.filter("src <> dst").select("graph_id", F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), _length(edges, length).alias("length"))
    rows = many(stored(start.unionByName(ends)))
    large = cut(rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL).select("graph_id"))
    if large.isEmpty():
        return _of_small(rows, shares)
    large = few(large)
    found = _of_small(rows.join(large, "graph_id", "left_anti"), shares)
    own = rows.join(large, "graph_id", "left_semi")
    lines = own.filter("b is not null").select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"), "length")
    rest = stepped_paths(own.filter("b is null").select("graph_id", F.col("a").alias("vid")), lines, "length", delta)
    return found.unionByName(normalized(rest) if shares else rest)


def stepped_paths(roots: DataFrame, edges: DataFrame, length: str | None = None, delta: float | None = None) -> DataFrame:
    """The same from roots by delta-stepping.

    All searches go on together. Distances lie in buckets of width ``delta`` (None: the mean length). Edges of at most
    this length are followed from the nearest bucket until none of its distances falls any more, then the longer ones
    once. Rows of the buckets behind are final; they are put aside and only keep new rows from coming back.
    """
    steps = both_ways(lengths_of(edges, length)).select("graph_id", F.col("a").alias("vid"), F.col("b").alias("next"), "length")
    steps = cut(steps)
    mean = steps.agg(F.avg("length")).first()[0]  # one number
    width = delta or mean or 1.0
    live = roots.select("graph_id", F.col("vid").alias("root"), "vid").distinct()
    live = cut(live.withColumns({"distance": F.lit(0.0), "near_due": F.lit(True), "far_due": F.lit(True)}))
    done = None
    bucket = F.floor(F.col("distance") / width)
    while True:
        at = live.agg(F.min(F.when(F.col("near_due"), bucket)), F.min(F.when(F.col("far_due"), bucket))).first()
        if at[1] is None:  # what is due for near edges is so for far ones
            break
        k, near = at[1], at[0] is not None and at[0] == at[1]
        due, edge = ("near_due", F.col("length") <= width) if near else ("far_due", F.col("length") > width)
        now = (bucket == k) & F.col(due)
        found = live.filter(now).join(steps.filter(edge), ["graph_id", "vid"])
        found = found.groupBy("graph_id", "root", F.col("next").alias("vid")).agg(F.min(F.col("distance") + F.col("length")).alias("distance"))
        if done is not None:
            found = found.join(done.select(*PLACE), PLACE, "left_anti")
        # Of equal distances the row that is known comes first, since its marks are false.
        kept = live.withColumn(due, F.col(due) & ~now)
        rows = kept.unionByName(found.withColumns({"near_due": F.lit(True), "far_due": F.lit(True)}))
        best = F.min(F.struct("distance", "near_due", "far_due")).alias("best")
        rows = rows.groupBy(*PLACE).agg(best).select(*PLACE, "best.*")
        if near:
            live = stored(rows)
        else:
            rows = stored(rows)
            final = rows.filter(bucket <= k).select(*PLACE, "distance")
            done = final if done is None else done.unionByName(final)
            live = rows.filter(bucket > k)
    rest = live.select(*PLACE, "distance")
    return rest if done is None else done.unionByName(rest)


def normalized(paths: DataFrame) -> DataFrame:
    """``paths`` with distances as shares of the greatest one of their graph; 0 where that is 0."""
    most = paths.groupBy("graph_id").agg(F.max("distance").alias("_most"))
    return paths.join(most, "graph_id").withColumn("distance", F.when(F.col("_most") > 0, F.col("distance") / F.col("_most")).otherwise(0.0)).drop("_most")
