"""Pairs of sets in a crowd around a hub, told apart by what differs from the hub.

Sets that are alike share most of their items, and so do those of a crowd that are not alike enough: joining them on
common items makes all pairs. What each set has otherwise than the hub is small and mostly its own. The difference of
two sets is that of their differences from the hub, so sets x and y, d(x) and d(y) items from the hub, that differ in
``most`` items at most have (d(x) + d(y) - most) / 2 of these in common or more. Each set keeps its rarest ones only, as
many as it takes for one common item to be among them; how many depends on both distances, so these are cut into bands
and joined band by band.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinage.llm.common import cut, few

#: Bands of distances, about, in a hub's size.
BANDS = 8


def members_of(rooted: DataFrame, component: DataFrame) -> DataFrame:
    """hub, rep, root of rows (hub, rep, root): each hub is replaced by the root of its component (node, root).

    Lists of one family have several hubs, which are mostly linked; so a member is compared with few of them.
    """
    of_hub = component.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    return rooted.select("hub", "rep", "root").distinct().join(of_hub, "hub", "left").select(F.coalesce("hub_root", "hub").alias("hub"), "rep", "root").distinct()


def around_hubs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of members (hub, rep, root; a hub is its own root) of one hub and different roots that can be linked, without loss.

    sets: id, shingles (distinct; an id can have several). Two sets are linked if 100 * intersection >= percent * union. At least one of each
    pair must not be linked with the hub; hubs are paired with their own members, too.
    """
    one, two = sets.select(F.col("id").alias("rep"), F.col("shingles").alias("own")), sets.select(F.col("id").alias("hub"), F.col("shingles").alias("base"))
    both = members.join(two, "hub").join(one, "rep").filter(F.col("rep") != F.col("hub"))
    items = F.concat(F.array_except("own", "base"), F.array_except("base", "own"))
    rows = both.select("hub", "rep", "root", F.xxhash64("own").alias("text"), F.size("own").alias("size"), F.greatest(F.lit(1), F.floor(F.size("base") / BANDS)).alias("width"), items.alias("items"))
    rows = cut(rows.withColumn("far", F.size("items")))
    largest = rows.groupBy("hub").agg(F.max("size").alias("largest"))
    most = F.floor((F.col("size") + F.least("largest", F.floor(F.col("size") * 100 / percent))) * (100 - percent) / (100 + percent))
    rows = rows.join(few(cut(largest)), "hub").withColumn("most", most)
    tokens = rows.select("hub", "rep", "text", "root", "size", "width", "far", "most", F.explode("items").alias("item"))
    held = tokens.groupBy("hub", "item").agg(F.count(F.lit(1)).alias("held"))
    order = Window.partitionBy("hub", "rep", "text").orderBy("held", "item")  # no more than two texts have shingles
    placed = tokens.join(held, ["hub", "item"]).withColumn("rest", F.col("far") - F.row_number().over(order) + 1).filter("held > 1")
    first = F.greatest(F.lit(0), F.floor((F.col("far") - F.col("most")) / F.col("width")))
    last = F.floor((F.least("far", 2 * F.col("rest") - F.col("far")) + F.col("most")) / F.col("width"))
    placed = placed.withColumns({"first": first, "last": last, "band": F.floor(F.col("far") / F.col("width"))}).filter("first <= last")
    placed = placed.withColumn("other", F.explode(F.sequence("first", "last")))
    key = F.xxhash64("hub", "item", F.least("band", "other"), F.greatest("band", "other"))
    placed = placed.select(key.alias("key"), "rep", "root", "size", "far", "rest", "band", (F.col("band") == F.col("other")).alias("alone"))
    met = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("key")
    placed = cut(placed.join(met, "key"))
    p, q = placed.alias("p"), placed.alias("q")
    fits = 100 * F.least("p.size", "q.size") >= percent * F.greatest("p.size", "q.size")
    needed = F.col("p.far") + F.col("q.far") - F.floor((F.col("p.size") + F.col("q.size")) * (100 - percent) / (100 + percent))
    opposite = F.col("p.alone") | (F.col("p.band") != F.col("q.band"))
    same = [F.col("p.key") == F.col("q.key"), F.col("p.rep") < F.col("q.rep"), F.col("p.root") != F.col("q.root")]
    pairs = p.join(q, [*same, opposite, fits, 2 * F.least("p.rest", "q.rest") >= needed]).select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"))
    hubs = members.filter(F.col("root") != F.col("hub")).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    return pairs.union(hubs).distinct()
