"""Prefix trie of conversations with sums over subtrees by heavy-path decomposition.

Conversations that begin alike share computed prefixes. A node of the trie is a distinct sequence of first turns and is
named by its depth and its smallest member, since two nodes of one depth have no member in common. Each node's largest
child, the one of most members, carries on its path; all other children begin paths of their own. A child that isn't
the largest has at most half of its parent's members, so a path to the root passes few paths however deep it is. Paths
hand their totals to the paths above in as many rounds, and one suffix sum along all paths gives every subtree's sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinage.llm.common import cut, n_words, stored

#: Turns, or nodes of a path, that one window holds; what is longer has several, carried on over their sums.
SEGMENT = 1024
#: Numbers of conversations that one text of ends spans.
BLOCK = 8192
#: Conversations of one family begin with the same turns of its first one.
FAMILY = 20
NODE = ["conv_id", "depth"]
ENDS = "depth long, low long, high long, ends_sha256 string"


def _carried(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], total, falling: bool = False) -> DataFrame:
    """df with running totals (``total``: an aggregate) over ``order`` within the keys.

    The order's numbers are cut into segments; totals within a segment and those of the segments before it are apart,
    so that no window holds a whole key.
    """
    turned = F.desc if falling else F.asc
    df = df.withColumn("_segment", F.floor(F.col(order) / SEGMENT)).withColumns({f"_{k}": v for k, v in values.items()})
    before = Window.partitionBy(*keys).orderBy(turned("_segment")).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_segment").agg(*[total(f"_{k}").alias(f"_{k}") for k in values])
    sums = sums.select(*keys, "_segment", *[F.coalesce(total(f"_{k}").over(before), F.lit(0).cast("long")).alias(f"_{k}_before") for k in values])
    running = Window.partitionBy(*keys, "_segment").orderBy(turned(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({f"_{k}": total(f"_{k}").over(running) for k in values}).join(sums, [*keys, "_segment"]).drop("_segment")


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ...), role, text: the turns by number (null first), of equal ones by role and text.

    Null roles and texts are empty ones. Rows without conv_id are left out. Repeated rows are turns of their own.
    """
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("segment", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-1 << 62)))
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("conv_id", "segment").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.withColumn("rank", F.row_number().over(own)).join(sizes, ["conv_id", "segment"]).select("conv_id", (F.col("offset") + F.col("rank")).alias("place"), "role", "text")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n_turns) and turns (conv_id, place, role, text) of placed turns, begun as their family begins.

    A conversation c has the first crc32(c) % 4 turns of the one of number c - c % 20 (fewer if it has no more, none if
    there is none), and then its own ones after as many.
    """
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    begun = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    convs = convs.withColumns({"begun": begun, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    of_base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = cut(convs.join(of_base, "base", "left").select("conv_id", "base", "n", "begun", F.least("begun", F.coalesce("n_base", F.lit(0))).alias("taken")))
    heads = turns.filter(F.col("place") <= 3).withColumnRenamed("conv_id", "base")
    first = convs.join(heads, "base").filter(F.col("place") <= F.col("begun")).select("conv_id", "place", "role", "text")
    own = turns.join(convs, "conv_id").filter(F.col("place") > F.col("begun")).select("conv_id", (F.col("place") - F.col("begun") + F.col("taken")).alias("place"), "role", "text")
    return convs.select("conv_id", (F.greatest(F.col("n") - F.col("begun"), F.lit(0)) + F.col("taken")).alias("n_turns")), first.union(own)


def beginnings(turns: DataFrame) -> DataFrame:
    """conv_id, depth, low and high (128-bit hash of the turns up to this one), low_above and high_above, n_words of it."""
    rows = turns.select("conv_id", F.col("place").alias("depth"), n_words(F.col("text")).alias("n_words"), F.xxhash64("place", "role", "text").alias("one"), F.xxhash64(F.lit("two"), "text", "place", "role").alias("two"))
    rows = _carried(rows, ["conv_id"], "depth", {"one": F.col("one"), "two": F.col("two")}, F.bit_xor)
    low, high = (F.col(f"_{k}").bitwiseXOR(F.col(f"_{k}_before")) for k in ("one", "two"))
    return rows.select("conv_id", "depth", low.alias("low"), high.alias("high"), low.bitwiseXOR(F.col("one")).alias("low_above"), high.bitwiseXOR(F.col("two")).alias("high_above"), "n_words")


def nodes(convs: DataFrame, begun: DataFrame) -> DataFrame:
    """depth, low, high, conv_id (smallest member), n_convs, n_words, parent_conv_id of each node, the root included."""
    own = begun.groupBy("depth", "low", "high").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("n_words").alias("n_words"), F.first("low_above").alias("low_above"), F.first("high_above").alias("high_above"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter(F.col("n_convs") > 0)
    root = root.select(zero.alias("depth"), zero.alias("low"), zero.alias("high"), "conv_id", "n_convs", zero.alias("n_words"), none.alias("low_above"), none.alias("high_above"))
    every = cut(own.withColumn("depth", F.col("depth").cast("long")).unionByName(root))
    above = every.select((F.col("depth") + 1).alias("depth"), F.col("low").alias("low_above"), F.col("high").alias("high_above"), F.col("conv_id").alias("parent_conv_id"))
    return every.join(above, ["depth", "low_above", "high_above"], "left").drop("low_above", "high_above")


def _last(begins: Column, depth: Column) -> Column:
    return F.array_max(F.filter(begins, lambda x: x <= depth))


def _starts(chains: DataFrame) -> DataFrame:
    """conv_id and head (conv_id, depth) of the path that a chain's topmost node is on, where it doesn't begin it.

    Such a node is on the path of its parent, in another chain; where that chain has no beginning above, on the path of
    that chain's topmost one: pointers to chains are doubled until every one has led to a path.
    """
    above = chains.select(F.col("conv_id").alias("at"), F.col("begins").alias("begins_at"))
    head = _last(F.col("begins_at"), F.col("top.depth") - 1)
    state = stored(chains.filter("top.heavy").withColumn("at", F.col("top.parent_conv_id")).join(above, "at").select("conv_id", F.when(head.isNotNull(), F.struct(F.col("at").alias("conv_id"), head.alias("depth"))).alias("head"), "at"))
    while not state.filter(F.col("head").isNull()).isEmpty():
        further = state.select(F.col("conv_id").alias("at"), F.col("head").alias("head_at"), F.col("at").alias("further"))
        state = stored(state.join(further, "at", "left").select("conv_id", F.coalesce("head", "head_at").alias("head"), F.coalesce("further", "at").alias("at")))
    return state.select("conv_id", F.col("head").alias("start"))


def pathed(known: DataFrame) -> DataFrame:
    """The nodes with n_children, heavy (the parent's largest child) and head_conv, head_depth: the topmost node of their path.

    Nodes of one smallest member are a chain. It holds the beginnings of few paths, since each halves the members, and
    a node is on the path that begins last at or above it.
    """
    below = known.filter(F.col("depth") > 0).groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"), F.max_by("conv_id", F.struct("n_convs", -F.col("conv_id"))).alias("largest"))
    below = cut(below)
    heavy = below.select(F.col("largest").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.lit(True).alias("heavy"))
    tree = known.join(below.drop("largest"), NODE, "left").join(heavy, NODE, "left").fillna(0, ["n_children"]).fillna(False, ["heavy"])
    tree = cut(tree)
    begins = F.collect_list(F.when(~F.col("heavy"), F.col("depth")))  # log2 of the conversations at most
    chains = cut(tree.groupBy("conv_id").agg(F.min(F.struct("depth", "parent_conv_id", "heavy")).alias("top"), begins.alias("begins")))
    chains = chains.select("conv_id", "begins").join(_starts(chains), "conv_id", "left")
    own = _last(F.col("begins"), F.col("depth"))
    tree = tree.join(chains, "conv_id").withColumns({"head_conv": F.when(own.isNotNull(), F.col("conv_id")).otherwise(F.col("start.conv_id")), "head_depth": F.coalesce(own, "start.depth")})
    return tree.drop("begins", "start")


SUMS = ["n_leaves", "saved_tokens"]


def subtree_sums(tree: DataFrame) -> DataFrame:
    """The nodes of pathed() (with their own n_leaves and saved_tokens) with the sums of these over their subtrees."""
    tree = cut(tree)
    path = ["head_conv", "head_depth"]
    totals = [F.sum(c).alias(c) for c in SUMS]
    # Each path's own sum rises to the node above it, and with that node's path further up, round by round.
    tops = cut(tree.filter((F.col("conv_id") == F.col("head_conv")) & (F.col("depth") == F.col("head_depth")) & (F.col("depth") > 0)).select(*NODE, "parent_conv_id"))
    at = tree.select(*NODE, *path)
    by_path = lambda df: df.groupBy(F.col("head_conv").alias("conv_id"), F.col("head_depth").alias("depth")).agg(*totals)
    rising, steps = by_path(tree), []
    while True:
        step = cut(rising.join(tops, NODE).groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(*totals))
        if step.isEmpty():
            break
        steps.append(step)
        rising = by_path(step.join(at, NODE))
    hung = reduce(DataFrame.unionByName, steps, step).groupBy(*NODE).agg(*[F.sum(c).alias(f"hung_{c}") for c in SUMS])
    with_hung = tree.join(hung, NODE, "left")
    carried = _carried(with_hung, path, "depth", {c: F.col(c) + F.coalesce(f"hung_{c}", F.lit(0)) for c in SUMS}, F.sum, falling=True)
    return carried.withColumns({c: F.col(f"_{c}") + F.col(f"_{c}_before") for c in SUMS}).drop(*[f"{p}{c}{s}" for c in SUMS for p, s in (("_", ""), ("_", "_before"), ("hung_", ""))])


def ends(convs: DataFrame, begun: DataFrame) -> DataFrame:
    """depth, low, high, ends_sha256 of each node at which conversations end: their numbers, ascending, with commas.

    Numbers are joined in blocks, in many tasks; the hash of a node runs over its blocks in order, one at a time.
    """
    last = begun.join(convs, (begun["conv_id"] == convs["conv_id"]) & (begun["depth"] == convs["n_turns"]), "left_semi").select(F.col("depth").cast("long").alias("depth"), "low", "high", "conv_id")
    zero = F.lit(0).cast("long")
    last = last.union(convs.filter("n_turns = 0").select(zero, zero, zero, "conv_id"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")  # BLOCK at most
    blocks = last.groupBy("depth", "low", "high", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(joined.alias("numbers"))
    ordered = blocks.repartition("depth", "low", "high").sortWithinPartitions("depth", "low", "high", "block").select("depth", "low", "high", "numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, digest = None, None
        for batch in batches:
            done = []
            for *node, numbers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if node == of:
                    digest.update(b",")
                else:
                    if of is not None:
                        done.append((*of, digest.hexdigest()))
                    of, digest = node, hashlib.sha256()
                digest.update(numbers.encode())
            yield _ended(done)
        if of is not None:
            yield _ended([(*of, digest.hexdigest())])

    return ordered.mapInArrow(run, ENDS)


def _ended(rows: list) -> pa.RecordBatch:
    names = ["depth", "low", "high", "ends_sha256"]
    return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([*[(n, pa.int64()) for n in names[:3]], (names[3], pa.string())]))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id are left out; null roles and texts are empty, null turn numbers come first, repeated rows are
    turns of their own. A conversation that keeps no turn is a member of the root alone. Empty input: no rows. Other
    columns of the input don't matter.
    """
    convs, own = rebuilt(cut(placed(turns)))
    begun = cut(beginnings(own))
    tree = pathed(nodes(convs, begun))
    tree = tree.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_words")})
    summed = subtree_sums(tree).join(ends(convs, begun), ["depth", "low", "high"], "left")
    return summed.select(*NODE, "parent_conv_id", "n_convs", "n_children", *SUMS, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 % 4 of a number's text, bit by bit.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT for x in string_split(CAST({c} AS VARCHAR), '')]), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT for k in range(8)]), lambda s, k: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::BIGINT) ELSE s // 2 END))"
OP13_SQL = f"""
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, xor({_CRC.format(c="conv_id")}, 4294967295) % 4 AS begun
  FROM (SELECT DISTINCT conv_id FROM placed)),
taken AS (
  SELECT c.conv_id, c.base, c.begun, least(c.begun, (SELECT count(*) FROM placed p WHERE p.conv_id = c.base)) AS taken FROM convs c),
turns AS (
  SELECT t.conv_id, p.place, p.role, p.text FROM taken t JOIN placed p ON p.conv_id = t.base AND p.place <= t.begun
  UNION ALL
  SELECT t.conv_id, p.place - t.begun + t.taken, p.role, p.text FROM taken t JOIN placed p ON p.conv_id = t.conv_id AND p.place > t.begun),
begun AS (
  SELECT conv_id, place AS depth, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '|') OVER (
           PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS node,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_words
  FROM turns
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM convs),
named AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last, min(conv_id) OVER (PARTITION BY depth, node) AS name FROM begun),
own AS (
  SELECT depth, name, any_value(n_words) AS n_words, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE depth = last), '')) AS ends_sha256
  FROM named GROUP BY depth, name),
edges AS (SELECT DISTINCT p.name AS above, c.name, c.depth FROM named p JOIN named c ON p.conv_id = c.conv_id AND c.depth = p.depth + 1),
below AS (SELECT DISTINCT p.name, p.depth, c.name AS inner_name, c.depth AS inner_depth FROM named p JOIN named c ON p.conv_id = c.conv_id AND c.depth >= p.depth),
children AS (SELECT above AS name, depth - 1 AS depth, count(*) AS n_children FROM edges GROUP BY ALL),
sums AS (
  SELECT b.name, b.depth, CAST(sum((o.n_convs - 1) * o.n_words) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves
  FROM below b JOIN own o ON o.name = b.inner_name AND o.depth = b.inner_depth LEFT JOIN children k ON k.name = o.name AND k.depth = o.depth GROUP BY ALL)
SELECT o.name AS conv_id, o.depth, e.above AS parent_conv_id, o.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
FROM own o JOIN sums s USING (name, depth) LEFT JOIN edges e USING (name, depth) LEFT JOIN children k USING (name, depth)
"""
