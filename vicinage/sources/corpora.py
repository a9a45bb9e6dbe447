"""Graph and sequence corpora made of ordinary tables: (vertices, edges) or sequences, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinage.functions.lineage import many, spread, stored
from vicinage.operators.sampling import placed
from vicinage.operators.sequence_vectorizer import tokens_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paths(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Path graphs of sequences (id, tokens): vertex i is token i, edges are labelled ``-``."""
    vertices = sequences.select(F.col("id").alias("graph_id"), F.posexplode("tokens").alias("vid", "label")).withColumn("vid", F.col("vid").cast("long"))
    vertices = many(vertices)
    edges = vertices.filter("vid > 0").select("graph_id", (F.col("vid") - 1).alias("src"), F.col("vid").alias("dst"), F.lit("-").alias("label"))
    return vertices, edges


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tokens_of(F.col("p_name")).alias("tokens"))


def name_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name"), "id")
    return paths(rows.select("id", tokens_of(F.col("p_name")).alias("tokens")))


def word_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    rows = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return paths(rows.select("id", words.alias("tokens")))


def order_graphs(spark: SparkSession, sf_dir: str, lengths: bool = False) -> tuple[DataFrame, DataFrame]:
    """A wheel an order: hub 0 with the priority, a weighted vertex a line; lines in a total order.

    The lines are stored once they are numbered, since each use would shuffle whole line items anew. With ``lengths`` an
    edge has the weight of the line it leads to.
    """
    items = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(*sorted(items.columns))
    lines = items.withColumn("vid", F.row_number().over(order).cast("long")).select(F.col("l_orderkey").alias("graph_id"), "vid", F.concat("l_returnflag", "l_linestatus").alias("label"), (F.col("l_quantity") / 50).alias("weight"))
    orders = table(spark, sf_dir, "orders")
    lines = stored(lines.join(many(orders.select(F.col("o_orderkey").alias("graph_id"))), "graph_id", "left_semi"))
    hubs = orders.select(F.col("o_orderkey").alias("graph_id"), F.lit(0).cast("long").alias("vid"), F.col("o_orderpriority").alias("label"), F.lit(1.0).alias("weight"))
    hubs = hubs.join(many(lines.filter("vid = 1").select("graph_id")), "graph_id", "left_semi")
    edge = lambda src, label: F.struct(src.cast("long").alias("src"), F.lit(label).alias("label"))
    ends = F.when(F.col("vid") > 1, F.array(edge(F.lit(0), "has"), edge(F.col("vid") - 1, "next"))).otherwise(F.array(edge(F.lit(0), "has")))
    edges = lines.select("graph_id", "vid", "weight", F.explode(ends).alias("e"))
    return hubs.unionByName(lines), many(edges.select("graph_id", "e.src", F.col("vid").alias("dst"), "e.label", *([F.col("weight").alias("length")] if lengths else [])))


def role_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A path over the turns of a conversation, with a nesting edge from each assistant turn to the last turn but one."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("vid"), F.col("role").alias("label"))
    order = Window.partitionBy("graph_id").orderBy("vid")
    placed = turns.withColumns({"before": F.lag("vid").over(order), "second": F.lag("vid", 2).over(order)})
    steps = placed.filter("before is not null").select("graph_id", F.col("before").alias("src"), F.col("vid").alias("dst"), F.lit("-").alias("label"), F.lit(None).cast("double").alias("weight"), F.lit(False).alias("nesting"))
    nests = placed.filter("label = 'assistant' and second is not null").select("graph_id", F.col("second").alias("src"), F.col("vid").alias("dst"), F.lit("answers").alias("label"), F.lit(0.5).alias("weight"), F.lit(True).alias("nesting"))
    return turns, steps.unionByName(nests)


def vector_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chains of ten embeddings of one class; ``vec`` has all coordinates, ``svec`` the large ones.

    Embeddings are ranked in buckets of 4096 ids, whose sizes are summed up by class.
    """
    rows = placed(table(spark, sf_dir, "embeddings"), F.col("vec_id") * 256, ["vec_id"], "label")
    large = F.map_from_entries(F.filter(F.transform("embedding", lambda x, i: F.struct(i.cast("string").alias("key"), x.cast("double").alias("value"))), lambda e: F.abs(e["value"]) > 0.2))
    vertices = rows.withColumn("rank", F.col("place") - 1).select((F.col("label").cast("long") * (1 << 40) + F.floor(F.col("rank") / 10)).cast("long").alias("graph_id"), (F.col("rank") % 10).cast("long").alias("vid"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), large.alias("svec"))
    edges = vertices.filter("vid > 0").select("graph_id", (F.col("vid") - 1).alias("src"), F.col("vid").alias("dst"), F.lit("-").alias("label"))
    return vertices, edges


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted sequence a user: first letters of event types in time order, values / 100 as weights."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.substring("event_type", 1, 1).alias("token"), "value"))).alias("e"))
    return rows.select(F.col("user_id").alias("id"), F.transform("e", lambda e: e["token"]).alias("tokens"), F.transform("e", lambda e: e["value"] / 100).alias("weights"))


#: The same corpora in SQL, as the bodies of the views v (graph_id, vid, label, weight) and e (graph_id, src, dst, label, weight, nesting).
NAMES_SQL = (
    "SELECT graph_id, vid, substring(p_name, vid + 1, 1) AS label, CAST(NULL AS DOUBLE) AS weight FROM (SELECT p_partkey AS graph_id, p_name, unnest(range(0, length(p_name))) AS vid FROM part)",
    "SELECT graph_id, vid - 1 AS src, vid AS dst, '-' AS label, CAST(NULL AS DOUBLE) AS weight, false AS nesting FROM v WHERE vid > 0",
)
WORDS_SQL = (
    "SELECT doc_id AS graph_id, i - 1 AS vid, w[i] AS label, CAST(NULL AS DOUBLE) AS weight FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents))",
    NAMES_SQL[1],
)
ORDERS_SQL = (
    "SELECT o_orderkey AS graph_id, 0 AS vid, o_orderpriority AS label, 1.0::DOUBLE AS weight FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL "
    "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_extendedprice, l_linenumber, l_linestatus, l_orderkey, l_partkey, l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax), l_returnflag || l_linestatus, l_quantity / 50 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)",
    "SELECT graph_id, 0 AS src, vid AS dst, 'has' AS label, CAST(NULL AS DOUBLE) AS weight, false AS nesting FROM v WHERE vid > 0 UNION ALL SELECT graph_id, vid - 1, vid, 'next', NULL, false FROM v WHERE vid > 1",
)
ROLES_SQL = (
    "SELECT conv_id AS graph_id, turn AS vid, role AS label, CAST(NULL AS DOUBLE) AS weight FROM conversations",
    "SELECT graph_id, src, dst, label, weight, nesting FROM (SELECT graph_id, lag(vid) OVER (PARTITION BY graph_id ORDER BY vid) AS src, vid AS dst, '-' AS label, CAST(NULL AS DOUBLE) AS weight, false AS nesting FROM v) WHERE src IS NOT NULL "
    "UNION ALL SELECT graph_id, src, dst, 'answers', 0.5, true FROM (SELECT graph_id, lag(vid, 2) OVER (PARTITION BY graph_id ORDER BY vid) AS src, vid AS dst, label FROM v) WHERE src IS NOT NULL AND label = 'assistant'",
)
VECTORS_SQL = (
    "SELECT label * 1099511627776 + rank // 10 AS graph_id, CAST(rank % 10 AS BIGINT) AS vid, CAST(label AS VARCHAR) AS label, CAST(NULL AS DOUBLE) AS weight, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rank FROM embeddings)",
    NAMES_SQL[1],
)
EVENTS_SQL = "SELECT user_id AS id, list(substring(event_type, 1, 1) ORDER BY ts, event_id) AS tokens, list(value / 100 ORDER BY ts, event_id) AS weights FROM events GROUP BY user_id"
PART_SQL = "SELECT p_partkey AS id, list_filter(string_split(p_name, ''), lambda c: c <> '') AS tokens FROM part"
