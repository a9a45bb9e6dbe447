"""Chat formatting: logged snapshots of one growing conversation collapse to the longest, which is rendered.

A rolling hash of its turns is kept for every beginning of a conversation. One whose whole hash is a beginning of a
longer conversation is a snapshot of it and goes by an anti-join; of equal conversations the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Turn numbers that one segment of a conversation spans; a long conversation is hashed in as many windows.
SEGMENT = 1024
#: Turns that one rendered row holds; longer conversations have several parts.
PART = 1024


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ...), role, text, low and high: the 128-bit hash of the turns up to and with this one.

    Turns are ordered by number (null first), role and text. The hash is the exclusive-or of the hashes of (place,
    role, text), so the segments of a conversation are hashed apart and carried on over their sums. Null roles and
    texts are empty ones. Rows without conv_id are left out. Repeated rows are turns of their own.
    """
    rows = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("segment", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-1 << 62)))
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("conv_id", "segment").orderBy("turn", "role", "text")
    placed = rows.withColumn("rank", F.row_number().over(own)).join(sizes, ["conv_id", "segment"]).withColumn("place", F.col("offset") + F.col("rank"))
    placed = placed.withColumns({"one": F.xxhash64("place", "role", "text"), "two": F.xxhash64(F.lit("two"), "text", "place", "role")})
    sums = placed.groupBy("conv_id", "segment").agg(F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))
    sums = sums.select("conv_id", "segment", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("long")).alias(f"{c}_before") for c in ("one", "two")])
    running = Window.partitionBy("conv_id", "segment").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumns({"low": F.bit_xor("one").over(running), "high": F.bit_xor("two").over(running)}).join(sums, ["conv_id", "segment"])
    return placed.select("conv_id", "place", "role", "text", F.col("low").bitwiseXOR(F.col("one_before")).alias("low"), F.col("high").bitwiseXOR(F.col("two_before")).alias("high"))


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that begin no longer one, and n_copies, the number of equal ones.

    Copies and common beginnings are aggregated to one row each before they are joined, however many there are.
    """
    ends = hashed.groupBy("conv_id").agg(F.max(F.struct("place", "low", "high")).alias("end")).select("conv_id", "end.*")
    whole = ends.groupBy("place", "low", "high").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = hashed.join(ends.select("conv_id", F.col("place").alias("last")), "conv_id").filter(F.col("place") < F.col("last")).select("place", "low", "high").distinct()
    return whole.join(inner, ["place", "low", "high"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def rendered(hashed: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_copies, chat: the turns of the kept conversations, PART turns a row."""
    line = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))
    rows = hashed.select("conv_id", "place", "role", "text", F.floor((F.col("place") - 1) / PART).alias("part")).join(kept, "conv_id")
    turns = F.sort_array(F.collect_list(F.struct("place", "role", "text")))  # PART turns at most
    return rows.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.array_join(F.transform(turns, line), "").alias("chat")).select("conv_id", "part", "n_turns", "n_copies", "chat")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = prefixes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return rendered(hashed, maximal(hashed))


OP8_SQL = """
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
begun AS (
  SELECT conv_id, place, string_agg(length(role) || ':' || role || length(text) || ':' || text, '|') OVER (
     PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS beginning,
     count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM placed),
kept AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies FROM begun WHERE place = n_turns AND beginning NOT IN (
     SELECT beginning FROM begun WHERE place < n_turns) GROUP BY beginning, n_turns)
SELECT conv_id, CAST(floor((place - 1) / 1024) AS BIGINT) AS part, n_turns, n_copies,
  string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY place) AS chat
FROM placed JOIN kept USING (conv_id) GROUP BY ALL
"""
