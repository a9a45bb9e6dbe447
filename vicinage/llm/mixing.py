"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, twice over. A document's virtual finish time is the
cumulative size of its queue up to and with it, divided by the source's target. One global order of finish times,
cut at the total budget, gives each source its share, as a fair queue would serve it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinage.llm.common import cut, documents, hash32, n_words

#: Documents, about, of a source whose running sum is taken in one window.
RUN = 4096
#: Times that a document is queued, and the most of a source's size that its target can be.
PASSES = 2


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5) -> DataFrame:
    """One row a source: source, source_size, weight, target (words).

    Sources in order of code point, null last, take the weights in turn. They share ``budget`` times all sizes by
    weight; a source stops at twice its own size and the excess goes to the others. That is the level at which the sum
    of min(stop, level * weight) is the budget. Sources ordered by stop / weight reach their stop one after the other,
    so running sums over the sources give the level. The windows here are over sources, not over documents.
    An empty input gives no rows; a source without words has target 0.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    filling = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum("stop").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    waiting = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
        .withColumn("stop", (F.col("source_size") * PASSES).cast("double"))
        .withColumn("here", (budget * F.sum("source_size").over(everything) - stopped) / waiting)
        .withColumn("level", F.first(F.when(F.col("here") <= F.col("stop") / F.col("weight"), F.col("here")), ignorenulls=True).over(everything))
        .select("source", "source_size", "weight", F.least("stop", F.coalesce(F.col("level") * F.col("weight"), F.col("stop"))).alias("target"))
    )


def mix(sized: DataFrame, targets: DataFrame, budget: float = 1.5, seed: str = "mix", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``sized`` with source_size, target, copies (0, 1 or 2 times taken) and taken (words, repeats counted).

    ``sized`` has an id, ``source`` and ``size`` and may have any other columns; those named as a result are replaced.
    A source's running sums are taken in buckets of the shuffling hash and carried on over the sums of the buckets, so
    a source that holds most of the corpus is spread over many tasks. The cut is found from the sums of finish-time
    buckets and the order within one of them; only that one position comes to the driver. The last document that fits
    is the last one taken, so a source is off its target by about a document.
    Rows of size 0 (null text, no word) are never taken. Null sources are one source. Equal hashes are told apart by
    id and size; repeated rows follow one another. Empty input: no rows.
    """
    sized = sized.drop("source_size", "target", "copies", "taken", "weight")
    count = sized.count()
    shift = max(0, 32 - max(0, (count // RUN).bit_length()))
    rows = sized.withColumn("_at", hash32(F.lit(seed), F.col(id_col).cast("string"))).withColumn("_run", F.shiftright("_at", shift))
    runs = rows.groupBy("source", "_run").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    runs = runs.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    runs = runs.select(F.col("r.source").alias("_source"), F.col("_run").alias("_key"), "_before", "source_size", "target")
    own = Window.partitionBy("source", "_run").orderBy("_at", id_col, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = (
        rows.withColumn("_own", F.sum("size").over(own))
        .join(runs, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_run") == F.col("_key")))
        .withColumn("_first", (F.col("_before") + F.col("_own")) / F.col("target"))
        .withColumn("_second", (F.col("source_size") + F.col("_before") + F.col("_own")) / F.col("target"))
    )
    last = _last_taken(queued, budget, id_col)
    position = lambda c: F.struct(F.col(c), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("_at"), F.col(id_col), F.col("size"))
    taken = lambda c: F.when((F.col("size") > 0) & (position(c) <= last), 1).otherwise(0) if last is not None else F.lit(0)
    queued = queued.withColumn("copies", taken("_first") + taken("_second")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return queued.select(*sized.columns, "source_size", "target", "copies", "taken")


def _last_taken(queued: DataFrame, budget: float, id_col: str):
    """Position (a struct literal) of the last item within the budget in the order of finish times; None: there is none."""
    item = lambda c: F.struct(F.col(c).alias("finish"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"), F.col("_at").alias("at"), F.col(id_col).alias("id"), F.col("size").alias("size"))
    items = cut(queued.filter(F.col("size") > 0).select(F.explode(F.array(item("_first"), item("_second"))).alias("i")).select("i.*"))
    # So many buckets that the one at the edge, which is sorted, has about RUN items.
    buckets = max(1, items.count() // RUN)
    items = items.withColumn("bucket", F.floor(F.least(F.col("finish"), F.lit(2.0)) * buckets))
    sums = items.groupBy("bucket").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = sums.withColumn("upto", running)
    # Each pass over a source counts once in the queue, so the corpus is half of what is queued.
    total = F.sum("words").over(Window.partitionBy()) / PASSES * budget
    edge = sums.withColumn("most", total).filter(F.col("upto") > F.col("most")).orderBy("bucket").first()
    if edge is None:
        found = items.orderBy(*[F.col(c).desc() for c in ("finish", "no_source", "source", "at", "id", "size")]).first()
    else:
        order = Window.orderBy("finish", "no_source", "source", "at", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = items.filter(F.col("bucket") == edge["bucket"]).withColumn("upto", F.sum("size").over(order) + F.lit(edge["upto"] - edge["words"]))
        names = ("finish", "no_source", "source", "at", "id", "size")
        back = [F.col(c).desc() for c in names]
        found = inside.filter(F.col("upto") <= F.lit(edge["most"])).orderBy(*back).first() or items.filter(F.col("bucket") < edge["bucket"]).orderBy(*back).first()
    if found is None:
        return None
    kinds = dict(items.dtypes)
    return F.struct(*[F.lit(found[c]).cast(kinds[c]).alias(c) for c in ("finish", "no_source", "source", "at", "id", "size")])


def sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("size", n_words(F.col(text_col)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(sizes(documents(spark, sf_dir).select("doc_id", "text", "source")).drop("text"))
    return mix(sized, source_targets(sized)).select("doc_id", "size", "source_size", "target", "taken")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    columns = docs.columns
    targets = cut(source_targets(sizes(docs.select("text", "source"))))
    mixed = mix(sizes(docs), targets).filter(F.col("copies") > 0)
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substring(md5('mix|' || doc_id), 1, 8)) AS BIGINT) AS spot
  FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rn
  FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, CAST([5, 2, 1][(rn - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS stop FROM named),
filled AS (
  SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE)
     - coalesce(sum(stop) OVER (ORDER BY stop / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
     / sum(weight) OVER (ORDER BY stop / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here
  FROM weighed),
leveled AS (
  SELECT *, first_value(CASE WHEN here <= stop / weight THEN here END IGNORE NULLS) OVER (
     ORDER BY stop / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level
  FROM filled),
targets AS (SELECT source, source_size, least(stop, coalesce(level * weight, stop)) AS target FROM leveled),
queued AS (
  SELECT s.*, t.source_size, t.target,
     CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY spot, doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS own
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
items AS (
  SELECT doc_id, source, spot, size, CAST(own + pass * source_size AS DOUBLE) / target AS finish
  FROM queued, (VALUES (0), (1)) p(pass) WHERE size > 0),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, spot, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM items),
picked AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM served WHERE upto <= (SELECT 1.5 * sum(size) FROM sized) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(p.taken, 0) AS taken FROM queued q LEFT JOIN picked p USING (doc_id)
"""
