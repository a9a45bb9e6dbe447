"""Stretches of a sequence with a large total score."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smallest_positive(values: Column) -> Column:
    """The smallest positive value; -1 where there is none."""
    return F.coalesce(F.array_min(F.filter(values, lambda x: x > 0)), F.lit(-1.0))


def rebased(values: Column) -> Column:
    """Values less their smallest positive one; null where there is none."""
    return F.when(F.exists(values, lambda x: x > 0), F.transform(values, lambda x: x - F.array_min(F.filter(values, lambda y: y > 0))))


def max_subarray(values: Column) -> Column:
    """struct(begin, end, score) of the first stretch of the largest sum, from one fold over the array."""
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("from"), F.get(values, F.lit(0)).alias("here"), F.lit(0).alias("begin"), F.lit(0).alias("end"), F.get(values, F.lit(0)).alias("best"))

    def step(a: Column, x: Column) -> Column:
        fresh = a["here"] < 0
        here, begin, at = F.when(fresh, x).otherwise(a["here"] + x), F.when(fresh, a["at"] + 1).otherwise(a["from"]), a["at"] + 1
        better = here > a["best"]
        return F.struct(at.alias("at"), begin.alias("from"), here.alias("here"), F.when(better, begin).otherwise(a["begin"]).alias("begin"), F.when(better, at).otherwise(a["end"]).alias("end"), F.when(better, here).otherwise(a["best"]).alias("best"))

    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), first, step, lambda a: F.struct(a["begin"].alias("begin"), a["end"].alias("end"), a["best"].alias("score")))


def _largest(score: list[float]) -> tuple[int, int, float]:
    """First stretch (begin, end, sum) of the largest sum, as the largest rise of the running totals."""
    low, low_at, total, best = 0.0, 0, 0.0, (0, 0, float("-inf"))
    for k, x in enumerate(score):
        total += x
        if total - low > best[2]:
            best = (low_at, k, total - low)
        if total < low:
            low, low_at = total, k + 1
    return best


def stretches(score: list[float], least: int, most: int, margin: int = 1) -> Iterator[tuple[int, int, float]]:
    """(first, last + 1, score) of one stretch of the largest sum after another, widened by the margin at either side.

    One that is too long, or any if there is no bound (-1), has the smallest positive value taken from all scores
    before the search goes on; others are set to zero. It ends at a stretch shorter than ``least``, or without gain.
    """
    score, given = list(score), list(score)
    while score:
        begin, end, best = _largest(score)
        if end - begin + 1 < least or best <= 0:
            return
        first, last = max(0, begin - margin), min(len(score), end + 1 + margin)
        if most == -1 or last - first <= most:
            yield first, last, float(sum(given[begin : end + 1]))
        if last - first > most:
            positive = [x for x in score if x > 0]
            if not positive:
                return
            score = [x - min(positive) for x in score]
            given = score
        else:
            score[first:last] = [0.0] * (last - first)


def iterated_max_subarrays(sequences: DataFrame, least: int, most: int, margin: int = 1) -> DataFrame:
    """id, rank, begin, end, size, score, motif of sequences (id, tokens, score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(key, rank, a, b, b - a, s, "".join(tokens[a:b])) for key, tokens, score in zip(rows["id"], rows["tokens"], rows["score"], strict=True) for rank, (a, b, s) in enumerate(stretches(list(score), least, most, margin))]
            yield pd.DataFrame(out, columns=["id", "rank", "begin", "end", "size", "score", "motif"])

    return sequences.select("id", "tokens", "score").mapInPandas(run, f"id {dict(sequences.dtypes)['id']}, rank int, begin int, end int, size int, score double, motif string")


def sequence_and_score(vertices: DataFrame) -> DataFrame:
    """graph_id, tokens, score in order of position of vertices (position, label, importance).

    Importance is the mean of a position's vertices, null counting 0. A missing position, or different labels at one,
    end the query with an error.
    """
    each = vertices.groupBy("graph_id", "position").agg(F.min("label").alias("label"), F.max("label").alias("other"), F.avg(F.coalesce("importance", F.lit(0.0))).alias("score"))
    wrong = F.col("position").isNull() | ~F.col("label").eqNullSafe(F.col("other"))
    each = each.withColumn("label", F.when(wrong, F.raise_error(F.lit("a vertex without position, or labels that differ at one position"))).otherwise(F.col("label")))
    lists = each.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("position", "label", "score"))).alias("p"))
    return lists.select("graph_id", F.transform("p", lambda p: p["label"]).alias("tokens"), F.transform("p", lambda p: p["score"]).alias("score"))


def max_stretches(rows: DataFrame, key: str, segment: str, order: list[str], value: str) -> DataFrame:
    """key, score: the largest sum of a run of successive values of each key, one value at least.

    rows are ordered by segment and, within it, by ``order``. A segment is summed up by its total, the largest and the
    smallest of its running sums and the best run inside it; runs over several segments follow from these and the
    totals before. So no task holds more than a segment, or one row for each segment of a key.
    """
    within = Window.partitionBy(key, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(key, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.withColumn("_sum", F.sum(value).over(within))
    sums = sums.withColumn("_low", F.least(F.lit(0.0), F.coalesce(F.min("_sum").over(earlier), F.lit(0.0))))
    parts = sums.groupBy(key, segment).agg(F.sum(value).alias("total"), F.max("_sum").alias("high"), F.least(F.lit(0.0), F.min("_sum")).alias("low"), F.max(F.col("_sum") - F.col("_low")).alias("inside"))
    before = Window.partitionBy(key).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    parts = parts.withColumn("_across", F.col("_before") + F.col("high") - F.min(F.col("_before") + F.col("low")).over(before))
    return parts.groupBy(key).agg(F.max(F.greatest("inside", "_across")).alias("score"))


def smallest_positives(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, base: the smallest positive value of each key, -1 where there is none."""
    return rows.groupBy(key).agg(F.coalesce(F.min(F.when(F.col(value) > 0, F.col(value))), F.lit(-1.0)).alias("base"))
