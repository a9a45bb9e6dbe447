"""Distances of query vectors to all vectors, by blocks of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions.lineage import cut

#: Vectors of a block, about: of all and of the queries; and blocks of queries, at most, that are broadcast.
BLOCK, QUERIES, SMALL = 1024, 256, 200
#: Distances are rounded to this many places.
PLACES = 5


def _blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of vectors (id, vector) in columns of arrays: ids, sizes and all numbers on end; size -1: a null in it."""
    n = max(1, -(-vectors.count() // size))
    whole = F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False))
    rows = vectors.select("id", F.when(whole, F.size("vector")).otherwise(-1).alias("size"), F.when(whole, F.transform("vector", lambda x: x.cast("double"))).otherwise(F.array().cast("array<double>")).alias("x"))
    lists = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("_block")).agg(F.collect_list(F.struct("id", "size", "x")).alias("v"))  # of one block
    return lists.select(F.transform("v", lambda v: v["id"]).alias(f"{name}_ids"), F.transform("v", lambda v: v["size"]).alias(f"{name}_sizes"), F.flatten(F.transform("v", lambda v: v["x"])).alias(f"{name}_x"))


def _padded(sizes: np.ndarray, x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((width, len(sizes)))
    for k, (n, end) in enumerate(zip(sizes, np.cumsum(np.maximum(sizes, 0)), strict=True)):
        if n > 0:
            out[:n, k] = x[end - n : end]
    return out


def gaps(queries: DataFrame, vectors: DataFrame, nearest: int | None = None) -> DataFrame:
    """i, j, distance of each query (id, vector) and each vector (id, vector) of another id; null unless both are whole and of one size.

    With ``nearest`` only pairs that may be among so many nearest ones of a query, by the rounded distance and j, come
    back: of each block the nearest ones, and all that could equal the last of these when rounded.
    """
    asked = cut(_blocks(queries, QUERIES, "i"))
    few = asked.count() <= SMALL
    pairs = _blocks(vectors, BLOCK, "j").crossJoin(F.broadcast(asked) if few else asked.hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                i, n, x, j, m, y = (batch.column(f"{s}_{c}")[at].values.to_numpy(zero_copy_only=False) for s in "ij" for c in ("ids", "sizes", "x"))
                width = int(max(n.max(), m.max(), 0))
                left, right = _padded(n, x, width), _padded(m, y, width)
                square = np.zeros((len(i), len(j)))
                for k in range(width):  # in the order of the components
                    part = left[k][:, None] - right[k]
                    square += part * part
                fit, other = (n[:, None] == m) & (n[:, None] >= 0), i[:, None] != j
                kept = other
                if nearest is not None and len(j) > nearest:
                    away = np.where(other & fit, np.sqrt(square), np.inf)
                    last = np.partition(away, nearest - 1, axis=1)[:, nearest - 1]
                    kept = other & ((away <= last[:, None] + 3 * 10.0**-PLACES) | np.isnan(away) | ~fit)
                rows, columns = np.nonzero(kept)
                yield pa.RecordBatch.from_arrays([pa.array(i[rows]), pa.array(j[columns]), pa.array(square[rows, columns], mask=~fit[rows, columns])], ["i", "j", "square"])

    columns = [f"{s}_{c}" for s in "ij" for c in ("ids", "sizes", "x")]
    kind = vectors.schema["id"].dataType.simpleString()
    return pairs.select(*columns).mapInArrow(run, f"i {kind}, j {kind}, square double").select("i", "j", F.round(F.sqrt("square"), PLACES).alias("distance"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """i, j, distance, rank of the k nearest vectors of each query, equal distances by j."""
    order = Window.partitionBy("i").orderBy("distance", "j")
    return gaps(queries, vectors, k).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
