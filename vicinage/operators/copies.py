"""Equal graphs or sequences have equal features: these are made once for each kind and handed to all of its copies."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.functions.lineage import cut, few, many

#: Rows, at most, that are broadcast.
SMALL = 200_000
#: Sums of 31 bits of the hashes of a key's rows; together with the number of rows they tell kinds apart.
SUMS = [f"_sum{k}" for k in range(4)]


def _marks(key: str, tables: tuple[DataFrame, ...]) -> DataFrame:
    """key, the number of its rows in all tables and the sums of their hashes, which don't depend on their order."""
    rows = [t.select(key, F.md5(F.to_json(F.struct(F.lit(k).alias("_table"), *[c for c in t.columns if c != key]))).alias("_row")) for k, t in enumerate(tables)]
    sums = [F.sum(F.xxhash64(F.lit(k), "_row").bitwiseAND((1 << 31) - 1)).alias(name) for k, name in enumerate(SUMS)]
    return reduce(DataFrame.unionAll, rows).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), *sums)


def firsts(key: str, tables: tuple[DataFrame, ...]) -> DataFrame:
    """key, _first: the smallest key of the same rows in the tables, for every key."""
    marks, same = cut(_marks(key, tables)), ["_rows", *SUMS]
    kinds = cut(marks.groupBy(*same).agg(F.min(key).alias("_first")))
    return marks.join(few(many(kinds), SMALL), same).select(key, "_first")


def shared(key: str, tables: tuple[DataFrame, ...], make: Callable[..., DataFrame]) -> DataFrame:
    """``make(*tables)``, of which each key's rows depend on the key's own rows in the tables alone, but not on the key.

    Where half of the keys or more are copies of others, make gets the first key of each kind, and all keys of the kind
    get its rows; else it gets the tables as they are. Either way the result has the rows of every key.
    """
    if any(t.isStreaming for t in tables):
        return make(*tables)
    marks = cut(_marks(key, tables))
    same = ["_rows", *SUMS]
    kinds = cut(marks.groupBy(*same).agg(F.min(key).alias("_first")))
    if 2 * kinds.count() > marks.count():
        return make(*tables)
    one = few(many(kinds.select(F.col("_first").alias(key))), SMALL)
    made = cut(make(*[t.join(one, key, "left_semi") for t in tables]))
    members = many(marks).join(few(many(kinds), SMALL), same).select(key, "_first")
    return members.join(few(many(made.withColumnRenamed(key, "_first")), SMALL), "_first").select(key, *[c for c in made.columns if c != key])
