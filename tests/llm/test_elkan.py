import random
from collections import Counter

import pytest
from compare import spark_rows, sql_rows
from pyspark.sql import functions as F

from vicinage.llm import elkan as E

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v string, error string"


def slow(rows, parts, entries, rounds):
    """Plain Lloyd rounds over (vec_id, embedding, label): {vec_id: code, error, label}, and the entries."""
    width = len(rows[0][1]) // parts
    own = {i: [[int(256 * x // 1) for x in v[p * width : (p + 1) * width]] for p in range(parts)] for i, v, _ in rows}
    books = [[own[i][p] for i in sorted(own)[:entries]] for p in range(parts)]
    gap = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    for step in range(rounds + 1):
        code = {i: [min(range(len(books[p])), key=lambda e: (gap(v[p], books[p][e]), e)) for p in range(parts)] for i, v in own.items()}
        if step < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [v[p] for i, v in own.items() if code[i][p] == e]
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else books[p][e]
    return {i: ("".join(f"{e:02x}" for e in code[i]), sum(gap(own[i][p], books[p][code[i][p]]) for p in range(parts))) for i in own}, books


def test_equals_sql(spark, medium):
    assert spark_rows(E.op12_vector_codes(spark, medium)) == sql_rows(E.OP12_SQL, medium)


@pytest.mark.parametrize("span", [0.02, 3.0, 5000.0])
def test_ties_and_clusters_equal_plain_rounds(spark, span):
    """Coarse coordinates make ties; far clusters and copies make entries that go unused and that move far."""
    pick = random.Random(7)
    rows = [(3 * k, [round(pick.choice([0, 1, 1, 2, 30]) * span + pick.randrange(3) * span / 8, 3) for _ in range(8)], k % 3) for k in range(400)]
    rows += [(2000 + k, rows[5][1], 1) for k in range(100)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    single = [(i, [float(x) for x in v], y) for i, v, y in df.select("vec_id", "embedding", "label").collect()]
    coded, books = E.vector_codes(df, parts=4, entries=20, rounds=3)
    code, entries = slow(single, 4, 20, 3)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in coded.collect()} == code
    assert books.entries.tolist() == entries


def test_bounds_spare_most_distances(spark, medium):
    coded, _ = E.vector_codes(spark.read.parquet(f"{medium}/embeddings.parquet"))
    assert coded.agg(F.avg("measured")).first()[0] < 0.5 * E.PARTS * E.ENTRIES


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [k / 7 - 1] * 16, None if k % 2 else 1) for k in range(5)]
    bad = [(10, None, 1), (11, [None] * 16, 1), (12, [nan] * 16, 1), (13, [inf] * 16, None), (14, [0.5] * 3, 2), (15, [], 2)]
    twice, unnamed = (2, good[2][1], 7), (None, [0.25] * 16, None)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in [*good, *bad, twice, unnamed]], SCHEMA)
    coded, books = E.vector_codes(df)
    rows = [tuple(r) for r in coded.select("vec_id", "label").collect()]
    assert Counter(rows) == Counter([(i, y) for i, _, y in [*good, twice, unnamed]])
    assert books.entries.shape == (16, 6, 1)
    assert coded.filter("vec_id is not null and error <> 0").count() == 0 or coded.filter("error < 0").count() == 0
    huge = spark.createDataFrame([(1, [1e30, -1e30] * 8, 1, "", "", ""), (2, [-1e30, 1e30] * 8, 1, "", "", "")], SCHEMA)
    assert E.vector_codes(huge)[0].filter("error < 0").count() == 0


def test_lengths_that_parts_do_not_divide(spark):
    df = spark.createDataFrame([(k, [k / 3] * 10, k, "", "", "") for k in range(9)], SCHEMA)
    coded, books = E.vector_codes(df, parts=4, entries=3)
    assert coded.count() == 9 and books.entries.shape == (4, 3, 3) and not books.entries[3, :, 1:].any()


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    coded, books = E.vector_codes(empty)
    assert coded.collect() == [] and books.entries.size == 0


def test_query_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert E.op12_vector_codes(spark, str(tmp_path)).collect() == []
