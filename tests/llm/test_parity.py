import random

import numpy as np
import pytest
from brute import components as slow
from compare import spark_rows, sql_rows
from pyspark.sql import functions as F

from vicinage.llm import near_dup
from vicinage.llm import parity as P
from vicinage.llm.kernel import series


def found(df):
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("query, sql", [(P.op11_jaccard_join, P.OP11_SQL), (near_dup.op5_near_dup, P.OP5_SQL)])
def test_equals_sql(spark, small, query, sql):
    assert spark_rows(query(spark, small)) == sql_rows(sql, small)


@pytest.mark.parametrize("size", [4, 9, 20, 60, 400])
def test_linked_sets_share_the_lists_they_need(size):
    """Sets as far apart as the similarity allows meet in as many lists as either of them needs, whatever the hashes."""
    bands = P.Bands(80)
    for seed in range(60):
        own = series(3 * size, seed + 100)
        common = -(-8 * size // 9)  # two sets of this size, 80 percent of their union in common
        sets = [own[:size], np.concatenate([own[:common], own[size : 2 * size - common]])]
        assert 100 * common >= 80 * (2 * size - common)
        lists = [dict(zip(*map(np.ndarray.tolist, (names, need)), strict=True)) for names, _, need in (bands.lists(s, np.array([size])) for s in sets)]
        shared = set(lists[0]) & set(lists[1])
        in_band = {n for n in shared if n % P.BAND == bands.of(np.array([size]))[0]}
        assert len(in_band) >= max(max(own[n] for n in in_band) for own in lists)


def test_bits_bound_the_difference():
    own = series(300, 5)
    for gone in (0, 3, 40, 200):
        bits = [np.bincount((P.mixed(s ^ P.U(0x9FB21C651E98DF25)) % P.U(P.BITS)).astype(np.int64), minlength=P.BITS) % 2 for s in (own, own[gone:])]
        assert (bits[0] != bits[1]).sum() <= gone


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_families_of_edited_copies(spark, percent):
    """Chains and stars of all lengths, around the limit of the similarity."""
    pick, rows, i = random.Random(percent), [], 0
    for _ in range(24):
        text = [f"w{pick.randrange(900)}" for _ in range(pick.choice([2, 6, 9, 13, 30, 90, 200, 700]))]
        for _ in range(10):
            rows.append((i, " ".join(text)))
            i += 1
            if pick.random() < 0.7:
                for _ in range(max(1, len(text) // 60)):
                    text[pick.randrange(len(text))] = f"v{pick.randrange(900)}"
                text += [f"u{pick.randrange(900)}"] * pick.randrange(3)
    pick.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(P.jaccard_join(docs, 4, percent)) == slow(rows, 4, percent)


def test_odd_rows(spark, odd_with_null_id, none):
    rows = [tuple(r) for r in odd_with_null_id.filter("doc_id is not null").select("doc_id", "text").distinct().collect()]
    every = P.jaccard_join(odd_with_null_id)
    assert every.count() == odd_with_null_id.count()
    assert found(every.filter("id is not null")) == slow(rows, 5)
    assert [r[0] for r in every.filter("id is null").select("component_id").collect()] == [None]
    assert P.jaccard_join(none).collect() == []


def test_copies_are_not_paired(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three four five six").alias("text"))
    assert P.jaccard_join(docs).filter("component_id <> 0").count() == 0


def test_lists_of_one_class_go(spark):
    rows = [(1, 5), (1, 5), (2, 5), (2, 6), (3, 7), (4, 1), (4, 2), (4, 2), (4, 3)]
    got = sorted(map(tuple, P.shared(spark.createDataFrame(rows, "list long, class long")).collect()))
    assert got == [(2, 5), (2, 6), (4, 1), (4, 2), (4, 3)]
