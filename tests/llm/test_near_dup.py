import random

import pytest
from brute import components as slow
from pyspark.sql import functions as F

from vicinage.llm import near_dup as N
from vicinage.llm.components import connected


def found(df):
    return {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def expected(docs, width):
    return {i: (n, c, i == c) for i, (n, c) in slow(docs, width).items()}


@pytest.mark.parametrize("width", [4, 5])
def test_documents_equal_brute_force(spark, small, width):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert found(N.near_duplicates(docs, width)) == expected([tuple(r) for r in docs.select("doc_id", "text").collect()], width)


def test_families_of_edited_copies(spark):
    """Chains, in which ends are linked only over others, and stars around one text."""
    pick = random.Random(5)
    rows, i = [], 0
    for _ in range(12):
        text = [f"w{pick.randrange(900)}" for _ in range(pick.choice([6, 30, 90, 200]))]
        for _ in range(14):
            rows.append((i, " ".join(text)))
            i += 1
            if pick.random() < 0.7:
                for _ in range(max(1, len(text) // 40)):
                    text[pick.randrange(len(text))] = f"v{pick.randrange(900)}"
    pick.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(N.near_duplicates(docs, 4)) == expected(rows, 4)


def test_odd_rows(spark, odd_with_null_id, none, small):
    docs = odd_with_null_id.filter("doc_id is not null").select("doc_id", "text").distinct()
    rows = [tuple(r) for r in docs.collect()]
    every = N.near_duplicates(odd_with_null_id)
    assert every.count() == odd_with_null_id.count()
    assert found(every.filter("id is not null")) == expected(rows, 5)
    assert [tuple(r) for r in every.filter("id is null").select("component_id", "kept").collect()] == [(None, False)]
    assert N.near_duplicates(none).collect() == []
    stage = N.near_dup_stage(spark, odd_with_null_id, small)
    assert stage.columns == odd_with_null_id.columns
    assert stage.filter("doc_id = 50").count() == 0 and stage.filter("doc_id is null").count() == 1
    assert N.near_dup_stage(spark, none, small).collect() == []


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (300, 250)]
    got = {(r["node"], r["root"]) for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(k, 0) for k in range(41)} | {(100, 100), (101, 100), (200, 200), (250, 200), (300, 200)}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_copies_are_not_paired(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three four five six").alias("text"))
    assert N.near_duplicates(docs).filter("component_id <> 0").count() == 0


def test_crowded_lists(spark, monkeypatch):
    """With all lists taken for crowded ones, pairs across components come from the residual join alone."""
    monkeypatch.setattr(N, "SHORT", 1)
    test_families_of_edited_copies(spark)
