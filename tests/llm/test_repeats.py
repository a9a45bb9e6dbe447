import random

import numpy as np
import pytest
from brute import passages as slow
from brute import without

from vicinage.llm import repeats as R
from vicinage.llm.kernel import Words


def found(df):
    return sorted((r["doc_id"], r["start_word"], r["n_words"], r["earlier_doc_id"]) for r in df.collect())


@pytest.fixture(scope="module")
def shared(spark):
    """Documents that share passages, in two places or in many, adjacent ones and ones of their own repeated."""
    pick = random.Random(7)
    fresh = lambda n: [f"w{pick.randrange(40_000)}" for _ in range(n)]
    common = [fresh(n) for n in (49, 50, 51, 70, 130)]
    rows = []
    for k in range(120):
        own = fresh(pick.randrange(0, 80))
        for _ in range(pick.randrange(4)):
            own += pick.choice(common) + fresh(pick.choice([0, 0, 1, 30]))
        rows.append((k * 3, pick.choice([" ", "  \n"]).join(own)))
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, "a b " * 200), (1003, "a b " * 100 + "c"), (2, "a b " * 90)]
    return rows


def test_passages_equal_brute_force(spark, shared):
    docs = spark.createDataFrame(shared, "doc_id long, text string").repartition(7)
    assert found(R.repeated_passages(docs)) == slow(shared, 50)


@pytest.mark.parametrize("select", [8, 24])
def test_other_lengths(spark, shared, select):
    docs = spark.createDataFrame(shared, "doc_id long, text string")
    assert found(R.repeated_passages(docs, 30, select)) == slow(shared, 30)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert found(R.repeated_passages(docs)) == slow([tuple(r) for r in docs.select("doc_id", "text").collect()], 50)


def test_passages_are_cut_out(spark, shared):
    docs = spark.createDataFrame(shared, "doc_id long, text string")
    spans = {}
    for doc, start, n, _ in slow(shared, 50):
        spans.setdefault(doc, []).append((start, n))
    got = {r["doc_id"]: r["text"] for r in R.repeats_stage(spark, docs, "").collect()}
    assert got == {i: without(t, spans[i]) if i in spans else t for i, t in shared}


def test_kept_suffixes_are_those_of_the_content():
    text = " ".join(f"w{k}" for k in np.random.default_rng(2).integers(0, 5000, 400)).encode()
    words = Words([text, b"before it " + text], fold=False)
    window, place = R.selected(words, 50, 24)
    first, second = window < 400, window >= 402
    assert (np.unique(place[first]) + 402).tolist() == np.unique(place[second]).tolist()


def test_odd_rows(spark, odd_with_null_id, none):
    rows = sorted({(r["doc_id"], r["text"]) for r in odd_with_null_id.collect() if r["doc_id"] is not None and r["text"] is not None})
    assert found(R.repeated_passages(odd_with_null_id)) == slow(rows, 50)
    stage = R.repeats_stage(spark, odd_with_null_id, "")
    assert stage.columns == odd_with_null_id.columns and stage.count() == odd_with_null_id.count()
    assert R.repeated_passages(none).collect() == [] and R.repeats_stage(spark, none, "").collect() == []
