import numpy as np
from pyspark.sql import functions as F

from vicinage.llm import cotraining as C

LABELS = "doc_id long, quality int"


def test_held_out_accuracy(spark, medium):
    found = C.op10_quality_classifier(spark, medium).join(spark.read.parquet(f"{medium}/labels.parquet"), "doc_id").filter("held_out")
    share = found.agg(F.avg("quality")).first()[0]
    right = found.filter(F.col("predicted") == F.col("quality")).count() / found.count()
    assert right >= 0.9 and right >= max(share, 1 - share)


def test_views_teach_each_other(spark):
    """The labelled texts are all alike; only the metadata view's pseudo-labels can teach the text view."""
    plain = "the same few words in every labelled text"
    text = lambda y, k: f"quiet words number {k} " * 6 if y else f"LOUD!! ${k} #WORDS %{k} " * 6
    rows = [(k, plain, f"s{k % 2}", "en", 100) for k in range(200)] + [(k, text(k % 2, k), f"s{k % 2}", "en", 100) for k in range(1000, 2200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], LABELS)
    model = C.fit(docs, labels)
    given = {(view, label): max(n for _, v, x, n in model.handed if (v, x) == (view, label)) for view in (0, 1) for label in (0, 1)}
    assert given[1, 0] > 50 and given[1, 1] > 50
    seen = C.margins(model.weights[0], model.binned(C.text_view([text(k % 2, k).encode() for k in range(1000, 2200)])))
    assert ((seen >= 0) == (np.arange(1000, 2200) % 2 == 1)).mean() > 0.95


def test_exchange_over_documents(spark, medium):
    """Every unlabelled document is a candidate; neither view counts against itself, and both together aren't worse than one."""
    docs, labels = spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")
    model = C.fit(docs, labels)
    assert (model.joint[:-1] >= 0).all()
    last = {(view, label): n for turn, view, label, n in model.handed if turn == C.ROUNDS - 1}
    assert last[0, 0] > 0 and last[0, 1] > 0 and last[1, 0] + last[1, 1] > 0
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = C.scored(docs, model).filter(C.held_out(F.col("doc_id"))).collect()
    right = lambda name: sum((r[name] >= 0.5) == (truth[r["doc_id"]] == 1) for r in held if r["doc_id"] in truth)
    assert right("quality_score") >= max(right("text_score"), right("meta_score"))


def test_counts_equal_plain_loops(spark):
    rows = spark.createDataFrame([(1.0, [0, 3]), (0.0, [0, 2]), (1.0, [1, 3]), (None, [1, 2])], "y double, text array<int>")
    counts = C._counts(rows, "text", F.col("y"), 4)
    assert counts.tolist() == [[1, 0, 1, 0], [1, 1, 0, 2]]
    w = C.bayes(counts, 2)
    assert np.isclose(w[0], np.log(2 / 8) - np.log(2 / 6)) and np.isclose(w[-1], np.log(3 / 2))


def test_reruns_agree(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    one, two = (C.fit(d, labels) for d in (docs, docs.repartition(5)))
    assert np.allclose(one.joint, two.joint) and all(np.allclose(a, b) for a, b in zip(one.weights, two.weights, strict=True))


def test_odd_rows(spark, odd_with_null_id, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(11)] + [(None, 1), (3, None), (4, 1)], LABELS)
    model = C.fit(odd_with_null_id, labels)
    got = C.scored(odd_with_null_id, model)
    assert got.count() == odd_with_null_id.count() and set(got.columns) == set(odd_with_null_id.columns) | {"text_score", "meta_score"}
    for name in ("text_score", "meta_score", "quality_score"):
        assert got.filter(F.col(name).isNull() | F.isnan(name) | ~F.col(name).between(0, 1)).count() == 0
    assert C.scored(none, model).collect() == []
    nothing = C.fit(odd_with_null_id, spark.createDataFrame([], LABELS))
    assert {r["quality_score"] for r in C.scored(odd_with_null_id, nothing).collect()} == {0.5}
    assert C.scored(none, C.fit(none, labels)).collect() == []
