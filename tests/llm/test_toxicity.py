import numpy as np
from pyspark.sql import functions as F

from vicinage.llm import toxicity as T


def test_score_is_the_factorization_machine(spark):
    texts = [b"alpha beta gamma", b"", b"delta alphabetical"]
    machine = T.Machine(slots=256)
    machine.w = np.random.default_rng(1).normal(size=256)
    slot, of = T.terms(texts, 256)
    for k, score in enumerate(machine.scores(texts)):
        own = slot[of == k]
        margin = machine.bias[0] + machine.w[own].sum()
        margin += sum(machine.v[i] @ machine.v[j] for x, i in enumerate(own) for j in own[x + 1 :])
        assert abs(score - 1 / (1 + np.exp(-margin))) < 1e-9


def test_pairs_count_more_than_their_sum(spark):
    """Two words that are harmless each, and harmful together."""
    fillers = ["tree house river stone", "paper cloud window light", "garden bread music road"]
    rows = [(f"{fillers[k % 3]} {' '.join(w for w, on in (('zork', k & 4), ('group', k & 8)) if on)}", float(bool(k & 4 and k & 8))) for k in range(800)]
    machine = T.fit(spark.createDataFrame(rows, "text string, label double"))
    both, one, other, no = machine.scores([b"tree zork group", b"tree zork", b"tree group", b"tree house"])
    assert both > 0.5 > max(one, other, no)


def test_pairs_count_where_no_term_alone_goes_with_the_label(spark):
    """Each of the two words is in as many toxic as clean texts; both together, or none of them, are toxic."""
    fillers = ["tree house river stone", "paper cloud window light", "garden bread music road"]
    rows = [(f"{fillers[k // 16 % 3]} {' '.join(w for w, on in (('zork', k & 4), ('group', k & 8)) if on)}", float(bool(k & 4) == bool(k & 8))) for k in range(768)]
    slot, of = T.terms([text.encode() for text, _ in rows])
    labels = np.array([label for _, label in rows])
    assert not T.telling(slot, of, labels, T.SLOTS).any()
    machine = T.fit(spark.createDataFrame(rows, "text string, label double"))
    both, one, other, no = machine.scores([b"tree zork group", b"tree zork", b"tree group", b"tree house"])
    assert min(both, no) > 0.5 > max(one, other)


def test_held_out_accuracy(spark, medium):
    found = T.op2_toxicity(spark, medium).join(spark.read.parquet(f"{medium}/labels.parquet"), "doc_id").filter("held_out")
    assert found.filter((F.col("predicted") == F.col("toxic"))).count() >= 0.95 * found.count()


def test_held_out_rows_teach_nothing(spark, medium, tmp_path):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    turned.write.parquet(f"{tmp_path}/labels.parquet")
    one, two = T.trained(spark, docs, medium), T.trained(spark, docs, str(tmp_path))
    assert one.dumped() == two.dumped()


def test_odd_rows(spark, odd_with_null_id, none, small):
    machine = T.trained(spark, odd_with_null_id, small)
    scored = T.score(odd_with_null_id, machine)
    assert scored.count() == odd_with_null_id.count() and set(scored.columns) == set(odd_with_null_id.columns)
    assert scored.filter(F.col("toxicity").isNull() | ~F.col("toxicity").between(0, 1)).count() == 0
    assert T.score(none, machine).collect() == []
    empty = T.fit(spark.createDataFrame([], "text string, label double"))
    assert max(empty.scores([b"some words", b""])) < 0.01
    stage = T.toxicity_stage(spark, odd_with_null_id, small)
    assert stage.columns == odd_with_null_id.columns
    assert T.toxicity_stage(spark, none, small).collect() == []
