from brute import statistics as slow
from pyspark.sql import functions as F

from vicinage.llm import quality_rules as Q

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_statistics_equal_the_slow_ones(spark, odd_with_null_id, small):
    docs = odd_with_null_id.select("doc_id", "text").unionByName(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    for row in Q.statistics(docs).collect():
        assert tuple(row[c] for c in NAMES) == slow(row["text"]), row["doc_id"]


def test_overlapping_repeats_count_once(spark):
    docs = spark.createDataFrame([("a a a a a",), ("a b c a b c",), ("a b c d",), ("a b c x a b c d",)], "text string")
    assert [r["n_repeat_words"] for r in Q.statistics(docs).collect()] == [5, 6, 0, 6]


def test_rules_are_learned_and_applied_in_order(spark):
    rows = [(k, 0 if k % 4 == 0 else 1) for k in range(400)]
    docs = spark.createDataFrame([(k, "word " * 60 + ("#$ " * 30 if bad == 0 else "")) for k, bad in rows], "doc_id long, text string")
    rules = Q.learned(spark, docs, spark.createDataFrame(rows, "doc_id long, quality int"))
    assert rules and len(rules[0]) >= 1
    found = docs.join(Q.judged(docs, rules).select("doc_id", "rule"), "doc_id").collect()
    assert all((r["rule"] is not None) == (r["doc_id"] % 4 == 0) for r in found)


def test_no_labels_and_no_rows(spark, odd, none):
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.learned(spark, odd, nothing) == []
    one_label = spark.createDataFrame([(k, 1) for k in range(9)] + [(None, 0), (3, None)], "doc_id long, quality int")
    assert Q.learned(spark, odd, one_label) == []
    assert Q.judged(none, []).collect() == []
    judged = Q.judged(odd, [])
    assert judged.count() == odd.count() and set(judged.columns) >= set(odd.columns)


def test_rules_find_low_quality_and_keep_clean_documents(spark, medium):
    found = Q.op1_quality_rules(spark, medium).join(spark.read.parquet(f"{medium}/labels.parquet"), "doc_id")
    row = found.agg(F.avg(F.when(F.col("quality") == 1, (~F.col("rule").isNotNull()).cast("int"))).alias("clean"), F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")).alias("right")).first()
    assert row["clean"] > 0.97 and row["right"] > 0.6
    rules = Q.learned(spark, spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet"))
    assert rules and all(rules)


def test_only_built_in_expressions(spark, small):
    plan = Q.op1_quality_rules(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
