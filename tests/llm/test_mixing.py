from collections import defaultdict

import pytest
from compare import spark_rows, sql_rows

from vicinage.llm import mixing as X


def check(spark, folder):
    df = X.op9_mixing(spark, folder)
    assert spark_rows(df) == sql_rows(X.OP9_SQL, folder)
    return df


def test_documents_equal_sql(spark, medium):
    rows = check(spark, medium).collect()
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    taken, target = defaultdict(int), {}
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[sources[r["doc_id"]]] += r["taken"]
        target[sources[r["doc_id"]]] = r["target"]
    longest = max(r["size"] for r in rows)
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in target)


def test_a_hot_source_nulls_and_blanks_equal_sql(spark, tmp_path):
    rows = [(k, "w " * (k % 40), "hot" if k % 3 else [None, "b", "c", "é"][k // 3 % 4]) for k in range(9000)]
    rows += [(9000, None, "b"), (9001, None, "none but null"), (9002, " \t", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    check(spark, str(tmp_path))


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b", "x")], [(1, "", "x"), (2, "a", "y")]])
def test_few_rows_equal_sql(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = X.op9_mixing(spark, str(tmp_path))
    if sum(len((t or "").split()) for _, t, _ in rows):
        assert spark_rows(df) == sql_rows(X.OP9_SQL, str(tmp_path))
    else:
        assert df.count() == len(rows) and not any(r["taken"] for r in df.collect())


def test_targets_stop_at_twice_the_source(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 500)], "source string, size long")
    target = {r["source"]: r["target"] for r in X.source_targets(sized).collect()}
    # 1065 words by weights 5, 2, 1, 5: a stops at 20, then b and the null source share the rest until they stop.
    assert target["a"] == 20 and target["b"] == 200
    assert abs(sum(target.values()) - 1065) < 1e-6
    assert abs(target[None] / 5 - target["c"]) < 1e-6


def test_odd_rows(spark, odd_with_null_id, none):
    stage = X.mixing_stage(spark, odd_with_null_id, "")
    assert stage.columns == odd_with_null_id.columns
    assert stage.count() > 0 and X.mixing_stage(spark, none, "").collect() == []


def test_only_built_in_expressions(spark, small):
    plan = X.op9_mixing(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
