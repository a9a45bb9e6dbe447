from compare import spark_rows, sql_rows

from vicinage.llm import chat as C

SCHEMA = "conv_id long, turn int, role string, text string, n_turns string, place string"


def test_conversations_equal_sql(spark, medium):
    assert spark_rows(C.op8_chat(spark, medium)) == sql_rows(C.OP8_SQL, medium)


def test_odd_conversations_equal_sql(spark, tmp_path):
    talk = lambda conv, *texts: [(conv, k + 1, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    rows = [*talk(1, "a", "b"), *talk(2, "a", "b", "c"), *talk(3, "a", "b", "c"), *talk(4, "a", "x"), *talk(5, "b"), *talk(6, "a"), *talk(7, "", None, "c")]
    rows += [(8, None, None, None), (8, 1, "user", "a"), (8, 1, "user", "a"), (9, -5, "user", "a"), (9, 7, None, "b"), (None, 1, "user", "z"), *talk(10, *[f"t{k}" for k in range(3000)])]
    rows += [(11, k * 1000, "user", "s") for k in range(5)] + [(12, k, "user", "s") for k in range(9)]
    rows += [(100 + k, 1, "user", "hello") for k in range(500)]
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    found = C.op8_chat(spark, str(tmp_path))
    assert spark_rows(found) == sql_rows(C.OP8_SQL, str(tmp_path))
    kept = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in found.collect()}
    assert kept[2] == (3, 2) and not {1, 3, 6} & set(kept) and kept[100] == (1, 500) and kept[12] == (9, 1)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert C.op8_chat(spark, str(tmp_path)).collect() == []


def test_only_built_in_expressions(spark, small):
    plan = C.op8_chat(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
