"""Screening and completion parsing."""

from queryforge.functions import text as X
from queryforge.operators import screening as SC


def _one(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col("t").alias("o")).collect()[0]["o"]


def test_write_guard(spark):
    assert _one(spark, X.write_guard, "DELETE FROM customers;") == "DELETE"
    assert _one(spark, X.write_guard, "select 1 union select 2") is None
    # a newline-separated keyword escapes the reference rule, not the strict one
    assert _one(spark, X.write_guard, "SELECT 1;\nDROP TABLE x") is None
    assert _one(spark, lambda c: X.write_guard(c, strict=True), "SELECT 1;\nDROP TABLE x") == "DROP"


def test_review_rejects_delete(spark):
    df = spark.createDataFrame([("DELETE FROM customers;",), ("SELECT * FROM customers",)], "sql string")
    out = SC.review(df, "sql", ["customers", "orders"]).orderBy("sql").collect()
    assert out[0]["approved"] is False and out[0]["review_reward"] == 0.001
    assert out[1]["approved"] is True and out[1]["review_reward"] is None


def test_extract_and_parse(spark):
    assert _one(spark, X.after_first, "blah Fixed SQL:  SELECT 1 ") == "SELECT 1"
    assert _one(spark, X.after_last, "Fixed SQL: a Fixed SQL: SELECT 2") == "SELECT 2"
    assert _one(spark, X.after_first, "SELECT 3") == "SELECT 3"
    assert _one(spark, X.strip_fence, '```json\n{"action_type": "inspect_schema"}\n```') == '{"action_type": "inspect_schema"}'
    a = _one(spark, X.parse_action, 'Sure: {"action_type": "submit_query", "query": "SELECT 1"} done')
    assert a["action_type"] == "submit_query" and a["query"] == "SELECT 1"
    assert _one(spark, X.parse_action, "no json here")["action_type"] == "inspect_error"
