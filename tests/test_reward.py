"""Reward cases of the reference suite, as columns."""

from queryforge.operators.reward import with_step_reward


def _reward(spark, action, grade, step, max_steps, prev_best=0.001, success=True, query=None,
            tables=("customers", "order_items", "orders"), error=None):
    df = spark.createDataFrame([(action, grade, success, error, query, list(tables), step, max_steps, prev_best)],
                               "action_type string, grade_used double, query_success boolean, error_message string, "
                               "query string, tables array<string>, step int, max_steps int, prev_best double")
    return with_step_reward(df, success="query_success").collect()[0]


def test_perfect_first_submit(spark):
    r = _reward(spark, "submit_query", 0.999, 1, 10,
                query="SELECT * FROM customers JOIN orders JOIN order_items")
    assert r["reward"] == 0.999
    assert r["breakdown"] == ("correctness=0.599 + efficiency=0.200 + syntax=0.100 + schema=0.100 + "
                              "penalty=0.000 = 0.9990")


def test_reset_is_floor(spark):
    assert _reward(spark, "reset_query", 0.001, 1, 10)["reward"] == 0.001


def test_late_inspect_is_floor(spark):
    r = _reward(spark, "inspect_schema", 0.001, 8, 9)
    assert r["reward"] == 0.001 and abs(r["penalty"] - 0.03) < 1e-12


def test_error_progress_and_regression(spark):
    r = _reward(spark, "submit_query", 0.001, 2, 10, success=False, error="no such column: x",
                query="SELECT x FROM orders")
    assert r["syntax_progress"] == 0.03
    r = _reward(spark, "submit_query", 0.4, 2, 10, prev_best=0.9, query="SELECT 1")
    assert r["penalty"] == 0.05
