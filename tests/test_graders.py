"""Grader cases of the reference suite, on the four task fixtures."""

from pyspark.sql import functions as F

from queryforge.operators import grading as G
from queryforge.sources.tasks import LITERAL_EASY_GOLDEN, fixture_tables, golden_rows


def _with_pos(df, order_col=None):
    from queryforge.operators.scan import ordinal
    d = df.withColumn("_mid", F.monotonically_increasing_id())
    return ordinal(d, ["task_key"], ["_mid"], "pos").drop("_mid")


def _grade(spark, actual_rows, expected_rows, cols, schema, names=None):
    act = spark.createDataFrame([(0, 1, i + 1, *r) for i, r in enumerate(actual_rows)],
                                f"task_key long, attempt int, pos long, {schema}")
    exp = spark.createDataFrame([(0, i + 1, *r) for i, r in enumerate(expected_rows)],
                                f"task_key long, pos long, {schema}")
    idx = spark.createDataFrame([(0, 1)], "task_key long, attempt int")
    nm = None if names is None else spark.createDataFrame([(1, names)], "attempt int, names array<string>")
    return G.grade_positional(act, exp, "task_key", ["attempt"], cols, actual_names=nm, name_key=["attempt"],
                              attempt_index=idx).collect()[0]["score"]


def test_computed_golden_easy(spark):
    rows = [tuple(r) for r in golden_rows(spark, "easy_syntax_fix").collect()]
    assert rows == [("Alice Chen", 1947.5), ("Carol White", 740.0), ("Eva Rodriguez", 497.5),
                    ("Frank Liu", 450.0), ("Bob Kumar", 440.0)]


def test_golden_scores_0999_and_literal_gets_06(spark):
    schema = "customer_name string, total_value double"
    gold = [(r[0], float(r[1])) for r in golden_rows(spark, "easy_syntax_fix").collect()]
    assert _grade(spark, gold, gold, ["customer_name", "total_value"], schema) == 0.999
    # the printed literal has a wrong third row: right rows score 3/5 against it (F1)
    assert _grade(spark, gold, LITERAL_EASY_GOLDEN, ["customer_name", "total_value"], schema) == 0.6


def test_no_rows_scores_0001(spark):
    schema = "customer_name string, total_value double"
    assert _grade(spark, [], LITERAL_EASY_GOLDEN, ["customer_name", "total_value"], schema) == 0.001


def test_count_mismatch_and_name_penalty(spark):
    schema = "customer_name string, total_value double"
    gold = LITERAL_EASY_GOLDEN
    assert _grade(spark, gold[:4], gold, ["customer_name", "total_value"], schema) == 0.4
    # names differing only by case: rows still match (normalised keys), x0.7 penalty (F3)
    s = _grade(spark, gold, gold, ["customer_name", "total_value"], schema, names=["Customer_Name", "total_value"])
    assert s == 0.7


def test_hard_golden_matches_expected(spark):
    rows = [tuple(r) for r in golden_rows(spark, "hard_multi_bug").collect()]
    assert rows == [(1, "maya_torres", "2023-01-15", "2023-01-20", 5, 2, 377.0),
                    (2, "james_osei", "2023-02-10", "2023-02-13", 3, 2, 117.0)]


def _medium(spark, rows):
    schema = "task_key long, attempt int, pos long, department_name string, headcount long, avg_salary double"
    act = spark.createDataFrame([(0, 1, i + 1, *r) for i, r in enumerate(rows)], schema)
    exp_rows = [("Engineering", 2, 98500.0), ("Legal", 0, None), ("Marketing", 1, 72000.0), ("Sales", 2, 58000.0)]
    exp = spark.createDataFrame([(0, i + 1, *r) for i, r in enumerate(exp_rows)],
                                "task_key long, pos long, department_name string, headcount long, avg_salary double")
    return G.grade_sorted_tolerant(act, exp, "task_key", ["attempt"], "department_name", "headcount",
                                   "avg_salary").collect()[0]["score"]


def test_medium_golden_and_tolerance(spark):
    gold = [tuple(r) for r in golden_rows(spark, "medium_logic_fix").collect()]
    assert gold == [("Engineering", 2, 98500.0), ("Legal", 0, None), ("Marketing", 1, 72000.0), ("Sales", 2, 58000.0)]
    assert _medium(spark, gold) == 0.999
    # unsorted input, case-blind names, null accepted as 0, within +-1.0
    assert _medium(spark, [("sales", 2, 58000.4), ("LEGAL", 0, 0.0), ("Engineering", 2, 98500.0),
                           ("Marketing", 1, 72000.0)]) == 0.999
    assert _medium(spark, [("Engineering", 2, 98500.0), ("Legal", 0, 12345.0), ("Marketing", 1, 72000.0),
                           ("Sales", 2, 58000.0)]) == 0.75
    assert _medium(spark, gold[:3]) == 0.001


def _finance(spark, rows):
    act = spark.createDataFrame([(0, 1, *r) for r in rows],
                                "task_key long, attempt int, name string, total_orders double, total_payments double")
    exp = spark.createDataFrame([(0, "Alice", 300.0, 300.0), (0, "Bob", 50.0, 50.0)],
                                "task_key long, name string, total_orders double, total_payments double")
    return G.grade_keyed_tiers(act, exp, "task_key", ["attempt"], "name",
                               ["total_orders", "total_payments"]).collect()[0]["score"]


def test_finance_tiers(spark):
    assert _finance(spark, [("Alice", 300.0, 300.0), ("Bob", 50.0, 50.0)]) == 1.0
    assert _finance(spark, [("Alice", 900.0, 900.0), ("Bob", 50.0, 50.0)]) == 0.7   # naive join (F4)
    assert _finance(spark, [("Alice", 900.0, 900.0), ("Bob", 5.0, 5.0)]) == 0.5
    assert _finance(spark, [("Alice", 300.0, 300.0)]) == 0.1


def test_fan_trap_fixture(spark):
    from queryforge.operators import relational as R
    t = fixture_tables(spark, "hard_finance_explosion")
    good = R.preaggregate_then_join(t["users"], "user_id", [
        (t["orders"], "user_id", {"total_orders": F.sum("order_amount")}),
        (t["payments"], "user_id", {"total_payments": F.sum("payment_amount")})])
    naive = R.naive_fan_totals(t["users"], "user_id", (t["orders"], "user_id", "order_amount", "total_orders"),
                               (t["payments"], "user_id", "payment_amount", "total_payments"))
    g = {r["name"]: (float(r["total_orders"]), float(r["total_payments"])) for r in good.collect()}
    n = {r["name"]: (float(r["total_orders"]), float(r["total_payments"])) for r in naive.collect()}
    assert g == {"Alice": (300.0, 300.0), "Bob": (50.0, 50.0)}
    assert n == {"Alice": (900.0, 900.0), "Bob": (50.0, 50.0)}
    # the literal naive join agrees with the pair-free computation
    lit = (t["users"].join(t["orders"], "user_id", "left").join(t["payments"], "user_id", "left")
           .groupBy("name").agg(F.sum("order_amount").alias("o"), F.sum("payment_amount").alias("p")).collect())
    assert {r["name"]: (float(r["o"]), float(r["p"])) for r in lit} == n


def test_grade_for_task_uses_declared_grader(spark):
    from queryforge.operators.grading import grade_for_task
    from queryforge.operators.scan import ordinal
    for tid, top in [("easy_syntax_fix", 0.999), ("medium_logic_fix", 0.999), ("hard_multi_bug", 0.999),
                     ("hard_finance_explosion", 1.0)]:
        gold = golden_rows(spark, tid).withColumn("_mid", F.monotonically_increasing_id())
        act = ordinal(gold.withColumn("attempt", F.lit(1)), ["attempt"], ["_mid"], "pos").drop("_mid")
        assert grade_for_task(spark, tid, act).collect()[0]["score"] == top, tid
        # only the first row submitted: always below the top score
        assert grade_for_task(spark, tid, act.where("pos = 1")).collect()[0]["score"] < top, tid


def test_attempts_without_rows_are_graded(spark):
    expected = spark.createDataFrame([(1, 1, "a", 2, 5.0), (1, 2, "b", 0, None)], "task_key long, pos long, name string, n long, v double")
    actual = spark.createDataFrame([(1, 1, 1, "a", 2, 5.0), (1, 1, 2, "b", 0, None)], "task_key long, attempt int, pos long, name string, n long, v double")
    index = spark.createDataFrame([(1, 1), (1, 2), (7, 1), (None, 3)], "task_key long, attempt int")

    def scores(df):
        return {(r["task_key"], r["attempt"]): (r["n_actual"], r["score"]) for r in df.collect()}

    assert scores(G.grade_sorted_tolerant(actual, expected, "task_key", ["attempt"], "name", "n", "v", attempt_index=index)) == {
        (1, 1): (2, 0.999), (1, 2): (0, 0.001), (7, 1): (0, 0.001), (None, 3): (0, 0.001)}
    keyed = scores(G.grade_keyed_tiers(actual.where("pos = 1"), expected, "task_key", ["attempt"], "name", ["v"], attempt_index=index))
    assert keyed == {(1, 1): (1, 0.1), (1, 2): (0, 0.0), (7, 1): (0, 0.0), (None, 3): (0, 0.0)}
    positional = scores(G.grade_positional(actual, expected, "task_key", ["attempt"], ["name", "n", "v"], attempt_index=index))
    assert positional[1, 2] == (0, 0.001) and positional[7, 1] == (0, 0.999) and positional[1, 1] == (2, 0.999)


def test_a_registered_task_is_graded_and_folded(spark):
    from queryforge.operators.episodes import fold_episodes
    from queryforge.sources.tasks import TASKS, Task, register_task, task_catalog, unregister_task

    def first_letter(actual, expected, keys, cols, grading, index):
        ok = actual.join(expected.select("pos", F.col(grading["of"]).alias("want")), "pos").where(F.col(grading["of"]).startswith(F.substring("want", 1, 1)))
        return ok.groupBy(*keys).agg(F.round(F.count(F.lit(1)) / 2, 3).alias("score")).withColumn("task_key", F.lit(0))

    task = Task("two_names", "Two names", "easy", "d", "e", "SELCT 1", "SELECT 1", "h", ("t",), max_steps=2, hint_step=2, grader=first_letter,
                grading={"of": "name"}, golden=lambda s: s.createDataFrame([("Ann",), ("Bob",)], "name string").coalesce(1))
    register_task(task)
    try:
        actual = spark.createDataFrame([(1, 1, "Al"), (1, 2, "Bo"), (2, 1, "Al"), (2, 2, "Cy")], "attempt int, pos long, name string")
        assert {r["attempt"]: r["score"] for r in G.grade_for_task(spark, "two_names", actual).collect()} == {1: 1.0, 2: 0.5}
        assert {r["task_id"]: r["grader"] for r in task_catalog(spark).collect()}["two_names"] == "first_letter"
        steps = spark.createDataFrame([(1, i, i, "two_names", "reset_query", None, None, None, None, None) for i in range(5)],
                                      "session_id long, event_id long, ts long, task_id string, action_type string, query string, table_name string, "
                                      "success boolean, error_message string, grade double")
        got = [(r["step"], r["hint_shown"], r["is_done"], r["current_query"]) for r in fold_episodes(steps, task_catalog(spark)).orderBy("step").collect()]
        assert got == [(1, None, False, "SELCT 1"), (2, "h", True, "SELCT 1")]
    finally:
        unregister_task("two_names")
    assert "two_names" not in TASKS and task_catalog(spark).count() == 4
