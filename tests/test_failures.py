"""Failure classes of result sets on small cases."""

from queryforge.operators import failures as FL

ROW = "task_key long, attempt int, name string, n long, total double"


def _classes(spark, attempts, actual, expected=((1, "a", 1, 10.0), (1, "b", 2, 20.0), (1, None, 3, None))):
    exp = spark.createDataFrame(list(expected), "task_key long, name string, n long, total double")
    act = spark.createDataFrame(actual, ROW)
    index = spark.createDataFrame(attempts, "task_key long, attempt int, sql string, error string")
    diff = FL.result_diff(act, exp, "task_key", ["attempt"], ["name"], ["n", "total"], index)
    return {r["attempt"]: (r["failure_class"], r["n_missing"], r["n_extra"], r["n_wrong"], r["n_multiplied"])
            for r in FL.failure_classes(diff, index, ["attempt", "task_key"], "sql", "error").collect()}


def test_classes(spark):
    right = [("a", 1, 10.0), ("b", 2, 20.0), (None, 3, None)]
    sets = {1: right, 2: [*right, ("a", 1, 10.0)], 3: right[:2], 4: [("a", 3, 30.0), ("b", 2, 20.0), (None, 3, None)],
            5: [("a", 3, 30.0), ("b", 2, 21.0), (None, 3, None)], 6: [("a", 1, 10.0), ("b", 2, 20.0), (None, 3, 1.0)],
            7: [], 8: [], 9: [], 10: [(" a", 1, 10.001), ("b ", 2, 20.0), (None, 3, None)]}
    attempts = [(1, i, "DROP TABLE x" if i == 8 else "SELECT 1", {7: "no such table: t", 9: "timeout"}.get(i)) for i in sets]
    got = _classes(spark, attempts, [(1, i, *r) for i, rows in sets.items() for r in rows])
    assert got == {1: ("ok", 0, 0, 0, 0), 2: ("join_logic", 0, 1, 0, 0), 3: ("join_logic", 1, 0, 0, 0), 4: ("join_logic", 0, 0, 1, 1),
                   5: ("aggregation", 0, 0, 2, 1), 6: ("aggregation", 0, 0, 1, 0), 7: ("schema_mismatch", 3, 0, 0, 0),
                   8: ("unsafe", 3, 0, 0, 0), 9: ("error", 3, 0, 0, 0), 10: ("ok", 0, 0, 0, 0)}


def test_repeated_rows_null_tasks_and_nothing_expected(spark):
    got = _classes(spark, [(None, 1, None, None), (2, 2, None, None), (2, 3, None, None)],
                   [(None, 1, "a", 1, 1.0), (None, 1, "a", 1, 2.0), (2, 2, "z", 1, 1.0)],
                   [(None, "a", 1, 1.0), (None, "a", 1, 1.0)])
    assert got == {1: ("aggregation", 0, 0, 1, 0), 2: ("join_logic", 0, 1, 0, 0), 3: ("ok", 0, 0, 0, 0)}


def test_random_multisets_equal_counters(spark):
    import random
    from collections import Counter

    rnd = random.Random(8)
    row = lambda: (rnd.choice(["a", "b", None]), rnd.choice([1, 2, None]), rnd.choice([10.0, 20.0, -0.0, None]))
    expected = [(t, *row()) for t in (1, 1, 1, 2, None, None, None) for _ in range(2)]
    actual = [(t, i, *row()) for t in (1, 2, 3, None) for i in range(8) for _ in range(rnd.randrange(4))]
    exp = spark.createDataFrame(expected, "task_key long, name string, n long, total double")
    index = spark.createDataFrame([(t, i) for t in (1, 2, 3, None) for i in range(8)], "task_key long, attempt int")
    diff = FL.result_diff(spark.createDataFrame(actual, ROW), exp, "task_key", ["attempt"], ["name"], ["n", "total"], index).collect()
    assert len(diff) == 32
    for r in diff:
        mine = [x[2:] for x in actual if x[:2] == (r["task_key"], r["attempt"])]
        right = [x[1:] for x in expected if x[0] == r["task_key"]]
        found = sum((Counter(x[0] for x in mine) & Counter(x[0] for x in right)).values())
        same = sum((Counter(mine) & Counter(right)).values())
        assert (r["n_actual"], r["n_expected"], r["n_missing"], r["n_extra"], r["n_wrong"]) == (
            len(mine), len(right), len(right) - found, len(mine) - found, found - same)


def test_attempts_meet_the_expected_rows_once(spark):
    exp = spark.createDataFrame([(1, "a", 1, 10.0), (1, "b", 2, 20.0)], "task_key long, name string, n long, total double")
    act = spark.createDataFrame([(1, 1, "a", 1, 10.0), (1, 2, "b", 2, 21.0)], ROW)
    plan = FL.result_diff(act, exp, "task_key", ["attempt"], ["name"], ["n", "total"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # by identity, and the totals of the tasks
