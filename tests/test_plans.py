"""Plan-shape properties of headline queries (read from ``explain``)."""

import contextlib
import io

from conftest import SF_SMALL

import __spark_entry__ as E


def _plan(spark, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        E.queries()[name](spark, SF_SMALL).explain("formatted")
    return buf.getvalue()


def test_episode_fold_limits_rows_before_its_shuffle(spark):
    tree = _plan(spark, "step_rewards").split("\n\n\n")[0]
    lines = tree.splitlines()
    exchanges = [i for i, l in enumerate(lines) if "Exchange" in l and "Broadcast" not in l]
    assert len(exchanges) == 1                      # one shuffle on the session key
    below = lines[exchanges[0] + 1:]
    assert any("WindowGroupLimit" in l for l in below)   # partial limit map-side
    assert "ArrowEvalPython" not in tree and "BatchEvalPython" not in tree
    assert "LocalTableScan" in tree                 # the catalog is a literal relation


def test_filters_and_columns_reach_the_scan(spark):
    p = _plan(spark, "customer_orders_1997")
    assert "GreaterThanOrEqual(o_orderdate" in p and "LessThan(o_orderdate" in p
    p = _plan(spark, "top_customers_revenue")
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double>" in p


def test_naive_fan_totals_never_join_the_children(spark):
    tree = _plan(spark, "nation_balance_naive").split("\n\n\n")[0]
    # both children are aggregated before any join: no join takes two raw child scans
    assert tree.count("HashAggregate") >= 4
    assert "CartesianProduct" not in tree and "BroadcastNestedLoopJoin" not in tree


def test_no_python_in_registered_relational_plans(spark):
    for name in ("cohort_activation", "grade_orders_positional", "sql_write_guard", "latency_stats"):
        tree = _plan(spark, name)
        assert "EvalPython" not in tree and "CartesianProduct" not in tree, name
