"""Registered end-to-end candidate execution (GR8, RW14, UD1): SQL texts run on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryforge.functions.text import after_first
from queryforge.operators.candidates import batch_reward, run_candidates
from queryforge.sources.tables import load_tables, local_frame

# --- fixed values: candidate completions for the top-customers task on the driver tables ---
_BODY = ("SELECT c.c_name AS customer_name, "
         "CAST(ROUND(SUM(CAST(l.l_quantity AS DECIMAL(18,2)) * CAST(l.l_extendedprice AS DECIMAL(18,2))), 2) AS DOUBLE) "
         "AS total_value FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey "
         "JOIN lineitem l ON o.o_orderkey = l.l_orderkey ")
CORRECT = _BODY + "GROUP BY c.c_custkey, c.c_name ORDER BY total_value DESC, c.c_custkey LIMIT 5"
COMPLETIONS = [
    (1, "Fixed SQL: " + CORRECT),
    (2, "Fixed SQL: " + _BODY + "GRUP BY c.c_custkey, c.c_name ORDER BY total_value DESC LIMIT 5"),
    (3, "Fixed SQL: " + _BODY + "GROUP BY c.c_custkey, c.c_name ORDER BY total DESC LIMIT 5"),
    (4, "Fixed SQL: DELETE FROM orders WHERE o_orderkey > 0"),
    (5, "I could not produce a query. Fixed SQL:   "),
    (6, "Fixed SQL: " + _BODY + "GROUP BY c.c_custkey, c.c_name ORDER BY total_value DESC, c.c_custkey LIMIT 4"),
    (7, "Fixed SQL: " + _BODY.replace("FROM customer c", "FROM customers c")
     + "GROUP BY c.c_custkey, c.c_name ORDER BY total_value DESC LIMIT 5"),
    (8, CORRECT),
]
VALUE_COLS = ["customer_name", "total_value"]
TASK_TABLES = ["customer", "lineitem", "orders"]


def _schema(id_name: str, text_name: str) -> T.StructType:
    return T.StructType([T.StructField(id_name, T.LongType()), T.StructField(text_name, T.StringType())])


def _register(spark, sf_dir):
    load_tables(spark, sf_dir, TASK_TABLES, register=True)


def _expected(spark):
    cand = local_frame(spark, [(0, CORRECT)], _schema("candidate_id", "sql"))
    _, rows = run_candidates(spark, cand, VALUE_COLS)
    return rows.drop("candidate_id")


from queryforge.plans.registry import register  # noqa: E402


@register("candidate_outcomes", ("GR8", "SC5"))
def candidate_outcomes(spark, sf_dir):
    """Each candidate text executed as a Spark job: success, row count and error text."""
    _register(spark, sf_dir)
    comp = local_frame(spark, COMPLETIONS, _schema("candidate_id", "text"))
    cand = comp.select("candidate_id", after_first("text").alias("sql"))
    out, _ = run_candidates(spark, cand, VALUE_COLS)
    return out.drop("execution_time_ms")


@register("candidate_rewards", ("RW14", "UD1", "GR7"))
def candidate_rewards(spark, sf_dir):
    """Completions -> extracted SQL -> executed -> graded against the computed golden rows -> step reward."""
    _register(spark, sf_dir)
    comp = local_frame(spark, COMPLETIONS, _schema("completion_id", "text"))
    return batch_reward(spark, comp, _expected(spark), VALUE_COLS, TASK_TABLES, max_steps=10).orderBy(
        F.col("completion_id"))
