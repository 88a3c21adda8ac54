"""Bridge views: the reference's record shapes derived from the driver tables.

Each view is a DataFrame built only from the parquet tables (so its work grows
with them) and has a DuckDB twin in ``DUCK`` written from the same rule; the
registered queries compose these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queryforge.functions import scalar as S
from queryforge.operators.scan import ordinal
from queryforge.sources.tables import read_table
from queryforge.sources.tasks import (LONGEST_EPISODE, TASK_IDS, task_catalog, task_rows)

# --- fixed values: rules of the bridge views ---
ACTION_OF_EVENT = {"purchase": "submit_query", "view": "inspect_schema", "click": "inspect_sample",
                   "error": "inspect_error", "signup": "reset_query"}
SQL_TABLES = ["part", "partsupp", "supplier", "lineitem"]
COHORT_DAYS = 7
SIGNUP_FROM, SIGNUP_TO = "2024-01-01", "2024-01-21"


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def duck_tasks_cte() -> str:
    """The task catalog as a DuckDB VALUES list (same rows as ``task_catalog``)."""
    vals = []
    for i, r in enumerate(task_rows()):
        (tid, name, diff, desc, exp, broken, fixed, max_steps, hint, hint_step, thr, tables, grader) = r
        tables_sql = "[" + ", ".join(_sql_str(t) for t in tables) + "]"
        vals.append(f"({i}, {_sql_str(tid)}, {_sql_str(diff)}, {_sql_str(desc)}, {_sql_str(exp)}, "
                    f"{_sql_str(broken)}, {max_steps}, {_sql_str(hint)}, {hint_step}, {thr}, {tables_sql}, "
                    f"{_sql_str(grader)})")
    return ("tasks AS (SELECT * FROM (VALUES " + ", ".join(vals) + ") AS t(task_no, task_id, difficulty, "
            "description, expected_output_description, broken_query, max_steps, hint, hint_step, "
            "success_threshold, tables, grader))")


def tasks_keyed(spark: SparkSession) -> DataFrame:
    return task_catalog(spark).withColumn(
        "task_no", (F.array_position(F.array(*[F.lit(t) for t in TASK_IDS]), F.col("task_id")) - 1).cast("long"))


# ---------------------------------------------------------------- steps ---
def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session steps from ``events``: session = user, one action per event.

    purchase -> submit_query (grade from value), view -> inspect_schema,
    click -> inspect_sample, error -> inspect_error, signup -> reset_query.
    A submit with value < 2 fails on an unknown table, < 5 on an unknown column.
    """
    return steps_from_events(spark, T(spark, sf_dir, "events"))


def steps_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The ``steps`` rule over any events frame (batch or streaming)."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "value")
    tasks = F.broadcast(tasks_keyed(spark).select("task_no", "task_id", "tables"))
    m = F.create_map(*[x for k, v in ACTION_OF_EVENT.items() for x in (F.lit(k), F.lit(v))])
    e = ev.withColumn("task_no", F.col("user_id") % 4).join(tasks, "task_no")
    action = m[F.col("event_type")]
    submit = action == "submit_query"
    v = F.col("value")
    err = (F.when(submit & (v < 2), F.concat(F.lit("no such table: "), F.element_at("tables", 1), F.lit("s")))
           .when(submit & (v < 5), F.lit("no such column: total")))
    dec = v.cast("decimal(18,2)") * F.lit(0.01).cast("decimal(3,2)")
    bounded = F.least(F.lit(S.MAX_SCORE).cast("decimal(4,3)"), F.greatest(F.lit(S.MIN_SCORE).cast("decimal(4,3)"), dec))
    grade = F.when(submit & (v >= 5), F.round(bounded, 3).cast("double")).when(submit, F.lit(S.MIN_SCORE))
    query = F.when(submit, F.when(v >= 50, F.concat(F.lit("SELECT * FROM "), F.array_join("tables", " JOIN ")))
                   .otherwise(F.concat(F.lit("SELECT * FROM "), F.element_at("tables", 1))))
    return e.select(
        F.col("user_id").alias("session_id"), "ts", "event_id", "task_id", action.alias("action_type"),
        query.alias("query"),
        F.when(action == "inspect_sample", F.element_at("tables", 1)).alias("table_name"),
        F.when(submit, err.isNull()).alias("success"),
        err.alias("error_message"), grade.alias("grade"))


DUCK_STEPS = f"""
{duck_tasks_cte()},
steps AS (
  SELECT e.user_id AS session_id, e.ts, e.event_id, t.task_id,
    CASE e.event_type WHEN 'purchase' THEN 'submit_query' WHEN 'view' THEN 'inspect_schema'
      WHEN 'click' THEN 'inspect_sample' WHEN 'error' THEN 'inspect_error' WHEN 'signup' THEN 'reset_query' END
      AS action_type,
    CASE WHEN e.event_type = 'purchase' THEN
      CASE WHEN e.value >= 50 THEN 'SELECT * FROM ' || array_to_string(t.tables, ' JOIN ')
           ELSE 'SELECT * FROM ' || t.tables[1] END END AS query,
    CASE WHEN e.event_type = 'click' THEN t.tables[1] END AS table_name,
    CASE WHEN e.event_type = 'purchase' THEN e.value >= 5 END AS success,
    CASE WHEN e.event_type = 'purchase' AND e.value < 2 THEN 'no such table: ' || t.tables[1] || 's'
         WHEN e.event_type = 'purchase' AND e.value < 5 THEN 'no such column: total' END AS error_message,
    CASE WHEN e.event_type = 'purchase' AND e.value >= 5 THEN
           CAST(ROUND(LEAST(0.999, GREATEST(0.001, CAST(e.value AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)))), 3) AS DOUBLE)
         WHEN e.event_type = 'purchase' THEN 0.001 END AS grade
  FROM events e JOIN tasks t ON t.task_no = e.user_id % 4)"""


# ----------------------------------------------------- cohort (hard-like) ---
def signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = T(spark, sf_dir, "events")
    return ev.where(F.col("event_type") == "signup").groupBy("user_id").agg(F.min("ts").alias("signup_ts"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = T(spark, sf_dir, "events")
    return ev.where((F.col("event_type") == "purchase") & (F.col("value") > 0)).select(
        F.col("event_id").alias("purchase_id"), "user_id", F.col("value").alias("amount"),
        F.col("ts").alias("purchase_ts"))


DUCK_COHORT_BASE = """
signups AS (SELECT user_id, MIN(ts) AS signup_ts FROM events WHERE event_type = 'signup' GROUP BY user_id),
purchases AS (SELECT event_id AS purchase_id, user_id, value AS amount, ts AS purchase_ts
              FROM events WHERE event_type = 'purchase' AND value > 0)"""


# ------------------------------------------------------------ sql_text ---
def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted texts built from ``part``: template chosen by ``p_partkey % 8``."""
    p = T(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    good = F.format_string("SELECT p_name, p_size FROM part WHERE p_name = '%s' AND p_size > %d;",
                           F.col("p_name"), F.col("p_size"))
    k = F.col("p_partkey") % 8
    text = (F.when(k == 0, good)
            .when(k == 1, F.format_string("select * from partt where p_name = '%s'", F.col("p_name")))
            .when(k == 2, F.format_string("  DELETE FROM part WHERE p_name = '%s';", F.col("p_name")))
            .when(k == 3, F.concat(F.lit("```sql\n"), good, F.lit("\n```")))
            .when(k == 4, F.format_string('{"action_type": "submit_query", "query": "SELECT p_size FROM part WHERE p_size = %d"}',
                                          F.col("p_size")))
            .when(k == 5, F.concat(F.lit("Here is the repair.\nFixed SQL: "), good))
            .when(k == 6, F.format_string("Fixed SQL: draft\nFixed SQL:\tWITH s AS (SELECT * FROM supplier)\nUPDATE part SET p_size = %d;",
                                          F.col("p_size")))
            .otherwise(F.format_string("Sorry, I cannot repair the query about %s", F.col("p_name"))))
    return p.select(F.col("p_partkey").alias("text_id"), text.alias("text"))


DUCK_SQL_TEXT = """
sql_text AS (
  SELECT p_partkey AS text_id,
    CASE p_partkey % 8
      WHEN 0 THEN printf('SELECT p_name, p_size FROM part WHERE p_name = ''%s'' AND p_size > %d;', p_name, p_size)
      WHEN 1 THEN printf('select * from partt where p_name = ''%s''', p_name)
      WHEN 2 THEN printf('  DELETE FROM part WHERE p_name = ''%s'';', p_name)
      WHEN 3 THEN '```sql' || chr(10) || printf('SELECT p_name, p_size FROM part WHERE p_name = ''%s'' AND p_size > %d;', p_name, p_size) || chr(10) || '```'
      WHEN 4 THEN printf('{"action_type": "submit_query", "query": "SELECT p_size FROM part WHERE p_size = %d"}', p_size)
      WHEN 5 THEN 'Here is the repair.' || chr(10) || 'Fixed SQL: ' || printf('SELECT p_name, p_size FROM part WHERE p_name = ''%s'' AND p_size > %d;', p_name, p_size)
      WHEN 6 THEN 'Fixed SQL: draft' || chr(10) || 'Fixed SQL:' || chr(9) || 'WITH s AS (SELECT * FROM supplier)' || chr(10) || printf('UPDATE part SET p_size = %d;', p_size)
      ELSE printf('Sorry, I cannot repair the query about %s', p_name) END AS text
  FROM part)"""


# ------------------------------------------------------------- run_log ---
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trainer-log-like rows from ``events`` with ragged metric columns."""
    ev = T(spark, sf_dir, "events")
    et, v = F.col("event_type"), F.col("value")
    return ev.select(
        F.col("event_id").alias("log_idx"),
        F.floor(F.col("event_id") / 3).cast("long").alias("step"),
        F.floor(F.col("event_id") / 3).cast("long").alias("global_step"),
        (F.col("event_id").cast("double") / F.lit(3000.0)).alias("epoch"),
        F.when(et == "purchase", (v.cast("decimal(18,2)") * F.lit(0.002).cast("decimal(4,3)")).cast("double")).alias("reward"),
        F.when(et == "view", (v.cast("decimal(18,2)") * F.lit(0.002).cast("decimal(4,3)")).cast("double")).alias("rewards/mean"),
        F.when(et == "error", (v.cast("decimal(18,2)") * F.lit(0.01).cast("decimal(3,2)")).cast("double")).alias("loss"),
        F.when(et == "click", v).alias("grad_norm"))


DUCK_RUN_LOG = """
run_log AS (
  SELECT event_id AS log_idx, CAST(floor(event_id / 3) AS BIGINT) AS step,
    CAST(floor(event_id / 3) AS BIGINT) AS global_step, CAST(event_id AS DOUBLE) / 3000.0 AS epoch,
    CASE WHEN event_type = 'purchase' THEN CAST(CAST(value AS DECIMAL(18,2)) * CAST(0.002 AS DECIMAL(4,3)) AS DOUBLE) END AS reward,
    CASE WHEN event_type = 'view' THEN CAST(CAST(value AS DECIMAL(18,2)) * CAST(0.002 AS DECIMAL(4,3)) AS DOUBLE) END AS "rewards/mean",
    CASE WHEN event_type = 'error' THEN CAST(CAST(value AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DOUBLE) END AS loss,
    CASE WHEN event_type = 'click' THEN value END AS grad_norm
  FROM events)"""


# ------------------------------------------------------------- samples ---
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before/after reward samples from ``orders``: task = priority, phase by order date.

    'before' = orders before 1997 (the 5-LOW priority is left out of it, so one
    task has no baseline); 'after' = all others.
    """
    o = T(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    phase = F.when(d < F.lit("1997-01-01"), F.lit("before")).otherwise(F.lit("after"))
    reward = F.least(F.lit(0.999).cast("decimal(4,3)"),
                     F.col("o_totalprice").cast("decimal(18,2)") * F.lit(0.000002).cast("decimal(7,6)"))
    return (o.select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("task_id"),
                     phase.alias("phase"), reward.alias("reward_dec"))
            .where(~((F.col("phase") == "before") & F.col("task_id").eqNullSafe("5-LOW"))))


DUCK_SAMPLES = """
samples AS (
  SELECT * FROM (
    SELECT o_orderkey AS sample_id, o_orderpriority AS task_id,
      CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'before' ELSE 'after' END AS phase,
      LEAST(CAST(0.999 AS DECIMAL(4,3)), CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.000002 AS DECIMAL(7,6))) AS reward_dec
    FROM orders) s
  WHERE NOT (phase = 'before' AND task_id IS NOT DISTINCT FROM '5-LOW'))"""


# ------------------------------------------------------------- latency ---
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = T(spark, sf_dir, "events")
    return ev.select("event_id", F.col("event_type").alias("endpoint"), F.col("value").alias("ms"))


# ------------------------------------------------------------ attempts ---
def _orders_by_date(spark: SparkSession, sf_dir: str, chunked: bool = True) -> DataFrame:
    o = T(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task_key"), "o_orderkey", "o_orderdate",
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
    return o, ordinal(o, ["task_key"], ["o_orderdate", "o_orderkey"], "pos", chunked=chunked).drop("o_orderdate")


def order_expected(spark: SparkSession, sf_dir: str, chunked: bool = True) -> DataFrame:
    """Expected rows per task (= customer): its orders by date, with positions."""
    return _orders_by_date(spark, sf_dir, chunked)[1]


def order_result_sets(spark: SparkSession, sf_dir: str, chunked: bool = True) -> tuple[DataFrame, DataFrame]:
    """(expected, attempts): four submitted result sets per customer task, in long form.

    1 exact; 2 drops orders before 1996 (row-count mismatch); 3 orders by price
    instead of date (positional mismatches); 4 exact rows with padded status
    text and column names in upper case (normalisation and name penalty).
    The date-ordered positions are computed once and shared by the expected
    rows and attempts 1 and 4.
    """
    o, by_date = _orders_by_date(spark, sf_dir, chunked)
    neg_price = (-F.col("amount")).alias("neg_price")
    a1 = by_date.withColumn("attempt", F.lit(1))
    a2 = ordinal(o.where(F.col("o_orderdate") >= F.lit("1996-01-01")), ["task_key"],
                 ["o_orderdate", "o_orderkey"], "pos", chunked=chunked).drop("o_orderdate").withColumn("attempt", F.lit(2))
    # price order: chunk by blocks of 1000 currency units (order-monotone, not one chunk per row)
    a3 = ordinal(o.select("*", neg_price), ["task_key"], ["neg_price", "o_orderkey"], "pos", chunked=chunked,
                 chunk=F.floor(F.col("neg_price") / F.lit(1000.0))
                 ).drop("o_orderdate", "neg_price").withColumn("attempt", F.lit(3))
    a4 = by_date.withColumn("attempt", F.lit(4)).withColumn("status", F.concat(F.lit(" "), "status", F.lit(" ")))
    cols = ["task_key", "attempt", "pos", "o_orderkey", "status", "amount"]
    attempts = a1.select(cols).unionByName(a2.select(cols)).unionByName(a3.select(cols)).unionByName(a4.select(cols))
    return by_date, attempts


def order_attempts(spark: SparkSession, sf_dir: str, chunked: bool = True) -> DataFrame:
    return order_result_sets(spark, sf_dir, chunked)[1]


def order_attempt_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names reported by each attempt (per attempt number)."""
    from pyspark.sql import types as T_
    from queryforge.sources.tables import local_frame
    rows = [(1, ["o_orderkey", "status", "amount"]), (2, ["o_orderkey", "status", "amount"]),
            (3, ["o_orderkey", "status", "amount"]), (4, ["O_ORDERKEY", "Status ", "AMOUNT"])]
    schema = T_.StructType([T_.StructField("attempt", T_.IntegerType()),
                            T_.StructField("names", T_.ArrayType(T_.StringType()))])
    return local_frame(spark, rows, schema)


DUCK_ORDER_ATTEMPTS = """
o AS (SELECT o_custkey AS task_key, o_orderkey, o_orderdate, o_orderstatus AS status, o_totalprice AS amount FROM orders),
expected AS (SELECT task_key, o_orderkey, status, amount,
               row_number() OVER (PARTITION BY task_key ORDER BY o_orderdate, o_orderkey) AS pos FROM o),
a1 AS (SELECT task_key, 1 AS attempt, pos, o_orderkey, status, amount FROM expected),
a2 AS (SELECT task_key, 2 AS attempt, row_number() OVER (PARTITION BY task_key ORDER BY o_orderdate, o_orderkey) AS pos,
              o_orderkey, status, amount FROM o WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
a3 AS (SELECT task_key, 3 AS attempt, row_number() OVER (PARTITION BY task_key ORDER BY -amount, o_orderkey) AS pos,
              o_orderkey, status, amount FROM o),
a4 AS (SELECT task_key, 4 AS attempt, pos, o_orderkey, ' ' || status || ' ' AS status, amount FROM expected),
actual AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3 UNION ALL SELECT * FROM a4),
names AS (SELECT * FROM (VALUES (1, false), (2, false), (3, false), (4, true)) AS t(attempt, names_differ))"""


# --------------------------------------------------- finance-like views ---
def nation_children(spark: SparkSession, sf_dir: str):
    n = T(spark, sf_dir, "nation")
    c = T(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    s = T(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal")
    return n, c, s
