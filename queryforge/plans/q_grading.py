"""Registered grading queries (GR1-GR7, JN9-JN12, ST3) on attempt tables derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryforge.functions import scalar as S
from queryforge.operators import failures as FL
from queryforge.operators import grading as G
from queryforge.operators import relational as R
from queryforge.plans import views as V
from queryforge.plans.registry import register
from queryforge.operators.scan import ordinal
from queryforge.sources.tasks import Task, register_task, task_catalog, unregister_task

ORDER_COLS = ["o_orderkey", "status", "amount"]


# ------------------------------------------------------------- GR1-GR3 ---
def positional_scores(spark, sf_dir):
    exp, act = V.order_result_sets(spark, sf_dir)
    return G.grade_positional(act, exp, "task_key", ["attempt"], ORDER_COLS,
                              actual_names=V.order_attempt_names(spark, sf_dir), name_key=["attempt"])


_DUCK_POSITIONAL = f"""
{V.DUCK_ORDER_ATTEMPTS},
m AS (SELECT a.task_key, a.attempt,
        COUNT_IF(a.o_orderkey IS NOT DISTINCT FROM e.o_orderkey AND trim(a.status) IS NOT DISTINCT FROM trim(e.status)
                 AND CAST(printf('%.2f', a.amount) AS DOUBLE) IS NOT DISTINCT FROM CAST(printf('%.2f', e.amount) AS DOUBLE)) AS matches
      FROM actual a JOIN expected e ON a.task_key = e.task_key AND a.pos = e.pos GROUP BY a.task_key, a.attempt),
na AS (SELECT task_key, attempt, COUNT(*) AS n_actual FROM actual GROUP BY task_key, attempt),
ne AS (SELECT task_key, COUNT(*) AS n_expected FROM expected GROUP BY task_key),
g AS (SELECT na.task_key, na.attempt, na.n_actual, COALESCE(ne.n_expected, 0) AS n_expected,
             COALESCE(m.matches, 0) AS matches, NOT names.names_differ AS names_match
      FROM na LEFT JOIN m ON m.task_key = na.task_key AND m.attempt = na.attempt
      LEFT JOIN ne ON ne.task_key = na.task_key JOIN names ON names.attempt = na.attempt),
pos_scores AS (SELECT task_key, attempt, n_actual, n_expected, matches, names_match,
  CAST(printf('%.3f', LEAST(9.99e-1, GREATEST(1e-3,
    CASE WHEN n_actual = 0 THEN (CASE WHEN n_expected = 0 THEN 1e0 ELSE 0e0 END)
         WHEN n_expected = 0 THEN 0e0
         WHEN n_actual <> n_expected THEN LEAST(5e-1, CAST(matches AS DOUBLE) / CAST(GREATEST(n_expected, 1) AS DOUBLE) * 5e-1)
         ELSE CAST(matches AS DOUBLE) / CAST(GREATEST(n_expected, 1) AS DOUBLE) * (CASE WHEN names_match THEN 1e0 ELSE 7e-1 END)
    END))) AS DOUBLE) AS score FROM g)"""


@register("grade_orders_positional", ("GR1", "GR2", "GR3", "JN9", "ST3", "SF9", "SF11"), sql=f"""
WITH {_DUCK_POSITIONAL}
SELECT * FROM pos_scores""")
def grade_orders_positional(spark, sf_dir):
    """Four attempts per customer task graded positionally against the customer's orders by date."""
    return positional_scores(spark, sf_dir)


# ------------------------------------------------------------------ GR4 ---
def nation_result_sets(spark, sf_dir):
    """Expected (per nation: customers with 1997 count and average) and four attempts."""
    c = V.T(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    o = V.T(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    in97 = S.year_range("o_orderdate", 1997)
    # child aggregated per customer first, then one left join row per customer
    per = o.groupBy("o_custkey").agg(
        F.count_if(in97).alias("n97"),
        F.round(F.avg(F.when(in97, S.money("o_totalprice"))), 2).cast("double").alias("avg97"),
        F.round(F.avg(S.money("o_totalprice")), 2).cast("double").alias("avg_all"))
    st = c.join(per, c["c_custkey"] == per["o_custkey"], "left").select(
        "c_nationkey", "c_custkey", "c_name", F.coalesce("n97", F.lit(0)).alias("n97"), "avg97", "avg_all")
    base = st.select(F.col("c_nationkey").cast("long").alias("task_key"), F.col("c_custkey").alias("pos"),
                     F.col("c_name").alias("customer_name"), F.col("n97").alias("headcount"),
                     F.col("avg97").alias("avg_price"), "avg_all")
    expected = base.drop("avg_all")
    a1 = base.select("task_key", F.lit(1).alias("attempt"), "pos", F.upper("customer_name").alias("customer_name"),
                     "headcount", "avg_price")
    a2 = base.where(F.col("headcount") > 0).select("task_key", F.lit(2).alias("attempt"), "pos", "customer_name",
                                                    "headcount", "avg_price")
    a3 = base.select("task_key", F.lit(3).alias("attempt"), "pos", "customer_name", "headcount",
                     F.col("avg_all").alias("avg_price"))
    a4 = base.select("task_key", F.lit(4).alias("attempt"), "pos", "customer_name", "headcount",
                     F.coalesce(F.col("avg_price") + F.lit(0.5), F.lit(0.0)).alias("avg_price"))
    return expected, a1.unionByName(a2).unionByName(a3).unionByName(a4)


def attempts_of(spark, sf_dir, table, key, n):
    """Attempts 1..n+1 of every task: the last one returned no row."""
    return V.T(spark, sf_dir, table).select(F.col(key).cast("long").alias("task_key"), F.explode(
        F.array(*[F.lit(i) for i in range(1, n + 2)])).alias("attempt"))


_DUCK_NATION_SETS = """
st AS (SELECT c.c_nationkey, c.c_custkey, c.c_name,
         COUNT_IF(o.o_orderdate >= TIMESTAMP '1997-01-01' AND o.o_orderdate < TIMESTAMP '1998-01-01') AS n97,
         CAST(ROUND(CAST(AVG(CASE WHEN o.o_orderdate >= TIMESTAMP '1997-01-01' AND o.o_orderdate < TIMESTAMP '1998-01-01'
                          THEN CAST(o.o_totalprice AS DECIMAL(18,2)) END) AS DECIMAL(38,8)), 2) AS DOUBLE) AS avg97,
         CAST(ROUND(CAST(AVG(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,8)), 2) AS DOUBLE) AS avg_all
       FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
       GROUP BY c.c_nationkey, c.c_custkey, c.c_name),
base AS (SELECT CAST(c_nationkey AS BIGINT) AS task_key, c_custkey AS pos, c_name AS customer_name, n97 AS headcount,
                avg97 AS avg_price, avg_all FROM st),
nat_exp AS (SELECT task_key, pos, customer_name, headcount, avg_price FROM base),
nat_act AS (
  SELECT task_key, 1 AS attempt, pos, upper(customer_name) AS customer_name, headcount, avg_price FROM base
  UNION ALL SELECT task_key, 2, pos, customer_name, headcount, avg_price FROM base WHERE headcount > 0
  UNION ALL SELECT task_key, 3, pos, customer_name, headcount, avg_all FROM base
  UNION ALL SELECT task_key, 4, pos, customer_name, headcount, COALESCE(avg_price + 5e-1, 0e0) FROM base),
ea AS (SELECT *, row_number() OVER (PARTITION BY task_key, attempt ORDER BY customer_name, pos) AS spos FROM nat_act),
ee AS (SELECT *, row_number() OVER (PARTITION BY task_key ORDER BY customer_name, pos) AS spos FROM nat_exp),
nm AS (SELECT ea.task_key, ea.attempt, COUNT_IF(lower(ea.customer_name) = lower(ee.customer_name)
          AND ea.headcount = ee.headcount
          AND CASE WHEN ee.avg_price IS NULL THEN (ea.avg_price IS NULL OR ea.avg_price = 0)
                   ELSE COALESCE(abs(ea.avg_price - ee.avg_price) < 1e0, false) END) AS matches
       FROM ea JOIN ee ON ea.task_key = ee.task_key AND ea.spos = ee.spos GROUP BY ea.task_key, ea.attempt),
nna AS (SELECT i.task_key, i.attempt, COUNT(a.task_key) AS n_actual
        FROM (SELECT CAST(n_nationkey AS BIGINT) AS task_key, CAST(unnest(range(1, 6)) AS INTEGER) AS attempt FROM nation) i
        LEFT JOIN nat_act a ON a.task_key = i.task_key AND a.attempt = i.attempt GROUP BY i.task_key, i.attempt),
nne AS (SELECT task_key, COUNT(*) AS n_expected FROM nat_exp GROUP BY task_key),
sorted_scores AS (
  SELECT nna.task_key, nna.attempt, nna.n_actual, COALESCE(nne.n_expected, 0) AS n_expected,
         COALESCE(nm.matches, 0) AS matches,
         CAST(printf('%.3f', LEAST(9.99e-1, GREATEST(1e-3,
           CASE WHEN nna.n_actual = 0 OR nna.n_actual <> COALESCE(nne.n_expected, 0) THEN 0e0
                ELSE CAST(COALESCE(nm.matches, 0) AS DOUBLE) / CAST(nne.n_expected AS DOUBLE) END))) AS DOUBLE) AS score
  FROM nna LEFT JOIN nm ON nm.task_key = nna.task_key AND nm.attempt = nna.attempt
  LEFT JOIN nne ON nne.task_key = nna.task_key)"""


def sorted_scores(spark, sf_dir):
    exp, act = nation_result_sets(spark, sf_dir)
    # names all share the 'Customer#' prefix: chunk the sort on the longer, still order-monotone prefix
    return G.grade_sorted_tolerant(act, exp, "task_key", ["attempt"], "customer_name", "headcount", "avg_price",
                                   chunk=F.substring(F.col("_k"), 1, 14), attempt_index=attempts_of(spark, sf_dir, "nation", "n_nationkey", 4))


@register("grade_nations_sorted", ("GR4", "JN10", "SF24"), sql=f"""
WITH {_DUCK_NATION_SETS}
SELECT * FROM sorted_scores""")
def grade_nations_sorted(spark, sf_dir):
    """Sorted-pair tolerant grading of per-nation customer reports (exact count required); attempt 5 returned no row."""
    return sorted_scores(spark, sf_dir)


# ------------------------------------------------------------------ GR5 ---
def region_result_sets(spark, sf_dir):
    n, c, s = V.nation_children(spark, sf_dir)
    n = n.select("n_nationkey", "n_name", "n_regionkey")
    exp = R.preaggregate_then_join(n, "n_nationkey", [
        (c, "c_nationkey", {"total_customer_bal": F.sum(S.money("c_acctbal"))}),
        (s, "s_nationkey", {"total_supplier_bal": F.sum(S.money("s_acctbal"))})])
    naive = R.naive_fan_totals(n, "n_nationkey", (c, "c_nationkey", "c_acctbal", "total_customer_bal"),
                               (s, "s_nationkey", "s_acctbal", "total_supplier_bal"))
    positive = R.preaggregate_then_join(n, "n_nationkey", [
        (c.where(F.col("c_acctbal") > 0), "c_nationkey", {"total_customer_bal": F.sum(S.money("c_acctbal"))}),
        (s, "s_nationkey", {"total_supplier_bal": F.sum(S.money("s_acctbal"))})])

    def shape(df, attempt=None, name=F.col("n_name")):
        cols = [F.col("n_regionkey").cast("long").alias("task_key"), name.alias("n_name"),
                F.col("total_customer_bal").cast("double").alias("total_customer_bal"),
                F.col("total_supplier_bal").cast("double").alias("total_supplier_bal")]
        if attempt is not None:
            cols.insert(1, F.lit(attempt).alias("attempt"))
        return df.select(*cols)

    expected = shape(exp)
    actual = (shape(exp, 1).unionByName(shape(naive, 2)).unionByName(shape(positive, 3))
              .unionByName(shape(exp, 4, F.lower("n_name"))))
    return expected, actual


_DUCK_REGION_SETS = """
c AS (SELECT c_nationkey, SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS s, COUNT(*) AS n FROM customer GROUP BY c_nationkey),
cp AS (SELECT c_nationkey, SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS s FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey),
s AS (SELECT s_nationkey, SUM(CAST(s_acctbal AS DECIMAL(18,2))) AS s, COUNT(*) AS n FROM supplier GROUP BY s_nationkey),
reg_exp AS (SELECT CAST(n.n_regionkey AS BIGINT) AS task_key, n.n_name, CAST(c.s AS DOUBLE) AS total_customer_bal,
              CAST(s.s AS DOUBLE) AS total_supplier_bal
            FROM nation n LEFT JOIN c ON c.c_nationkey = n.n_nationkey LEFT JOIN s ON s.s_nationkey = n.n_nationkey),
naive AS (SELECT CAST(n.n_regionkey AS BIGINT) AS task_key, n.n_name,
            CAST(SUM(CAST(cc.c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total_customer_bal,
            CAST(SUM(CAST(ss.s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total_supplier_bal
          FROM nation n LEFT JOIN customer cc ON cc.c_nationkey = n.n_nationkey
          LEFT JOIN supplier ss ON ss.s_nationkey = n.n_nationkey GROUP BY n.n_regionkey, n.n_nationkey, n.n_name),
posit AS (SELECT CAST(n.n_regionkey AS BIGINT) AS task_key, n.n_name, CAST(cp.s AS DOUBLE) AS total_customer_bal,
            CAST(s.s AS DOUBLE) AS total_supplier_bal
          FROM nation n LEFT JOIN cp ON cp.c_nationkey = n.n_nationkey LEFT JOIN s ON s.s_nationkey = n.n_nationkey),
reg_act AS (SELECT task_key, 1 AS attempt, n_name, total_customer_bal, total_supplier_bal FROM reg_exp
            UNION ALL SELECT task_key, 2, n_name, total_customer_bal, total_supplier_bal FROM naive
            UNION ALL SELECT task_key, 3, n_name, total_customer_bal, total_supplier_bal FROM posit
            UNION ALL SELECT task_key, 4, lower(n_name), total_customer_bal, total_supplier_bal FROM reg_exp),
rj AS (SELECT a.task_key, a.attempt, COALESCE(a.total_customer_bal, 0e0) AS a1, COALESCE(a.total_supplier_bal, 0e0) AS a2,
              e.total_customer_bal AS e1, e.total_supplier_bal AS e2
       FROM reg_act a LEFT JOIN reg_exp e ON a.task_key = e.task_key AND a.n_name = e.n_name),
rper AS (SELECT i.task_key, i.attempt, COUNT(rj.task_key) AS n_actual,
           COUNT_IF((e1 IS NOT NULL OR e2 IS NOT NULL) AND a1 = COALESCE(e1, 0e0) AND a2 = COALESCE(e2, 0e0)) AS correct
         FROM (SELECT CAST(r_regionkey AS BIGINT) AS task_key, CAST(unnest(range(1, 6)) AS INTEGER) AS attempt FROM region) i
         LEFT JOIN rj ON rj.task_key = i.task_key AND rj.attempt = i.attempt GROUP BY i.task_key, i.attempt),
rne AS (SELECT task_key, COUNT(*) AS n_expected FROM reg_exp GROUP BY task_key),
keyed_scores AS (
  SELECT rper.task_key, rper.attempt, rper.n_actual, COALESCE(rne.n_expected, 0) AS n_expected, rper.correct,
    CASE WHEN rper.n_actual = 0 THEN 0e0 WHEN rper.n_actual <> COALESCE(rne.n_expected, 0) THEN 1e-1
         WHEN rper.correct = rne.n_expected THEN 1e0 WHEN rper.correct = 1 THEN 7e-1 ELSE 5e-1 END AS score
  FROM rper LEFT JOIN rne ON rne.task_key = rper.task_key)"""


def keyed_scores(spark, sf_dir):
    exp, act = region_result_sets(spark, sf_dir)
    return G.grade_keyed_tiers(act, exp, "task_key", ["attempt"], "n_name",
                               ["total_customer_bal", "total_supplier_bal"],
                               attempt_index=attempts_of(spark, sf_dir, "region", "r_regionkey", 4))


@register("grade_regions_keyed", ("GR5", "JN11", "SF8"), sql=f"""
WITH {_DUCK_REGION_SETS}
SELECT * FROM keyed_scores""")
def grade_regions_keyed(spark, sf_dir):
    """Keyed tier grading of per-region fan-trap reports: correct, naive, filtered, renamed and empty attempts."""
    return keyed_scores(spark, sf_dir)


# ------------------------------------------------------------------ GR6 ---
@register("grade_dispatch", ("GR6", "GR7", "JN12", "UD2"), sql=f"""
WITH {V.duck_tasks_cte()}, {_DUCK_POSITIONAL}, {_DUCK_NATION_SETS}, {_DUCK_REGION_SETS},
allg AS (SELECT 'positional' AS grader, task_key, attempt, score FROM pos_scores
         UNION ALL SELECT 'sorted_tolerant', task_key, attempt, score FROM sorted_scores
         UNION ALL SELECT 'keyed_tiers', task_key, attempt, score FROM keyed_scores)
SELECT t.task_id, allg.grader, allg.task_key, allg.attempt, allg.score
FROM allg JOIN (SELECT grader, MIN(task_id) AS task_id FROM tasks GROUP BY grader) t ON t.grader = allg.grader""")
def grade_dispatch(spark, sf_dir):
    """Each attempt set graded by the grader its task declares (catalog lookup, broadcast)."""
    parts = [
        positional_scores(spark, sf_dir).select(F.lit("positional").alias("grader"), "task_key", "attempt", "score"),
        sorted_scores(spark, sf_dir).select(F.lit("sorted_tolerant").alias("grader"), "task_key", "attempt", "score"),
        keyed_scores(spark, sf_dir).select(F.lit("keyed_tiers").alias("grader"), "task_key", "attempt", "score"),
    ]
    allg = parts[0].unionByName(parts[1]).unionByName(parts[2])
    by_grader = task_catalog(spark).groupBy("grader").agg(F.min("task_id").alias("task_id"))
    return G.with_task(allg, by_grader, key="grader", cols=["task_id"]).select(
        "task_id", "grader", "task_key", "attempt", "score")


@register("task_lookup_misses", ("JN12",), sql=f"""
WITH {V.duck_tasks_cte()},
refs AS (SELECT DISTINCT user_id AS session_id, user_id % 5 AS task_no FROM events)
SELECT r.session_id, r.task_no FROM refs r WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.task_no = r.task_no)""")
def task_lookup_misses(spark, sf_dir):
    """Sessions whose task number (user % 5) has no catalog entry: a left-anti join on the broadcast catalog."""
    refs = V.T(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"),
                                               (F.col("user_id") % 5).alias("task_no")).distinct()
    return G.unknown_tasks(refs, V.tasks_keyed(spark), key="task_no")


# ------------------------------------------------------------------ SC6 ---
def failing_attempts(spark, sf_dir):
    """(expected, actual, attempts): the order attempts and four more of each customer: 5 repeats the finished orders, 6 doubles
    all amounts, 7 adds 1 to them, 8 and 9 return nothing: one wanted to delete, the other named an unknown column."""
    exp, act = V.order_result_sets(spark, sf_dir)
    rows = exp.select("task_key", "o_orderkey", "status", "amount")
    more = [rows.unionByName(rows.where(F.col("status") == "F")).withColumn("attempt", F.lit(5)),
            rows.withColumns({"attempt": F.lit(6), "amount": F.col("amount") * 2}),
            rows.withColumns({"attempt": F.lit(7), "amount": F.col("amount") + 1})]
    cols = ["task_key", "attempt", *ORDER_COLS]
    act = act.select(cols)
    for part in more:
        act = act.unionByName(part.select(cols))
    attempts = exp.select("task_key").distinct().select("task_key", F.explode(F.array(*[F.lit(i) for i in range(1, 10)])).alias("attempt"))
    attempts = attempts.withColumns({
        "sql": F.when(F.col("attempt") == 8, F.lit("DELETE FROM orders")).otherwise(F.lit("SELECT o_orderkey, status, amount FROM orders")),
        "error": F.when(F.col("attempt") == 9, F.lit("no such column: total"))})
    return rows, act, attempts


@register("result_failure_classes", ("SC6",), sql=f"""
WITH {V.DUCK_ORDER_ATTEMPTS},
ex AS (SELECT task_key, o_orderkey, trim(status) AS status, CAST(printf('%.2f', amount) AS DOUBLE) AS amount FROM expected),
ac AS (SELECT task_key, attempt, o_orderkey, trim(status) AS status, CAST(printf('%.2f', amount) AS DOUBLE) AS amount FROM actual
       UNION ALL SELECT task_key, 5, o_orderkey, status, amount FROM ex
       UNION ALL SELECT task_key, 5, o_orderkey, status, amount FROM ex WHERE status = 'F'
       UNION ALL SELECT task_key, 6, o_orderkey, status, CAST(printf('%.2f', amount * 2) AS DOUBLE) FROM ex
       UNION ALL SELECT task_key, 7, o_orderkey, status, CAST(printf('%.2f', amount + 1) AS DOUBLE) FROM ex),
i AS (SELECT DISTINCT task_key, CAST(unnest(range(1, 10)) AS INTEGER) AS attempt FROM ex),
m AS (SELECT ac.task_key, ac.attempt, ac.o_orderkey, COUNT(*) AS n, any_value(ac.amount) AS amount, any_value(ex.amount) AS wanted,
             bool_and(ac.status IS NOT DISTINCT FROM ex.status AND ac.amount IS NOT DISTINCT FROM ex.amount) AS same
      FROM ac JOIN ex USING (task_key, o_orderkey) GROUP BY ac.task_key, ac.attempt, ac.o_orderkey),
c AS (SELECT i.task_key, i.attempt, (SELECT COUNT(*) FROM ex WHERE ex.task_key = i.task_key) AS n_expected,
             COUNT(m.o_orderkey) AS found, COALESCE(SUM(m.n), 0) AS n_actual, COUNT(CASE WHEN NOT m.same THEN 1 END) AS n_wrong,
             COUNT(CASE WHEN NOT m.same AND m.n = 1 AND round(m.amount / m.wanted) >= 2
                      AND abs(m.amount - round(m.amount / m.wanted) * m.wanted) <= 5e-3 * round(m.amount / m.wanted) THEN 1 END) AS n_multiplied
      FROM i LEFT JOIN m ON m.task_key = i.task_key AND m.attempt = i.attempt GROUP BY i.task_key, i.attempt),
k AS (SELECT *, CASE WHEN attempt = 8 THEN 'unsafe' WHEN attempt = 9 THEN 'schema_mismatch'
                     WHEN found < n_expected OR n_actual > found OR (n_wrong > 0 AND n_multiplied = n_wrong) THEN 'join_logic'
                     WHEN n_wrong > 0 THEN 'aggregation' ELSE 'ok' END AS failure_class FROM c)
SELECT attempt, failure_class, COUNT(*) AS n, CAST(SUM(n_expected - found) AS BIGINT) AS n_missing, CAST(SUM(n_actual - found) AS BIGINT) AS n_extra,
       CAST(SUM(n_wrong) AS BIGINT) AS n_wrong FROM k GROUP BY attempt, failure_class""")
def result_failure_classes(spark, sf_dir):
    """Failure classes of nine attempts per customer, by a multiset difference of their rows against the expected ones."""
    exp, act, attempts = failing_attempts(spark, sf_dir)
    diff = FL.result_diff(act, exp, "task_key", ["attempt"], ["o_orderkey"], ["status", "amount"], attempts)
    k = FL.failure_classes(diff, attempts, ["attempt", "task_key"], "sql", "error")
    return k.groupBy("attempt", "failure_class").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("n_missing", "n_extra", "n_wrong")])


# ------------------------------------------------------------ GR7 / UD2 ---
def _balance_task(spark, sf_dir):
    """A task over the driver tables: total balances per nation, whose naive form falls into the fan trap."""
    def golden(_):
        n, c, s = V.nation_children(spark, sf_dir)
        return R.preaggregate_then_join(n.select("n_nationkey", "n_name"), "n_nationkey", [
            (c, "c_nationkey", {"customers": F.sum(S.money("c_acctbal"))}), (s, "s_nationkey", {"suppliers": F.sum(S.money("s_acctbal"))})
        ]).select("n_name", F.col("customers").cast("double"), F.col("suppliers").cast("double")).orderBy("n_name")

    return Task("nation_balances", "Balances per nation", "medium", "Total customer and supplier balance of every nation.",
                "n_name, customers, suppliers; ordered by name.", "SELECT 1", "SELECT 1", "Aggregate before you join.",
                ("nation", "customer", "supplier"), max_steps=15, golden=golden)


@register("plugin_task_grades", ("UD2", "GR6", "GR7"), sql="""
WITH c AS (SELECT c_nationkey AS k, SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS total, COUNT(*) AS n FROM customer GROUP BY c_nationkey),
s AS (SELECT s_nationkey AS k, SUM(CAST(s_acctbal AS DECIMAL(18,2))) AS total, COUNT(*) AS n FROM supplier GROUP BY s_nationkey),
g AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS pos, CAST(c.total AS DOUBLE) AS customers, CAST(s.total AS DOUBLE) AS suppliers,
             CAST(c.total * GREATEST(COALESCE(s.n, 0), 1) AS DOUBLE) AS fan_c, CAST(s.total * GREATEST(COALESCE(c.n, 0), 1) AS DOUBLE) AS fan_s
      FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey),
m AS (SELECT COUNT(*) AS n, COUNT(CASE WHEN customers IS NOT DISTINCT FROM fan_c AND suppliers IS NOT DISTINCT FROM fan_s THEN 1 END) AS fan,
             COUNT(CASE WHEN pos <= 20 THEN 1 END) AS first20 FROM g),
r AS (SELECT 1 AS attempt, n AS n_actual, n AS n_expected, n AS matches, 1e0 AS score FROM m
      UNION ALL SELECT 2, n, n, fan, CAST(fan AS DOUBLE) / n FROM m
      UNION ALL SELECT 3, first20, n, first20, CASE WHEN first20 = n THEN 1e0 ELSE LEAST(5e-1, CAST(first20 AS DOUBLE) / n * 5e-1) END FROM m
      UNION ALL SELECT 4, 0, n, 0, 0e0 FROM m)
SELECT CAST(attempt AS INTEGER) AS attempt, CAST(n_actual AS BIGINT) AS n_actual, n_expected, CAST(matches AS BIGINT) AS matches,
       CAST(printf('%.3f', LEAST(9.99e-1, GREATEST(1e-3, score))) AS DOUBLE) AS score FROM r""")
def plugin_task_grades(spark, sf_dir):
    """A task registered with golden rows of its own, and four attempts at it: right, fan trap, first 20 rows, none."""
    task = _balance_task(spark, sf_dir)
    register_task(task)
    try:
        gold = ordinal(task.golden(spark).withColumns({"k": F.lit(0)}), ["k"], ["n_name"], "pos").drop("k")
        n, c, s = V.nation_children(spark, sf_dir)
        fan = R.naive_fan_totals(n.select("n_nationkey", "n_name"), "n_nationkey", (c, "c_nationkey", "c_acctbal", "customers"),
                                 (s, "s_nationkey", "s_acctbal", "suppliers")).select("n_name", "customers", "suppliers")
        fan = ordinal(fan.withColumn("k", F.lit(0)), ["k"], ["n_name"], "pos").drop("k")
        cols = ["n_name", F.col("customers").cast("double").alias("customers"), F.col("suppliers").cast("double").alias("suppliers"), "pos"]
        act = (gold.select(*cols, F.lit(1).alias("attempt")).unionByName(fan.select(*cols, F.lit(2).alias("attempt")))
               .unionByName(gold.where("pos <= 20").select(*cols, F.lit(3).alias("attempt"))))
        index = spark.range(1, 5).select(F.col("id").cast("int").alias("attempt"))
        return G.grade_for_task(spark, task.task_id, act, attempt_index=index).select("attempt", "n_actual", "n_expected", "matches", "score")
    finally:
        unregister_task(task.task_id)
