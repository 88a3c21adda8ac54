"""Registered relational queries over the driver tables (PRJ, JN1-JN7, AG1-AG13, WN1-WN2, SL1-SL3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from queryforge.functions import scalar as S
from queryforge.operators import relational as R
from queryforge.operators.scan import ordered_scan
from queryforge.plans import views as V
from queryforge.plans.registry import register

T = V.T


def _money(c):
    return S.money(c)


# ---------------------------------------------------------------------------
@register("top_customers_revenue", ("SRC1", "JN1", "AG1", "PRJ1", "SL1", "SF5"), sql="""
SELECT c.c_custkey AS customer_id, c.c_name AS customer_name,
       CAST(ROUND(SUM(CAST(l.l_quantity AS DECIMAL(18,2)) * CAST(l.l_extendedprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_value
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey
GROUP BY c.c_custkey, c.c_name
ORDER BY total_value DESC, customer_id
LIMIT 5""")
def top_customers_revenue(spark, sf_dir):
    """Top five customers by sum(quantity * price).

    lineitem is pre-aggregated per order before the join (4x fewer join rows,
    and the aggregate's hash partitioning on the order key is reused by the
    join); the per-customer totals join the customer names, then a
    TakeOrderedAndProject keeps the top five.
    """
    li = T(spark, sf_dir, "lineitem").select(
        "l_orderkey", (_money("l_quantity") * _money("l_extendedprice")).alias("v"))
    per_order = li.groupBy("l_orderkey").agg(F.sum("v").alias("order_value"))
    orders = T(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    per_cust = (per_order.join(orders, per_order["l_orderkey"] == orders["o_orderkey"])
                .groupBy("o_custkey").agg(F.sum("order_value").alias("total")))
    cust = T(spark, sf_dir, "customer").select("c_custkey", "c_name")
    j = per_cust.join(cust, per_cust["o_custkey"] == cust["c_custkey"]).select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
        F.round("total", 2).cast("double").alias("total_value"))
    return R.top_k(j, 5, [F.desc("total_value"), F.asc("customer_id")])


@register("customer_orders_1997", ("JN3", "AG2", "PRJ4", "SF1", "SL2"), sql="""
SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, COUNT(o.o_orderkey) AS headcount,
       CAST(ROUND(CAST(AVG(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,8)), 2) AS DOUBLE) AS avg_price
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
  AND o.o_orderdate >= TIMESTAMP '1997-01-01' AND o.o_orderdate < TIMESTAMP '1998-01-01'
GROUP BY c.c_custkey, c.c_name
ORDER BY customer_name""")
def customer_orders_1997(spark, sf_dir):
    """Every customer with its 1997 order count (0 when none) and average price (null when none).

    The year test is a half-open date range on the raw column, applied to
    ``orders`` before the outer join, so it reaches the parquet scan.
    """
    cust = T(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = T(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    # aggregate the (filtered) child per customer before the outer join: one row
    # per key reaches the join, so a customer owning a third of all orders is
    # just one more row there (AQE cannot split the inner side of a left join)
    per = (orders.where(S.year_range("o_orderdate", 1997)).groupBy("o_custkey")
           .agg(F.count("o_orderkey").alias("n"), F.avg(_money("o_totalprice")).alias("a")))
    j = R.left_join_filtered(cust, per, cust["c_custkey"] == per["o_custkey"])
    return (j.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
                     F.coalesce("n", F.lit(0)).alias("headcount"),
                     F.round("a", 2).cast("double").alias("avg_price"))
            .orderBy("customer_name"))


_FIN_SQL_CHILDREN = """
c AS (SELECT c_nationkey, SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS s, COUNT(*) AS n FROM customer GROUP BY c_nationkey),
s AS (SELECT s_nationkey, SUM(CAST(s_acctbal AS DECIMAL(18,2))) AS s, COUNT(*) AS n FROM supplier GROUP BY s_nationkey)"""


@register("nation_balance_preagg", ("JN4",), sql=f"""
WITH {_FIN_SQL_CHILDREN}
SELECT n.n_nationkey, n.n_name, CAST(c.s AS DOUBLE) AS total_customer_bal, CAST(s.s AS DOUBLE) AS total_supplier_bal
FROM nation n LEFT JOIN c ON c.c_nationkey = n.n_nationkey LEFT JOIN s ON s.s_nationkey = n.n_nationkey
ORDER BY n.n_name""")
def nation_balance_preagg(spark, sf_dir):
    """Fan-trap-safe totals: each child aggregated by nation, then left-joined."""
    n, c, s = V.nation_children(spark, sf_dir)
    out = R.preaggregate_then_join(n.select("n_nationkey", "n_name"), "n_nationkey", [
        (c, "c_nationkey", {"total_customer_bal": F.sum(_money("c_acctbal"))}),
        (s, "s_nationkey", {"total_supplier_bal": F.sum(_money("s_acctbal"))}),
    ])
    return out.select("n_nationkey", "n_name", F.col("total_customer_bal").cast("double").alias("total_customer_bal"),
                      F.col("total_supplier_bal").cast("double").alias("total_supplier_bal")).orderBy("n_name")


@register("nation_balance_naive", ("JN5",), sql="""
SELECT n.n_nationkey, n.n_name,
       CAST(SUM(CAST(c.c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total_customer_bal,
       CAST(SUM(CAST(s.s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total_supplier_bal
FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey
  LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey
GROUP BY n.n_nationkey, n.n_name
ORDER BY n.n_name""")
def nation_balance_naive(spark, sf_dir):
    """The multiplied totals of the naive double left join, computed without the pairs."""
    n, c, s = V.nation_children(spark, sf_dir)
    out = R.naive_fan_totals(n.select("n_nationkey", "n_name"), "n_nationkey",
                             (c, "c_nationkey", "c_acctbal", "total_customer_bal"),
                             (s, "s_nationkey", "s_acctbal", "total_supplier_bal"))
    return out.select("n_nationkey", "n_name", F.col("total_customer_bal").cast("double").alias("total_customer_bal"),
                      F.col("total_supplier_bal").cast("double").alias("total_supplier_bal")).orderBy("n_name")


_COHORT_SQL = f"""
WITH {V.DUCK_COHORT_BASE},
s AS (SELECT * FROM signups WHERE signup_ts >= TIMESTAMP '{V.SIGNUP_FROM}' AND signup_ts < TIMESTAMP '{V.SIGNUP_TO}'),
stats AS (
  SELECT s.user_id, s.signup_ts, MIN(p.purchase_ts) AS first_ts,
         COUNT_IF(epoch_us(p.purchase_ts) - epoch_us(s.signup_ts) BETWEEN 0 AND {V.COHORT_DAYS} * 86400000000) AS n_win,
         COUNT(DISTINCT p.purchase_id) AS n_distinct,
         SUM(CAST(p.amount AS DECIMAL(18,2))) AS ltv
  FROM s JOIN purchases p ON p.user_id = s.user_id
  GROUP BY s.user_id, s.signup_ts)
SELECT user_id, strftime(signup_ts, '%Y-%m-%d') AS signup_date, strftime(first_ts, '%Y-%m-%d') AS first_purchase_date,
       CAST(trunc((epoch_us(first_ts) - epoch_us(signup_ts)) / 86400000000.0) AS INTEGER) AS days_to_first_purchase,
       n_win AS purchases_in_window, n_distinct AS distinct_purchases,
       CAST(ROUND(ltv, 2) AS DOUBLE) AS total_lifetime_value
FROM stats WHERE n_win >= 2
ORDER BY total_lifetime_value DESC, user_id"""


@register("cohort_activation", ("JN2", "JN7", "AG3", "AG4", "AG5", "AG6", "PRJ3", "PRJ5", "PRJ6", "PRJ7",
                                "PRJ9", "SF4"), sql=_COHORT_SQL)
def cohort_activation(spark, sf_dir):
    """Activated users: signup in the window, >= 2 purchases within 7 days of signup.

    One aggregate per user carries the lifetime value over *all* purchases
    next to the count over the first days (``count_if``), the per-user first
    purchase (the correlated repair of the global-minimum bug) and a distinct
    count; the window test is exact on microseconds and bounded below (F12).
    """
    sg = V.signups(spark, sf_dir).where(
        (F.col("signup_ts") >= F.lit(V.SIGNUP_FROM))
        & (F.col("signup_ts") < F.lit(V.SIGNUP_TO)))
    p = V.purchases(spark, sf_dir)
    stats = (p.join(sg, "user_id")
             .groupBy("user_id", "signup_ts")
             .agg(F.min("purchase_ts").alias("first_ts"),
                  F.count_if(S.within_days("purchase_ts", "signup_ts", V.COHORT_DAYS)).alias("n_win"),
                  F.count_distinct("purchase_id").alias("n_distinct"),
                  F.sum(_money("amount")).alias("ltv"))
             .where(F.col("n_win") >= 2))
    return stats.select(
        "user_id", F.date_format("signup_ts", "yyyy-MM-dd").alias("signup_date"),
        F.date_format("first_ts", "yyyy-MM-dd").alias("first_purchase_date"),
        S.whole_days("first_ts", "signup_ts").alias("days_to_first_purchase"),
        F.col("n_win").alias("purchases_in_window"), F.col("n_distinct").alias("distinct_purchases"),
        F.round("ltv", 2).cast("double").alias("total_lifetime_value"),
    ).orderBy(F.desc("total_lifetime_value"), "user_id")


@register("cohort_first_purchase_scope", ("JN7",), sql=f"""
WITH {V.DUCK_COHORT_BASE},
own AS (SELECT user_id, MIN(purchase_ts) AS first_ts FROM purchases GROUP BY user_id)
SELECT s.user_id, strftime(own.first_ts, '%Y-%m-%d %H:%M:%S') AS own_first,
       strftime((SELECT MIN(purchase_ts) FROM purchases), '%Y-%m-%d %H:%M:%S') AS global_first,
       own.first_ts = (SELECT MIN(purchase_ts) FROM purchases) AS same_as_global
FROM signups s JOIN own ON own.user_id = s.user_id""")
def cohort_first_purchase_scope(spark, sf_dir):
    """Uncorrelated (global) vs correlated (per-user) first purchase, side by side.

    The global form is a scalar subquery: evaluated once, inlined as a value.
    """
    p = V.purchases(spark, sf_dir)
    own = R.first_per_key(p, "user_id", "purchase_ts", "first_ts")
    g = R.global_first(p, "purchase_ts")
    fmt = "yyyy-MM-dd HH:mm:ss"
    return V.signups(spark, sf_dir).join(own, "user_id").select(
        "user_id", F.date_format("first_ts", fmt).alias("own_first"),
        F.date_format(g, fmt).alias("global_first"), (F.col("first_ts") == g).alias("same_as_global"))


@register("purchase_running_ltv", ("WN2",), sql=f"""
WITH {V.DUCK_COHORT_BASE}
SELECT user_id, purchase_id,
       COUNT(*) OVER w AS purchase_no,
       CAST(SUM(CAST(amount AS DECIMAL(18,2))) OVER w AS DOUBLE) AS running_ltv
FROM purchases
WINDOW w AS (PARTITION BY user_id ORDER BY purchase_ts, purchase_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def purchase_running_ltv(spark, sf_dir):
    """Ordered running total per user (the ORDER BY repair of the window bug), skew-safe scan."""
    p = V.purchases(spark, sf_dir).withColumn("amt", _money("amount"))
    out = ordered_scan(p, ["user_id"], ["purchase_ts", "purchase_id"],
                       [("purchase_no", "count", None), ("running", "sum", "amt")])
    return out.select("user_id", "purchase_id", "purchase_no",
                      F.col("running").cast("double").alias("running_ltv"))


@register("user_daily_spend", ("WN1", "SF3"), sql=f"""
WITH {V.DUCK_COHORT_BASE}
SELECT user_id, strftime(purchase_ts, '%Y-%m-%d') AS day,
       CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS day_total,
       CAST(SUM(SUM(CAST(amount AS DECIMAL(18,2)))) OVER (PARTITION BY user_id) AS DOUBLE) AS lifetime_total
FROM purchases GROUP BY user_id, strftime(purchase_ts, '%Y-%m-%d')""")
def user_daily_spend(spark, sf_dir):
    """``SUM(SUM(x)) OVER (PARTITION BY user)``: a window over an aggregate (rows per user = days)."""
    p = V.purchases(spark, sf_dir)
    daily = p.groupBy("user_id", F.date_format("purchase_ts", "yyyy-MM-dd").alias("day")).agg(
        F.sum(_money("amount")).alias("d"))
    w = Window.partitionBy("user_id")
    return daily.select("user_id", "day", F.col("d").cast("double").alias("day_total"),
                        F.sum("d").over(w).cast("double").alias("lifetime_total"))


@register("repeat_customers", ("JN6", "AG3"), sql="""
SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 2)""")
def repeat_customers(spark, sf_dir):
    """``id IN (SELECT .. GROUP BY .. HAVING COUNT(*) > 2)`` as aggregate + left-semi join."""
    cust = T(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = T(spark, sf_dir, "orders").select("o_custkey")
    return R.semi_on_aggregate(cust, "c_custkey", orders, "o_custkey", F.col("__n") > 2)


@register("signed_up_purchasers", ("JN2", "AG7"), sql=f"""
WITH {V.DUCK_COHORT_BASE}
SELECT DISTINCT e.user_id FROM events e
WHERE e.event_type = 'signup' AND EXISTS (SELECT 1 FROM purchases p WHERE p.user_id = e.user_id)""")
def signed_up_purchasers(spark, sf_dir):
    """Users who signed up and bought: DISTINCT + existence as a left-semi join."""
    ev = T(spark, sf_dir, "events")
    su = ev.where(F.col("event_type") == "signup").select("user_id").distinct()
    return R.exists_in(su, V.purchases(spark, sf_dir), "user_id")


@register("distinct_segments", ("AG7",), sql="""
SELECT DISTINCT c_mktsegment, c_nationkey FROM customer""")
def distinct_segments(spark, sf_dir):
    return T(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey").distinct()


@register("supplier_net_revenue", ("AG8", "SF7"), sql="""
SELECT l_suppkey,
       CAST(SUM(CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2))
                     ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS pnl
FROM lineitem GROUP BY l_suppkey ORDER BY pnl DESC, l_suppkey""")
def supplier_net_revenue(spark, sf_dir):
    """Signed conditional sum: returned lines count negative."""
    li = T(spark, sf_dir, "lineitem")
    return (li.groupBy("l_suppkey").agg(F.sum(S.signed("l_returnflag", _money("l_extendedprice"), "R")).alias("p"))
            .select("l_suppkey", F.col("p").cast("double").alias("pnl")).orderBy(F.desc("pnl"), "l_suppkey"))


@register("customer_order_ratio", ("AG9",), sql="""
SELECT o_custkey, CAST(ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) / COUNT(*) AS DECIMAL(38,8)), 4) AS DOUBLE) AS risk
FROM orders GROUP BY o_custkey""")
def customer_order_ratio(spark, sf_dir):
    """``SUM(amount) / COUNT(*)`` per key."""
    o = T(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(
        F.round(F.sum(_money("o_totalprice")) / F.count(F.lit(1)), 4).cast("double").alias("risk"))


@register("monthly_shipped_revenue", ("AG10", "SF2"), sql="""
SELECT strftime(l_shipdate, '%Y-%m') AS ym, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM lineitem GROUP BY ym ORDER BY ym""")
def monthly_shipped_revenue(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem")
    return (li.groupBy(S.year_month("l_shipdate").alias("ym"))
            .agg(F.sum(_money("l_extendedprice")).cast("double").alias("revenue")).orderBy("ym"))


@register("daily_event_exposure", ("AG11", "SF3", "SF6"), sql="""
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS d, CAST(SUM(abs(CAST(value AS DECIMAL(18,2)))) AS DOUBLE) AS exposure
FROM events GROUP BY d ORDER BY d""")
def daily_event_exposure(spark, sf_dir):
    ev = T(spark, sf_dir, "events")
    return (ev.groupBy(F.date_format(S.calendar_day("ts"), "yyyy-MM-dd").alias("d"))
            .agg(F.sum(F.abs(_money("value"))).cast("double").alias("exposure")).orderBy("d"))


@register("avg_price_by_type", ("AG12", "SL2"), sql="""
SELECT p_type, CAST(ROUND(CAST(AVG(CAST(p_retailprice AS DECIMAL(18,2))) AS DECIMAL(38,8)), 2) AS DOUBLE) AS avg_price
FROM part GROUP BY p_type ORDER BY avg_price DESC, p_type""")
def avg_price_by_type(spark, sf_dir):
    p = T(spark, sf_dir, "part")
    return (p.groupBy("p_type").agg(F.round(F.avg(_money("p_retailprice")), 2).cast("double").alias("avg_price"))
            .orderBy(F.desc("avg_price"), "p_type"))


@register("lineitem_count", ("AG13",), sql="SELECT COUNT(*) AS n FROM lineitem")
def lineitem_count(spark, sf_dir):
    return T(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@register("orders_page", ("SL3",), sql="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10""")
def orders_page(spark, sf_dir):
    o = T(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return R.top_k(o, 10, [F.asc("o_orderkey")])


@register("customer_lookup", ("PRJ2", "PRJ8"), sql="SELECT * FROM customer WHERE c_custkey = 1")
def customer_lookup(spark, sf_dir):
    """Star projection with a point predicate (pushed to the parquet scan)."""
    return T(spark, sf_dir, "customer").select("*").where(F.col("c_custkey") == 1)


@register("sample_orders", ("SRC3",), sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 3""")
def sample_orders(spark, sf_dir):
    """First three rows in key order (TakeOrderedAndProject: one scan, top 3 per partition)."""
    from queryforge.sources.tables import sample_rows
    o = T(spark, sf_dir, "orders")
    return sample_rows(o, 3, ["o_orderkey"]).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderpriority")
