"""Results do not depend on the session time zone (wall-clock timestamps, as the source's text dates)."""

import os

import duckdb

from conftest import SF_SMALL

import __spark_entry__ as E


def _norm(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


def test_time_queries_in_non_utc_session(spark):
    con = duckdb.connect()
    for t in ("events", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        for name in ("cohort_activation", "idle_sessions", "purchase_running_ltv", "customer_orders_1997"):
            df = E.queries()[name](spark, SF_SMALL)
            cur = con.execute(E.oracle_sql()[name])
            cols = [d[0] for d in cur.description]
            order = [cols.index(c) for c in df.columns]
            assert _norm([tuple(r) for r in df.collect()]) == _norm([tuple(r[i] for i in order) for r in cur.fetchall()]), name
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
