"""Session operators against brute force on small skewed data."""

import datetime as dt
import random

from pyspark.sql import functions as F

from queryforge.operators import episodes as EPI


def _events(spark, n=1500, seed=2):
    rnd = random.Random(seed)
    t = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        u = 1 if rnd.random() < 0.5 else rnd.randint(2, 6)     # user 1 is hot
        rows.append((i, u, t + dt.timedelta(seconds=rnd.randint(0, 10 * 86400))))
    return rows, spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")


def test_idle_sessions_scan_equals_session_window_and_brute_force(spark):
    rows, df = _events(spark)
    a = EPI.idle_sessions(df, "user_id", "ts", "6 hours", tiebreak="event_id")
    b = EPI.idle_sessions(df, "user_id", "ts", "6 hours", method="session_window")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    gap = dt.timedelta(hours=6)
    n_sessions = 0
    for u in {r[1] for r in rows}:
        ts = sorted(r[2] for r in rows if r[1] == u)
        n_sessions += 1 + sum(1 for x, y in zip(ts, ts[1:]) if y - x >= gap)
    assert a.count() == n_sessions


def test_episodes_by_marker(spark):
    rows, df = _events(spark, 800, 4)
    d = df.withColumn("marker", F.hour("ts") == 0)
    got = {r["event_id"]: r["episode_no"] for r in
           EPI.episodes_by_marker(d, "user_id", ["ts", "event_id"], "marker").collect()}
    for u in {r[1] for r in rows}:
        run = 0
        for r in sorted((r for r in rows if r[1] == u), key=lambda r: (r[2], r[0])):
            run += 1 if r[2].hour == 0 else 0
            assert got[r[0]] == run


def test_idle_sessions_merge_over_stretches_of_buckets(spark):
    rnd = random.Random(8)
    t0, rows = dt.datetime(2024, 1, 1), []
    for u in (1, 2, None):
        at = 0.0
        for _ in range(400):
            at += rnd.choice([0, 0.5, 1, 59.999999, 60, 61, 300, 3000])
            rows.append((len(rows), u, t0 + dt.timedelta(seconds=at)))
    rows += [(-1, 3, None), (-2, 3, t0)]
    rnd.shuffle(rows)
    expected = []
    for u in (1, 2, 3, None):
        session = None
        for t in sorted(r[2] for r in rows if r[1] == u and r[2]):
            if session and t - session[2] < dt.timedelta(seconds=60):
                session = [u, session[1], t, session[3] + 1]
                expected[-1] = session
            else:
                session = [u, t, t, 1]
                expected.append(session)
    expected = sorted(((u, a, b + dt.timedelta(seconds=60), n) for u, a, b, n in expected), key=repr)
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(rows, f"event_id long, user_id long, ts {kind}").repartition(3)
        for buckets in (1, 2, 7, 1024):
            got = EPI.idle_sessions(df, "user_id", "ts", "60 seconds", buckets=buckets).collect()
            assert sorted(map(tuple, got), key=repr) == expected, (kind, buckets)


def test_idle_sessions_shuffle_segments_only(spark):
    """One scan; below the first exchange a partial aggregate, so no raw row is shuffled."""
    _, df = _events(spark, 200)
    plan = EPI.idle_sessions(df, "user_id", "ts", "6 hours")._jdf.queryExecution().sparkPlan().toString()
    tree = EPI.idle_sessions(df, "user_id", "ts", "6 hours")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") == 1
    below = tree.splitlines()[max(i for i, line in enumerate(tree.splitlines()) if "Exchange" in line) + 1:]
    assert any("partial_min" in line for line in below)
