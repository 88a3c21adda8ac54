"""Sinks and log round trips."""

import os
import tempfile

from queryforge.operators import runlog as RL
from queryforge.plans import views as V
from queryforge.sources import sinks as K
from queryforge.sources.tables import read_log_history

from conftest import SF_SMALL


def test_jsonl_roundtrip_keeps_series(spark):
    d = tempfile.mkdtemp(prefix="qf-sink-")
    log = V.run_log(spark, SF_SMALL)
    K.write_jsonl(log, os.path.join(d, "log"))
    back = read_log_history(spark, os.path.join(d, "log"))
    a, b = RL.reward_series(log), RL.reward_series(back)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_metrics_series_csv(spark):
    d = tempfile.mkdtemp(prefix="qf-sink-")
    log = V.run_log(spark, SF_SMALL)
    s = RL.reward_series(log)
    K.write_metrics(K.metrics_frame(s, log), os.path.join(d, "m"))
    K.write_series({"reward_series": s}, os.path.join(d, "s"))
    K.write_log_csv(log.select("log_idx", "step", "reward"), os.path.join(d, "c"))
    import json
    m = json.loads(spark.read.text(os.path.join(d, "m")).collect()[0][0])
    assert m["log_rows"] == log.count() and m["reward_points"] == s.count()
    ser = spark.read.json(os.path.join(d, "s"))
    assert ser.where("series = 'reward_series'").count() == s.count()
    assert spark.read.option("header", True).csv(os.path.join(d, "c")).count() == log.count()


def test_run_artifacts_hold_all_columns_and_series(spark, monkeypatch):
    from queryforge.plans import q_sources as Q
    csv, series = [], []
    monkeypatch.setattr(Q.K, "write_log_csv", lambda df, path, f=Q.K.write_log_csv: (csv.append(df.columns), f(df, path)))
    monkeypatch.setattr(Q.K, "write_series", lambda s, path, f=Q.K.write_series: (series.append({k: d.count() for k, d in s.items()}), f(s, path)))
    rows = {r["artifact"]: r["lines"] for r in Q.run_artifacts(spark, SF_SMALL).collect()}
    assert csv == [V.run_log(spark, SF_SMALL).columns] and len(csv[0]) == 8
    phases = {r["phase"]: r["count"] for r in V.samples(spark, SF_SMALL).groupBy("phase").count().collect()}
    assert {k: series[0][f"{k}_samples"] for k in phases} == phases and set(phases) == {"before", "after"}
    assert len(series[0]) == 4 and rows["series"] == sum(series[0].values())
