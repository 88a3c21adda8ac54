"""Registered source/sink queries: schema profile and text (SRC2, PD4), log round trips (SRC5-SRC8, SRC10)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from queryforge.operators import prompts as P
from queryforge.operators import runlog as RL
from queryforge.plans import q_runs as QR
from queryforge.plans import views as V
from queryforge.plans.registry import ORACLE, register
from queryforge.session import checkpoint_dir
from queryforge.sources import sinks as K
from queryforge.sources.tables import DRIVER_TABLES, load_tables, read_log_history, read_log_variant, schema_profile

_NAMES = ", ".join(f"'{t}'" for t in DRIVER_TABLES)
_DUCK_PROFILE = f"""
prof AS (
  SELECT table_name AS "table", CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name AS "column",
    CASE data_type WHEN 'INTEGER' THEN 'INT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'TIMESTAMP' THEN 'TIMESTAMP_NTZ'
      WHEN 'FLOAT[]' THEN 'ARRAY<FLOAT>' ELSE data_type END AS type,
    is_nullable AS nullable, 'NO' AS primary_key
  FROM information_schema.columns WHERE table_name IN ({_NAMES}))"""


def _profile(spark, sf_dir):
    return schema_profile(spark, load_tables(spark, sf_dir, register=False))


@register("schema_profile", ("SRC2", "SRC1"), sql=f"""
WITH {_DUCK_PROFILE}
SELECT * FROM prof""")
def schema_profile_q(spark, sf_dir):
    """Column listing of every driver table, ordered by table then ordinal (read from the schemas)."""
    return _profile(spark, sf_dir)


@register("schema_text", ("PD4",), sql=f"""
WITH {_DUCK_PROFILE}
SELECT "table", '  ' || "table" || ': ' || string_agg("column" || ' (' || type || ')', ', ' ORDER BY ordinal) AS line
FROM prof GROUP BY "table" """)
def schema_text_q(spark, sf_dir):
    """``  table: col (type), ..`` prompt lines per table."""
    return P.schema_text(_profile(spark, sf_dir))


def _scratch(spark, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@register("log_history_roundtrip", ("SRC5", "SRC10"))
def log_history_roundtrip(spark, sf_dir):
    """Trainer-log rows written as JSON lines (null keys omitted), read back with a merged
    inferred schema, and the reward series extracted again: equals ``reward_series``."""
    path = _scratch(spark, "log-history")
    K.write_jsonl(V.run_log(spark, sf_dir), path)
    return RL.reward_series(read_log_history(spark, path)).select("step", "value")


ORACLE["log_history_roundtrip"] = ORACLE["reward_series"]


@register("variant_reward_series", ("SRC10", "SF21", "SF22", "TL1"), sql=ORACLE["reward_series"])
def variant_reward_series(spark, sf_dir):
    """The log written as JSON lines and read back as variants, without a schema: the reward series once more."""
    path = _scratch(spark, "log-variant")
    K.write_jsonl(V.run_log(spark, sf_dir), path)
    log = read_log_variant(spark, path).withColumn("log_idx", F.try_variant_get("v", "$.log_idx", "bigint"))
    return RL.reward_series_variant(log).select("step", "value")


_KEYS = ("log_idx", "step", "global_step", "epoch", "reward", "rewards/mean", "loss", "grad_norm")


@register("log_key_counts", ("SRC10", "SF21"), sql=f"""
WITH {V.DUCK_RUN_LOG}, k AS ({" UNION ALL ".join(f"SELECT '{k}' AS key, COUNT({chr(34)}{k}{chr(34)}) AS n_rows FROM run_log" for k in _KEYS)})
SELECT key, n_rows, n_rows AS n_numbers FROM k WHERE n_rows > 0""")
def log_key_counts(spark, sf_dir):
    """Keys of the written log, with the rows that have them, found in the variants by one aggregate."""
    path = _scratch(spark, "log-keys")
    K.write_jsonl(V.run_log(spark, sf_dir), path)
    return RL.log_keys(read_log_variant(spark, path))


_SUM8 = "CAST(COALESCE(SUM(CAST(%s AS DECIMAL(28,8))), 0) AS DOUBLE)"


@register("run_artifacts", ("SRC6", "SRC7", "SRC8"), sql=f"""
WITH {QR._DUCK_SERIES}, {QR._DUCK_BA.strip()},
m1 AS (SELECT reward_first + reward_last + reward_max + before_mean + after_mean + delta + (SELECT COUNT(*) FROM run_log) AS total
       FROM (SELECT arg_min(value, log_idx) AS reward_first, arg_max(value, log_idx) AS reward_last, MAX(value) AS reward_max FROM rs)
       CROSS JOIN (SELECT * FROM ba WHERE task_id = 'overall')),
sr AS (SELECT 'reward_series' AS series, value FROM rs UNION ALL SELECT 'loss_series', value FROM ls
       UNION ALL SELECT phase || '_samples', CAST(reward_dec AS DOUBLE) FROM samples)
SELECT 'metrics' AS artifact, CAST(1 AS BIGINT) AS lines, ROUND(total, 6) AS total FROM m1
UNION ALL SELECT COALESCE('series/' || series, 'series'), COUNT(*), {_SUM8 % "value"} FROM sr GROUP BY ROLLUP (series)
UNION ALL SELECT 'log_csv', COUNT(*), {_SUM8 % 'COALESCE(reward, 0) + COALESCE("rewards/mean", 0) + COALESCE(loss, 0) + COALESCE(grad_norm, 0) + step'}
FROM run_log""")
def run_artifacts(spark, sf_dir):
    """Metrics object, series bundle and CSV log written as files and read back: per artifact, and per series, its
    records and the sum of its values."""
    base = _scratch(spark, "artifacts")
    log = V.run_log(spark, sf_dir)
    series = RL.reward_series(log)
    samples = QR._samples(spark, sf_dir)
    ov = RL.before_after(samples).where(F.col("task_id") == "overall").select(
        F.col("before_mean").alias("baseline_avg_reward"), F.col("after_mean").alias("post_avg_reward"),
        F.col("delta").alias("delta_avg_reward"))
    K.write_metrics(K.metrics_frame(series, log), f"{base}/metrics", extra=ov)  # extended like the source
    before_after = {f"{p}_samples": samples.where(F.col("phase") == p) for p in ("before", "after")}
    K.write_series({"reward_series": series, "loss_series": RL.numeric_series(log, "loss"),
                    **{name: rows.select(F.col("reward").alias("value")) for name, rows in before_after.items()}}, f"{base}/series")
    K.write_log_csv(log, f"{base}/log_csv")
    shown = ("reward_last", "reward_max", "baseline_avg_reward", "post_avg_reward", "delta_avg_reward", "log_rows")
    metrics = spark.read.json(f"{base}/metrics").agg(
        F.lit("metrics").alias("artifact"), F.count(F.lit(1)).alias("lines"),
        F.round(F.sum(sum((F.col(c) for c in shown), F.col("reward_first"))), 6).alias("total"))
    total = lambda c: F.coalesce(F.sum(c.cast("decimal(28,8)")), F.lit(0)).cast("double").alias("total")
    bundle = (spark.read.schema("series string, step double, value double").json(f"{base}/series")
              .rollup("series").agg(F.count(F.lit(1)).alias("lines"), total(F.col("value")))
              .withColumn("artifact", F.coalesce(F.concat(F.lit("series/"), "series"), F.lit("series"))).drop("series"))
    rows = spark.read.option("header", True).schema(log.schema).csv(f"{base}/log_csv")
    value = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in ("reward", "rewards/mean", "loss", "grad_norm")), F.col("step"))
    csv = rows.agg(F.lit("log_csv").alias("artifact"), F.count(F.lit(1)).alias("lines"), total(value))
    return metrics.unionByName(bundle).unionByName(csv)

