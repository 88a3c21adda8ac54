"""Registered run-analytics queries (TL1-TL7, AG14, AG16-AG22, WN7-WN8, SL4, JN8, ST1-ST2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryforge.operators import runlog as RL
from queryforge.plans import views as V
from queryforge.plans.registry import register

HARD_TASK = "1-URGENT"
CAPPED_N = 8

_DUCK_SERIES = f"""
{V.DUCK_RUN_LOG},
rr AS (SELECT COALESCE(NULLIF(CAST(step AS DOUBLE), 0e0), NULLIF(CAST(global_step AS DOUBLE), 0e0), epoch) AS step,
              COALESCE(reward, "rewards/mean") AS value, loss, log_idx FROM run_log),
rs AS (SELECT step, arg_min(value, log_idx) AS value, MIN(log_idx) AS log_idx
       FROM rr WHERE step IS NOT NULL AND value IS NOT NULL GROUP BY step),
ls AS (SELECT step, arg_min(loss, log_idx) AS value FROM rr WHERE step IS NOT NULL AND loss IS NOT NULL GROUP BY step)"""


def rewards(spark, sf_dir):
    return RL.reward_series(V.run_log(spark, sf_dir))


@register("reward_series", ("TL1", "SF21", "SF22", "WN7"), sql=f"""
WITH {_DUCK_SERIES}
SELECT step, value FROM rs""")
def reward_series(spark, sf_dir):
    """Reward-like value per logged step (first present key, first row per step)."""
    return rewards(spark, sf_dir).select("step", "value")


@register("loss_series", ("TL2",), sql=f"""
WITH {_DUCK_SERIES}
SELECT step, value FROM ls""")
def loss_series(spark, sf_dir):
    return RL.numeric_series(V.run_log(spark, sf_dir), "loss").select("step", "value")


@register("smoothed_rewards", ("TL3", "WN8"), sql=f"""
WITH {_DUCK_SERIES},
n AS (SELECT COUNT(*) AS n FROM rs),
w AS (SELECT GREATEST(5, CASE WHEN n // 20 = 0 THEN 5 ELSE n // 20 END) AS w FROM n),
c AS (SELECT step, value, row_number() OVER (ORDER BY step) AS pos,
             SUM(CAST(value AS DECIMAL(28,6))) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
      FROM rs)
SELECT c.step, c.value,
       CAST(ROUND(CAST((c.cum - COALESCE(b.cum, 0)) / LEAST(c.pos, w.w) AS DECIMAL(38,10)), 6) AS DOUBLE) AS moving_avg
FROM c CROSS JOIN w LEFT JOIN c b ON b.pos + w.w = c.pos""")
def smoothed_rewards(spark, sf_dir):
    """Trailing moving average of the reward series, w = max(5, n // 20 or 5)."""
    s = rewards(spark, sf_dir).withColumn("run", F.lit(0))
    # a run is one key: chunk its scan by blocks of 1024 steps
    out = RL.moving_average(s, ["run"], ["step"], "value", chunk=F.floor(F.col("step") / F.lit(1024.0)))
    return out.select("step", "value", "moving_avg")


@register("training_diagnostics", ("TL4",), sql=f"""
WITH {_DUCK_SERIES}
SELECT COALESCE(rs.step, ls.step) AS step, rs.value AS reward, ls.value AS loss
FROM rs FULL OUTER JOIN ls ON rs.step = ls.step""")
def training_diagnostics(spark, sf_dir):
    log = V.run_log(spark, sf_dir)
    return RL.diagnostics(RL.reward_series(log), RL.numeric_series(log, "loss")).select("step", "reward", "loss")


def _samples(spark, sf_dir):
    return V.samples(spark, sf_dir).withColumn("reward", F.col("reward_dec"))


_DUCK_BA = f"""
{V.DUCK_SAMPLES},
m AS (SELECT task_id, phase,
        CAST(ROUND(CAST(AVG(CAST(reward_dec AS DECIMAL(28,8))) AS DECIMAL(38,10)), 6) AS DOUBLE) AS mean
      FROM samples GROUP BY task_id, phase),
b AS (SELECT task_id, mean AS before_mean FROM m WHERE phase = 'before'),
a AS (SELECT task_id, mean AS after_mean FROM m WHERE phase = 'after'),
j AS (SELECT COALESCE(b.task_id, a.task_id) AS task_id, b.before_mean IS NOT NULL AS has_before,
             COALESCE(b.before_mean, 0e0) AS before_mean, COALESCE(a.after_mean, 0e0) AS after_mean
      FROM b FULL OUTER JOIN a ON a.task_id = b.task_id),
ov AS (SELECT 'overall' AS task_id, COALESCE(bool_or(has_before), false) AS has_before, ROUND(AVG(before_mean), 6) AS before_mean,
              ROUND(AVG(after_mean), 6) AS after_mean FROM j),
ba AS (SELECT *, CASE WHEN has_before THEN ROUND(after_mean - before_mean, 6) END AS delta
       FROM (SELECT * FROM j UNION ALL SELECT * FROM ov))"""


@register("before_after", ("TL5", "AG17", "AG18", "AG19", "JN8", "ST1", "ST2"), sql=f"""
WITH {_DUCK_BA}
SELECT * FROM ba""")
def before_after(spark, sf_dir):
    """Per-task mean reward before/after (missing baseline = 0.0, its delta null), and the unweighted overall row."""
    return RL.before_after(_samples(spark, sf_dir))


@register("lift_kpis", ("AG20",), sql=f"""
WITH {_DUCK_BA},
per AS (SELECT * FROM ba WHERE task_id <> 'overall'),
o AS (SELECT * FROM ba WHERE task_id = 'overall')
SELECT o.delta AS absolute_lift, (SELECT MAX(CASE WHEN task_id = '{HARD_TASK}' THEN delta END) FROM per) AS hard_lift,
       ROUND((o.after_mean - o.before_mean) / GREATEST(o.before_mean, 1e-9) * 1e2, 6) AS relative_pct,
       (SELECT COUNT_IF(delta > 0) FROM per) AS improved_tasks
FROM o""")
def lift_kpis(spark, sf_dir):
    """Absolute, hard-task and relative lift, and the number of improved tasks."""
    return RL.lift_kpis(RL.before_after(_samples(spark, sf_dir)), hard_task=HARD_TASK)


@register("distribution_shift", ("TL6", "AG21"), sql=f"""
WITH {V.DUCK_SAMPLES},
v AS (SELECT phase, CAST(reward_dec AS DOUBLE) AS reward FROM samples),
st AS (SELECT phase, MIN(reward) AS lo, MAX(reward) AS hi FROM v GROUP BY phase),
bn AS (SELECT v.phase, CASE WHEN st.hi = st.lo THEN 0
                ELSE CAST(LEAST(19, floor((v.reward - st.lo) / ((st.hi - st.lo) / 2e1))) AS INTEGER) END AS bin
       FROM v JOIN st ON st.phase = v.phase),
c AS (SELECT phase, bin, COUNT(*) AS cnt FROM bn GROUP BY phase, bin),
g AS (SELECT st.phase, st.lo, st.hi, r.bin FROM st, (SELECT CAST(unnest(range(0, 20)) AS INTEGER) AS bin) r)
SELECT g.phase, g.bin, ROUND(g.lo + g.bin * ((g.hi - g.lo) / 2e1), 6) AS bin_start, COALESCE(c.cnt, 0) AS count
FROM g LEFT JOIN c ON c.phase = g.phase AND c.bin = g.bin""")
def distribution_shift(spark, sf_dir):
    """20-bin reward histograms of the before and after samples (each over its own range)."""
    s = _samples(spark, sf_dir).select("phase", F.col("reward").cast("double").alias("reward"))
    return RL.histogram(s, "phase", "reward")


@register("run_summary", ("TL7", "AG22", "SRC6"), sql=f"""
WITH {_DUCK_SERIES}, {_DUCK_BA.strip()},
o AS (SELECT before_mean AS baseline_avg_reward, after_mean AS post_avg_reward, delta AS delta_avg_reward FROM ba WHERE task_id = 'overall'),
h AS (SELECT MAX(CASE WHEN has_before THEN before_mean END) AS base_hard_reward, MAX(after_mean) AS trained_hard_reward,
             MAX(delta) AS delta_hard_reward FROM ba WHERE task_id = '{HARD_TASK}'),
t AS (SELECT string_agg(task_id || '=' || CASE WHEN has_before THEN printf('%.6f', before_mean) ELSE 'null' END, ',' ORDER BY task_id)
               AS per_task_baseline_reward,
             string_agg(task_id || '=' || printf('%.6f', after_mean), ',' ORDER BY task_id) AS per_task_post_reward
      FROM ba WHERE task_id <> 'overall'),
ss AS (SELECT COUNT(*) AS reward_points, arg_min(value, log_idx) AS reward_first, arg_max(value, log_idx) AS reward_last,
              MAX(value) AS reward_max FROM rs)
SELECT (SELECT COUNT(*) FROM run_log) AS log_rows, ss.*, o.*, h.*, t.* FROM ss CROSS JOIN o CROSS JOIN h CROSS JOIN t""")
def run_summary(spark, sf_dir):
    """One metrics row: log rows, reward points/first/last/max, and the before/after figures: overall, of the hard task, per task."""
    log = V.run_log(spark, sf_dir)
    return RL.run_summary(RL.reward_series(log), log, RL.before_after(_samples(spark, sf_dir)), HARD_TASK)


@register("latency_stats", ("AG14",), sql="""
WITH l AS (SELECT event_type AS endpoint, value AS ms, event_id FROM events),
r AS (SELECT endpoint, ms, row_number() OVER (PARTITION BY endpoint ORDER BY ms, event_id) AS rk FROM l),
a AS (SELECT endpoint, COUNT(*) AS n,
        CAST(ROUND(CAST(AVG(CAST(ms AS DECIMAL(28,6))) AS DECIMAL(38,10)), 3) AS DOUBLE) AS avg_ms FROM l GROUP BY endpoint)
SELECT a.endpoint, a.avg_ms,
  ROUND(CASE WHEN a.n % 2 = 1 THEN MAX(CASE WHEN rk = floor((a.n + 1) / 2) THEN ms END)
             ELSE (MAX(CASE WHEN rk = floor((a.n + 1) / 2) THEN ms END) + MAX(CASE WHEN rk = floor(a.n / 2 + 1) THEN ms END)) / 2e0
        END, 3) AS p50_ms,
  ROUND(MAX(CASE WHEN rk = GREATEST(1, floor(CAST(a.n AS DOUBLE) * 9.5e-1)) THEN ms END), 3) AS p95_ms, a.n
FROM a JOIN r ON r.endpoint = a.endpoint GROUP BY a.endpoint, a.avg_ms, a.n""")
def latency_stats(spark, sf_dir):
    """Mean, median and un-interpolated p95 latency per endpoint."""
    lat = V.latency(spark, sf_dir)
    return RL.latency_stats(lat, "endpoint", "ms")


@register("capped_eval_mean", ("AG16", "SL4"), sql=f"""
WITH {V.DUCK_SAMPLES},
t AS (SELECT *, row_number() OVER (PARTITION BY task_id, phase ORDER BY sample_id) AS rn FROM samples)
SELECT task_id, phase, COUNT(*) AS n,
       CAST(ROUND(CAST(AVG(CAST(reward_dec AS DECIMAL(28,8))) AS DECIMAL(38,10)), 6) AS DOUBLE) AS mean
FROM t WHERE rn <= {CAPPED_N} GROUP BY task_id, phase""")
def capped_eval_mean(spark, sf_dir):
    """Mean reward over the first eight samples of each (task, phase) dataset."""
    return RL.capped_mean(_samples(spark, sf_dir), ["task_id", "phase"], ["sample_id"], "reward", CAPPED_N)
