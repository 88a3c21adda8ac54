"""Registered step / episode queries on the ``steps`` view (RW1-RW10, WN3-WN10, EP1-EP8, AG15, AG23, AG24, SRC9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from queryforge.functions import scalar as S
from queryforge.operators import episodes as EPI
from queryforge.operators import screening as SC
from queryforge.operators.scan import ordinal
from queryforge.plans import views as V
from queryforge.plans.registry import ORACLE, register
from queryforge.sources.tasks import task_catalog


def folded(spark, sf_dir):
    return EPI.fold_episodes(V.steps(spark, sf_dir), task_catalog(spark))


def _hist_text(col):
    return F.array_join(F.transform(col, lambda x: F.format_string("%.4f", x)), ",")


# --------------------------------------------------------- DuckDB twins ---
def duck_reward_sql(a="action_type", g="grade_used", ok="query_success", msg="error_message", q="query",
                    tables="tables", step="step", mx="max_steps", prev="prev_best") -> str:
    """The reward rules as DuckDB expressions (double literals written with exponents)."""
    m = f"lower(coalesce({msg}, ''))"
    syn = (f"CASE WHEN {a} = 'submit_query' THEN (CASE WHEN {ok} IS NULL THEN 0e0 WHEN {ok} THEN 1e-1 "
           f"WHEN contains({m}, 'no such column') OR contains({m}, 'unresolved_column') THEN 3e-2 "
           f"WHEN contains({m}, 'no such table') OR contains({m}, 'table_or_view_not_found') THEN 1e-2 ELSE 0e0 END) "
           f"WHEN {a} IN ('inspect_schema', 'inspect_error', 'inspect_sample') THEN 1e-2 ELSE 0e0 END")
    cor = f"CASE WHEN {a} = 'submit_query' THEN LEAST(6e-1, {g} * 6e-1) ELSE 0e0 END"
    sch = (f"CASE WHEN {a} = 'submit_query' AND {q} IS NOT NULL AND length({q}) > 0 AND len({tables}) > 0 THEN "
           f"LEAST(1e-1, len(list_filter({tables}, lambda t: contains(upper({q}), upper(t)))) / len({tables}) * 1e-1) "
           f"ELSE 0e0 END")
    frac = f"(CAST({step} AS DOUBLE) / CAST({mx} AS DOUBLE))"
    eff = (f"CASE WHEN {a} = 'submit_query' AND {g} >= 9.5e-1 THEN (CASE WHEN {frac} <= 3e-1 THEN 2e-1 "
           f"WHEN {frac} <= 5e-1 THEN 1.5e-1 WHEN {frac} <= 7e-1 THEN 1e-1 ELSE 5e-2 END) ELSE 0e0 END")
    pen = (f"((CASE WHEN {a} = 'submit_query' AND {g} < {prev} - 1e-1 THEN 5e-2 WHEN {a} = 'reset_query' THEN 5e-2 "
           f"ELSE 0e0 END) + (CASE WHEN {mx} - {step} <= 2 AND {g} < 5e-1 THEN 3e-2 ELSE 0e0 END))")
    return (f"{cor} AS correctness, {eff} AS efficiency, {syn} AS syntax_progress, {sch} AS schema_bonus, "
            f"{pen} AS penalty")


def duck_fold_sql(keys: str = "session_id", source: str = "steps") -> str:
    """CTE chain ``f`` = folded steps, mirroring ``fold_episodes``."""
    return f"""
s0 AS (SELECT s.*, s.success AS query_success, t.difficulty, t.max_steps, t.hint, t.hint_step, t.broken_query, t.tables,
         t.success_threshold,
         row_number() OVER (PARTITION BY {keys} ORDER BY s.ts, s.event_id) AS step
       FROM {source} s JOIN tasks t ON t.task_id = s.task_id),
s1 AS (SELECT *, GREATEST(1e-3, COALESCE(MAX(CASE WHEN action_type = 'submit_query' THEN grade END)
          OVER (PARTITION BY {keys} ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e-3)) AS prev_best
       FROM s0 WHERE step <= max_steps),
s2 AS (SELECT *, CASE WHEN action_type = 'submit_query' THEN grade ELSE prev_best END AS grade_used,
         GREATEST(prev_best, COALESCE(CASE WHEN action_type = 'submit_query' THEN grade END, 1e-3)) AS current_score
       FROM s1),
s3 AS (SELECT *, {duck_reward_sql()} FROM s2),
s4 AS (SELECT *, ROUND(LEAST(9.99e-1, GREATEST(1e-3, correctness + efficiency + syntax_progress + schema_bonus - penalty)), 4) AS reward,
         (grade_used >= 9.5e-1) OR (step >= max_steps) AS is_done,
         (grade_used >= 9.5e-1) OR (step >= max_steps AND current_score >= 5e-1) AS ep_success
       FROM s3),
s5 AS (SELECT *, MIN(CASE WHEN is_done THEN step END) OVER (PARTITION BY {keys}) AS first_done FROM s4),
f AS (SELECT *,
    printf('correctness=%.3f + efficiency=%.3f + syntax=%.3f + schema=%.3f + penalty=%.3f = %.4f',
           correctness, efficiency, syntax_progress, schema_bonus, penalty, reward) AS breakdown,
    CASE WHEN action_type = 'inspect_error' THEN
      CASE WHEN step = 1 THEN 'No query has been submitted yet.'
           ELSE LAG(error_message, 1) OVER (PARTITION BY {keys} ORDER BY step) END END AS error_details,
    LAST(CASE WHEN action_type = 'submit_query' THEN query WHEN action_type = 'reset_query' THEN broken_query END IGNORE NULLS)
      OVER (PARTITION BY {keys} ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_query,
    CASE WHEN step >= hint_step THEN hint END AS hint_shown,
    array_to_string(list_transform(LIST(reward) OVER (PARTITION BY {keys} ORDER BY step
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda x: printf('%.4f', x)), ',') AS reward_history,
    GREATEST(0, max_steps - step) AS steps_remaining
  FROM s5 WHERE first_done IS NULL OR step <= first_done)"""


_FOLD = f"WITH {V.DUCK_STEPS},{duck_fold_sql()}"

REWARD_COLS = ["session_id", "step", "action_type", "prev_best", "grade_used", "correctness", "efficiency",
               "syntax_progress", "schema_bonus", "penalty", "reward", "breakdown"]


@register("step_rewards", ("RW1", "RW2", "RW3", "RW4", "RW5", "RW6", "RW7", "RW8", "RW9", "RW10", "WN3", "WN4",
                           "SC5", "SF9", "SF17", "SF26"), sql=f"""
{_FOLD}
SELECT {", ".join(REWARD_COLS)} FROM f""")
def step_rewards(spark, sf_dir):
    """Per accepted step: the previous best, the grade used and every reward component."""
    return folded(spark, sf_dir).select(*REWARD_COLS)


@register("episode_fold", ("EP1", "EP3", "EP4", "WN5", "WN6", "WN9", "WN10", "PRJ10"), sql=f"""
{_FOLD}
SELECT session_id, step, task_id, current_score, is_done, ep_success AS success, error_details, current_query,
       hint_shown, steps_remaining, reward_history FROM f""")
def episode_fold(spark, sf_dir):
    """Episode state after each accepted step (cut after the first finishing step)."""
    f = folded(spark, sf_dir)
    return f.select("session_id", "step", "task_id", "current_score", "is_done", "success", "error_details",
                    "current_query", "hint_shown", "steps_remaining",
                    _hist_text(F.col("reward_history")).alias("reward_history"))


@register("session_snapshot", ("EP5",), sql=f"""
{_FOLD}
SELECT session_id, arg_max(task_id, step) AS task_id, MAX(step) AS step, arg_max(current_score, step) AS current_score,
       arg_max(is_done, step) AS is_done, arg_max(ep_success, step) AS success, arg_max(reward, step) AS reward
FROM f GROUP BY session_id""")
def session_snapshot(spark, sf_dir):
    return EPI.session_snapshot(folded(spark, sf_dir), state_cols=(
        "task_id", "step", "current_score", "is_done", "success", "reward"))


# ---------------------------------------------------------------- EP6 ---
@register("episode_restarts", ("EP6",), sql=f"""
WITH {V.DUCK_STEPS},
m AS (SELECT *, CASE WHEN LAG(CAST(ts AS DATE)) OVER (PARTITION BY session_id ORDER BY ts, event_id) IS NULL
                      OR LAG(CAST(ts AS DATE)) OVER (PARTITION BY session_id ORDER BY ts, event_id) <> CAST(ts AS DATE)
                     THEN 1 ELSE 0 END AS mark FROM steps),
ep AS (SELECT * EXCLUDE (mark), SUM(mark) OVER (PARTITION BY session_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode_no FROM m),
{duck_fold_sql("session_id, episode_no", "ep")}
SELECT session_id, CAST(episode_no AS BIGINT) AS episode_no, MAX(step) AS steps, arg_max(reward, step) AS last_reward,
       MAX(current_score) AS best_score, bool_or(ep_success) AS success
FROM f GROUP BY session_id, episode_no""")
def episode_restarts(spark, sf_dir):
    """A user's first event of each day restarts the episode: segmented fold in one pass, one summary row per episode."""
    f = EPI.fold_episodes(V.steps(spark, sf_dir).withColumn("day", F.to_date("ts")), task_catalog(spark), on_change="day")
    return f.groupBy("session_id", "episode_no").agg(
        F.max("step").alias("steps"), F.max_by("reward", "step").alias("last_reward"),
        F.max("current_score").alias("best_score"), F.bool_or("success").alias("success")
    ).withColumn("episode_no", F.col("episode_no").cast("long"))


# --------------------------------------------------------------- RW11 ---
_REVIEWED = """
rv AS (SELECT s.* REPLACE (CASE WHEN s.action_type = 'submit_query' AND s.event_id % 7 = 0 THEN 'DELETE FROM ' || t.tables[1] || ';'
                                WHEN s.action_type = 'submit_query' AND s.event_id % 7 = 1 THEN 'SELECT 1' ELSE s.query END AS query),
              s.action_type = 'submit_query' AND s.event_id % 7 <= 1 AS rejected,
              CASE WHEN s.event_id % 7 = 0 THEN 'Only SELECT queries or CTEs (WITH) are allowed.'
                   ELSE 'Query does not reference any valid tables. Available: [''' || array_to_string(t.tables, ''', ''') || ''']' END AS reason
       FROM steps s JOIN tasks t ON t.task_id = s.task_id),
ok AS (SELECT * EXCLUDE (rejected, reason) FROM rv WHERE NOT rejected)"""


def reviewed_steps(spark, sf_dir):
    """``steps`` in which every seventh event that submits deletes, and the next selects from no table, with the review's verdict."""
    st = V.steps(spark, sf_dir).join(F.broadcast(task_catalog(spark).select("task_id", F.col("tables").alias("known"))), "task_id")
    part = F.when(F.col("action_type") == "submit_query", F.col("event_id") % 7)
    st = st.withColumn("query", F.when(part == 0, F.concat(F.lit("DELETE FROM "), F.element_at("known", 1), F.lit(";")))
                       .when(part == 1, F.lit("SELECT 1")).otherwise(F.col("query")))
    approved, reason = SC.review_columns("query", F.col("known"))
    return st.withColumns({"approved": approved, "reason": reason}).drop("known")


@register("reviewed_episode_fold", ("EP1", "RW11", "SC4"), sql=f"""
WITH {V.DUCK_STEPS}, {_REVIEWED.strip()}, {duck_fold_sql(source="ok").strip()},
r AS (SELECT rv.session_id, rv.event_id, rv.query, rv.reason, t.max_steps, t.hint, t.hint_step, COUNT(f.step) AS step,
             COALESCE(arg_max(f.current_score, f.step), 1e-3) AS current_score, arg_max(f.current_query, f.step) AS current_query,
             COALESCE(string_agg(printf('%.4f', f.reward), ',' ORDER BY f.step), '') AS reward_history
      FROM rv JOIN tasks t ON t.task_id = rv.task_id
      LEFT JOIN f ON f.session_id = rv.session_id AND (f.ts < rv.ts OR (f.ts = rv.ts AND f.event_id < rv.event_id))
      WHERE rv.rejected GROUP BY ALL)
SELECT session_id, event_id, step, false AS review_rejected, reward, current_score, is_done, ep_success AS success, error_details, current_query,
       hint_shown, steps_remaining, reward_history FROM f
UNION ALL
SELECT session_id, event_id, step, true, 1e-3, current_score, false, false, 'REVIEWER REJECTION: ' || reason, current_query,
       CASE WHEN step >= hint_step THEN hint END, GREATEST(0, max_steps - step), reward_history FROM r""")
def reviewed_episode_fold(spark, sf_dir):
    """Episode state after each action when submits are reviewed first: rejected ones earn 0.001 and use no step."""
    f = EPI.fold_episodes(reviewed_steps(spark, sf_dir), task_catalog(spark), approved="approved", reason="reason")
    return f.select("session_id", "event_id", "step", "review_rejected", "reward", "current_score", "is_done", "success", "error_details",
                    "current_query", "hint_shown", "steps_remaining", _hist_text(F.col("reward_history")).alias("reward_history"))


# --------------------------------------------------------------- EP7/8 ---
IDLE_GAP_HOURS = 6


@register("idle_sessions", ("EP7",), sql=f"""
WITH e AS (SELECT user_id, ts, event_id,
             CASE WHEN LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                    OR epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))
                       >= {IDLE_GAP_HOURS} * 3600000000 THEN 1 ELSE 0 END AS new_session FROM events),
g AS (SELECT *, SUM(new_session) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sno FROM e)
SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       strftime(MAX(ts) + INTERVAL {IDLE_GAP_HOURS} HOUR, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
       COUNT(*) AS n_events
FROM g GROUP BY user_id, sno""")
def idle_sessions(spark, sf_dir):
    """Activity sessions closed after 6 hours without events (merged segments)."""
    ev = V.T(spark, sf_dir, "events").select("user_id", "ts")
    out = EPI.idle_sessions(ev, "user_id", "ts", f"{IDLE_GAP_HOURS} hours")
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return out.select("user_id", F.date_format("session_start", fmt).alias("session_start"),
                      F.date_format("session_end", fmt).alias("session_end"), "n_events")


@register("active_sessions", ("EP8",), sql="""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, COUNT(DISTINCT user_id) AS active_sessions
FROM events GROUP BY date_trunc('hour', ts)""")
def active_sessions(spark, sf_dir):
    ev = V.T(spark, sf_dir, "events").select("user_id", "ts")
    out = EPI.active_sessions(ev, "user_id", "ts", "1 hour")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "active_sessions")


# ------------------------------------------------------ run reports ---
@register("run_report", ("AG24",), sql=f"""
{_FOLD}
, last AS (SELECT session_id, arg_max(task_id, step) AS task_id, MAX(step) AS steps,
             arg_max(grade_used, step) AS g, arg_max(current_score, step) AS c,
             arg_max(success_threshold, step) AS thr,
             array_to_string(list(printf('%.4f', reward) ORDER BY step), ',') AS rewards
           FROM f GROUP BY session_id)
SELECT session_id, task_id, steps, rewards,
       LEAST(9.99e-1, GREATEST(1e-3, COALESCE(NULLIF(g, 0e0), NULLIF(c, 0e0), 1e-3))) AS score,
       LEAST(9.99e-1, GREATEST(1e-3, COALESCE(NULLIF(g, 0e0), NULLIF(c, 0e0), 1e-3))) >= thr AS success
FROM last""")
def run_report(spark, sf_dir):
    """Per episode: final score (first non-zero of last grade, current score, 0.001), success by
    the task threshold, steps and the reward list."""
    f = folded(spark, sf_dir)
    last = f.groupBy("session_id").agg(
        F.max_by("task_id", "step").alias("task_id"), F.max("step").alias("steps"),
        F.max_by("grade_used", "step").alias("g"), F.max_by("current_score", "step").alias("c"),
        F.max_by("success_threshold", "step").alias("thr"),
        F.sort_array(F.collect_list(F.struct("step", "reward"))).alias("r"))
    score = S.clamp(F.coalesce(F.nullif("g", F.lit(0.0)), F.nullif("c", F.lit(0.0)), F.lit(S.MIN_SCORE)))
    return last.select("session_id", "task_id", "steps",
                       _hist_text(F.col("r.reward")).alias("rewards"),
                       score.alias("score"), (score >= F.col("thr")).alias("success"))


@register("threshold_accuracy", ("AG23",), sql=f"""
{_FOLD}
, ep AS (SELECT session_id, arg_max(task_id, step) AS task_id, arg_max(current_score, step) AS score,
           arg_max(success_threshold, step) AS thr FROM f GROUP BY session_id),
st AS (SELECT task_id, AVG(CASE WHEN reward > 1e-1 THEN 1e0 ELSE 0e0 END) * 1e2 AS pct_reward_over_0_1,
              AVG(CASE WHEN reward > 5e-1 THEN 1e0 ELSE 0e0 END) * 1e2 AS pct_reward_over_0_5 FROM f GROUP BY task_id),
se AS (SELECT task_id, AVG(CASE WHEN score >= thr THEN 1e0 ELSE 0e0 END) * 1e2 AS pct_solved FROM ep GROUP BY task_id)
SELECT st.task_id, ROUND(pct_reward_over_0_1, 6) AS pct_reward_over_0_1, ROUND(pct_reward_over_0_5, 6) AS pct_reward_over_0_5,
       ROUND(pct_solved, 6) AS pct_solved
FROM st JOIN se ON st.task_id = se.task_id""")
def threshold_accuracy(spark, sf_dir):
    """Accuracy percent per task at fixed reward thresholds and at the task's own success threshold.

    One pass over the fold: per-session counts first (bounded groups), then per task.
    """
    f = folded(spark, sf_dir)
    ep = f.groupBy("session_id").agg(
        F.max_by("task_id", "step").alias("task_id"), F.max_by("current_score", "step").alias("score"),
        F.max_by("success_threshold", "step").alias("thr"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("reward") > 0.1).alias("a"), F.count_if(F.col("reward") > 0.5).alias("b"))
    per = ep.groupBy("task_id").agg(
        F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("e"),
        F.count_if(F.col("score") >= F.col("thr")).alias("c"))
    pct = lambda x, n: F.round(F.col(x).cast("double") / F.col(n).cast("double") * F.lit(100.0), 6)
    return per.select("task_id", pct("a", "n").alias("pct_reward_over_0_1"), pct("b", "n").alias("pct_reward_over_0_5"),
                      pct("c", "e").alias("pct_solved"))


_FIRST_SUBMIT = """
, fs AS (SELECT session_id, arg_min(task_id, step) AS task_id, arg_min(reward, step) AS reward,
           arg_min(is_done, step) AS done, arg_min(query_success, step) AS ok
         FROM f WHERE action_type = 'submit_query' GROUP BY session_id)"""


def _first_submits(spark, sf_dir):
    f = folded(spark, sf_dir).where(F.col("action_type") == "submit_query")
    return f.groupBy("session_id").agg(
        F.min_by("task_id", "step").alias("task_id"), F.min_by("reward", "step").alias("reward"),
        F.min_by("is_done", "step").alias("done"), F.min_by("query_success", "step").alias("ok"))


@register("suite_report", ("AG15",), sql=f"""
{_FOLD}{_FIRST_SUBMIT}
SELECT task_id, COUNT(*) AS n_presets, ROUND(COALESCE(AVG(reward), 0e0), 4) AS avg_reward,
       ROUND(COALESCE(MIN(reward), 0e0), 4) AS min_reward, ROUND(COALESCE(MAX(reward), 0e0), 4) AS max_reward,
       COUNT_IF(done) AS done_count, COUNT_IF(NOT ok) AS error_count
FROM fs GROUP BY task_id""")
def suite_report(spark, sf_dir):
    """Per task over every session's first submit: avg/min/max reward, done and error counts."""
    fs = _first_submits(spark, sf_dir)
    return fs.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_presets"),
        F.round(F.coalesce(F.avg("reward"), F.lit(0.0)), 4).alias("avg_reward"),
        F.round(F.coalesce(F.min("reward"), F.lit(0.0)), 4).alias("min_reward"),
        F.round(F.coalesce(F.max("reward"), F.lit(0.0)), 4).alias("max_reward"),
        F.count_if("done").alias("done_count"), F.count_if(~F.col("ok")).alias("error_count"))


@register("suite_rows", ("SL5", "SF23"), sql=f"""
{_FOLD}{_FIRST_SUBMIT}
SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY session_id) AS idx, session_id,
       printf('%.3f', reward) AS reward_text, done,
       CASE WHEN reward >= 5e-1 THEN 'pass' ELSE 'check' END AS label
FROM fs""")
def suite_rows(spark, sf_dir):
    """Enumerated report rows (1-based per task, skew-safe ordinal) with pass/check labels."""
    fs = _first_submits(spark, sf_dir)
    out = ordinal(fs, ["task_id"], ["session_id"], "idx")
    return out.select("task_id", "idx", "session_id", S.py_fixed("reward", 3).alias("reward_text"), "done",
                      S.pass_label("reward").alias("label"))


# --------------------------------------------------------------- SRC9 ---
@register("run_log_lines", ("SRC9", "SF16", "SF17"), sql=f"""
{_FOLD}
, lines AS (
  SELECT session_id, 0 AS line_no,
         printf('[START] task=%s env=queryforge model=replay', arg_min(task_id, step)) AS line FROM f GROUP BY session_id
  UNION ALL
  SELECT session_id, step AS line_no,
         printf('[STEP] step=%d action="%s" reward=%.4f done=%s error=%s', step,
           left(replace(replace(COALESCE(query, action_type), chr(10), '\\n'), '"', '\\"'), 200),
           reward, CASE WHEN is_done THEN 'true' ELSE 'false' END, COALESCE(error_message, 'null')) FROM f
  UNION ALL
  SELECT session_id, 1000000 AS line_no,
         printf('[END] success=%s steps=%d score=%.4f rewards=[%s]',
           CASE WHEN arg_max(ep_success, step) THEN 'true' ELSE 'false' END, MAX(step), arg_max(current_score, step),
           array_to_string(list(CAST(ROUND(reward, 4) AS VARCHAR) ORDER BY step), ', ')) FROM f GROUP BY session_id)
SELECT session_id, line_no, line FROM lines""")
def run_log_lines(spark, sf_dir):
    """Exact [START]/[STEP]/[END] log lines per episode as a text table.

    One pass: the folded steps are grouped per session (an episode has at most
    30 steps, so the group is bounded), the lines are built as an ordered array
    and exploded back to rows.
    """
    f = folded(spark, sf_dir)
    action = S.one_line(F.coalesce("query", "action_type"), 200)
    step_line = F.format_string('[STEP] step=%d action="%s" reward=%.4f done=%s error=%s', "step", action, "reward",
                                S.bool_text("is_done"), F.coalesce("error_message", F.lit("null")))
    g = f.groupBy("session_id").agg(
        F.min_by("task_id", "step").alias("t"), F.max_by("success", "step").alias("ok"), F.max("step").alias("n"),
        F.max_by("current_score", "step").alias("sc"),
        F.sort_array(F.collect_list(F.struct(F.col("step").alias("line_no"), step_line.alias("line"),
                                             F.col("reward").alias("r")))).alias("steps"))
    start = F.struct(F.lit(0).cast("long").alias("line_no"),
                     F.format_string("[START] task=%s env=queryforge model=replay", "t").alias("line"))
    end = F.struct(F.lit(1000000).cast("long").alias("line_no"), F.format_string(
        "[END] success=%s steps=%d score=%.4f rewards=[%s]", S.bool_text("ok"), "n", "sc",
        F.array_join(F.transform("steps", lambda x: F.round(x["r"], 4).cast("string")), ", ")).alias("line"))
    mid = F.transform("steps", lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line")))
    lines = F.concat(F.array(start), mid, F.array(end))
    return g.select("session_id", F.explode(lines).alias("l")).select("session_id", "l.line_no", "l.line")


@register("first_actions_json", ("SF18", "SF25", "WN10"), sql=f"""
{_FOLD}
SELECT session_id,
       CAST(to_json(list_slice(list({{'step': step, 'action_type': action_type}} ORDER BY step), 1, 3)) AS VARCHAR) AS first_actions
FROM f GROUP BY session_id""")
def first_actions_json(spark, sf_dir):
    """JSON text of each episode's first three actions (ordered list, sliced, serialised)."""
    f = folded(spark, sf_dir)
    acts = F.sort_array(F.collect_list(F.struct(F.col("step").cast("long").alias("step"), "action_type")))
    return f.groupBy("session_id").agg(F.to_json(S.first_rows(acts, 3)).alias("first_actions"))


@register("task_catalog_usage", ("SRC4", "JN12", "UD2"), sql=f"""
WITH {V.DUCK_STEPS}
SELECT t.task_id, t.difficulty, t.max_steps, t.grader, COUNT(DISTINCT s.session_id) AS sessions, COUNT(*) AS events
FROM steps s JOIN tasks t ON t.task_id = s.task_id
GROUP BY t.task_id, t.difficulty, t.max_steps, t.grader""")
def task_catalog_usage(spark, sf_dir):
    """The task catalog (broadcast dimension) joined to the sessions that use each task."""
    from queryforge.operators.grading import with_task
    st = V.steps(spark, sf_dir).select("task_id", "session_id")
    j = with_task(st, task_catalog(spark), cols=["difficulty", "max_steps", "grader"])
    return j.groupBy("task_id", "difficulty", "max_steps", "grader").agg(
        F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("events"))


@register("stream_episode_fold", ("EP2",), sql=f"""
{_FOLD}
SELECT {", ".join(REWARD_COLS)} FROM f""")
def stream_episode_fold(spark, sf_dir):
    """EP2: the same fold as a Structured Streaming job (keyed state, availableNow); equals step_rewards."""
    from queryforge.streaming.episodes import run_stream_fold
    return run_stream_fold(spark, sf_dir).select(*REWARD_COLS)


REPLAY_COLS = ["session_id", "event_id", "step", "review_rejected", "reward", "current_score", "is_done", "success", "error_details",
               "current_query", "hint_shown", "steps_remaining"]


@register("replayed_episode_fold", ("EP2", "RW11"), sql=ORACLE["reviewed_episode_fold"].replace(", reward_history FROM f", " FROM f")
          .replace(", reward_history FROM r", " FROM r"))
def replayed_episode_fold(spark, sf_dir):
    """EP2: the reviewed steps replayed as a stream in three slices of time, every tenth event a slice too late; equals the batch fold."""
    from queryforge.streaming.episodes import fold_stream, replay

    parts, delay = _slices(reviewed_steps(spark, sf_dir), "session_id")
    out = replay(spark, parts, lambda rows: fold_stream(spark, rows, delay=delay), "replayed-fold")
    return out.where("session_id <> -1").select(*REPLAY_COLS)


def _slices(rows, key):
    """Three slices of time in which rows arrive, every tenth one slice too late, and how late they are at most.

    A row a year on, of a session -1, comes with the last slice and moves the watermark past all others.
    """
    days = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(
        "a", "b", F.expr("a + (b - a) / 3").alias("x"), F.expr("a + (b - a) / 3 * 2").alias("y")).first()
    own = F.when(F.col("ts") < F.lit(days["x"]), 0).when(F.col("ts") < F.lit(days["y"]), 1).otherwise(2)
    arrives = F.least(F.lit(2), own + F.when(F.col("event_id") % 10 == 3, 1).otherwise(0))
    parts = [rows.where(arrives == i) for i in range(3)]
    end = rows.where(F.col("ts") == F.lit(days["b"])).limit(1).withColumns({
        key: F.lit(-1).cast("long"), "ts": F.col("ts") + F.expr("INTERVAL 365 days")})
    return [*parts[:2], parts[2].unionByName(end)], f"{int((days['b'] - days['a']).total_seconds()) + 1} seconds"


@register("replayed_active_sessions", ("EP8",), sql=ORACLE["active_sessions"])
def replayed_active_sessions(spark, sf_dir):
    """EP8: distinct sessions per hour of the replayed events stream, late ones included; equals the batch counts."""
    from queryforge.streaming.episodes import replay, stream_active_sessions

    parts, delay = _slices(V.T(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id")
    out = replay(spark, parts, lambda rows: stream_active_sessions(rows, "user_id", "ts", "1 hour", delay), "replayed-active")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "active_sessions")
