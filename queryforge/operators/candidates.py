"""Executing submitted SQL and rewarding completions (GR8, RW14, UD1).

``run_candidates`` is the one place where a driver loop is the right tool:
each candidate is a *query text* that Spark must parse and plan, so the loop
runs over the texts - all of them, held on the driver, with no bound - while
every query body runs as a distributed Spark job over the full tables.  It is
meant for the presets of a task or one batch of a trainer.  Results come back
as DataFrames in long form with explicit positions, ready for the grading
operators - no result row is collected on the driver.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryforge.functions import scalar as S
from queryforge.functions import text as X
from queryforge.operators.grading import grade_positional
from queryforge.operators.reward import with_step_reward
from queryforge.operators.scan import ordinal
from queryforge.operators.screening import analyse_query
from queryforge.session import checkpoint_dir
from queryforge.sources.tables import local_frame

RUN_SCHEMA = T.StructType([
    T.StructField("candidate_id", T.LongType(), False),
    T.StructField("success", T.BooleanType(), False),
    T.StructField("row_count", T.LongType(), True),
    T.StructField("error_message", T.StringType(), True),
    T.StructField("execution_time_ms", T.DoubleType(), False),
])


def _error_text(e: Exception) -> str:
    cond = getattr(e, "getCondition", None)
    name = cond() if callable(cond) else None
    message = str(e).strip() or type(e).__name__
    return f"[{name}] {message}" if name and name not in message else message


def run_candidates(spark: SparkSession, candidates: DataFrame, value_cols: Sequence[str],
                   id_col: str = "candidate_id", sql_col: str = "sql") -> tuple[DataFrame, DataFrame]:
    """GR8: execute each candidate text; return (outcomes, long-form result rows).

    Outcomes: candidate_id, success, row_count, error_message, execution_time_ms.
    The write guard runs first (blocked texts never reach the engine);
    duplicate output names are rejected (the row-dict form would silently keep
    the last).  Result rows: candidate_id, pos (1-based, in the query's own
    order) and ``value_cols`` matched by normalised name; a result whose name
    set differs contributes no rows to grade (it can only score the empty case).
    """
    checkpoint_dir(spark)
    texts = candidates.select(id_col, sql_col, X.guard_message(X.write_guard(sql_col)).alias("_kw")).collect()
    outcomes, frames = [], []
    want = [c.lower() for c in value_cols]
    for r in texts:
        cid, q, kw = r[0], r[1], r[2]
        t0 = time.perf_counter()
        if kw is not None:
            outcomes.append((cid, False, None, kw, 0.0))
            continue
        try:
            analyse_query(spark, q)  # a query and no command, checked before it reaches the engine
            df = spark.sql(q)
            names = [c.strip().lower() for c in df.columns]
            if len(set(names)) != len(names):
                raise ValueError("DUPLICATE_OUTPUT_NAMES: result has repeated column names")
            # run the query once: its rows, tagged with ids that follow the query's
            # own order, are checkpointed to the shared folder (reliable, lineage cut)
            done_df = df.withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
            cnt = done_df.count()
            ms = round((time.perf_counter() - t0) * 1000, 2)
            outcomes.append((cid, True, cnt, None, ms))
            if sorted(names) == sorted(want):
                by = {c.strip().lower(): c for c in df.columns}
                keyed = done_df.select(*[F.col(f"`{by[w]}`").alias(v) for w, v in zip(want, value_cols)],
                                       "_mid").withColumn(id_col, F.lit(cid))
                # the skew-safe ordinal turns the ids into dense 1-based positions
                frames.append(ordinal(keyed, [id_col], ["_mid"], "pos").drop("_mid"))
        except Exception as e:  # noqa: BLE001 - every failure becomes an outcome row
            ms = round((time.perf_counter() - t0) * 1000, 2)
            outcomes.append((cid, False, None, _error_text(e), ms))
    out = local_frame(spark, [(int(a), bool(b), c, d, float(e)) for a, b, c, d, e in outcomes], RUN_SCHEMA)
    rows = None
    for f in frames:
        rows = f if rows is None else rows.unionByName(f, allowMissingColumns=True)
    return out, rows


def batch_reward(spark: SparkSession, completions: DataFrame, expected: DataFrame, value_cols: Sequence[str],
                 tables: Sequence[str], max_steps: int, marker: str = X.SQL_MARKER,
                 jitter_seed: int | None = None) -> DataFrame:
    """RW14 / UD1: reward a table of completions for one task.

    completion_id, text -> extract SQL after the marker (empty: 0.0), run it
    (GR8), grade positionally against ``expected`` (pos + value columns), and
    reward it as the first submit of a fresh episode.  A failing query still
    earns its step reward, as the environment answers it; an empty text is 0.0.
    Optional seeded +-1e-6 jitter.
    """
    c = completions.select(F.col("completion_id").alias("candidate_id"), X.after_first("text", marker).alias("sql"))
    runnable = c.where(F.length("sql") > 0)
    outcomes, rows = run_candidates(spark, runnable, value_cols)
    exp = expected.withColumn("task_key", F.lit(0))
    if rows is None:
        rows = local_frame(spark, [], exp.drop("task_key").schema).withColumn("candidate_id", F.lit(0).cast("long"))
    act = rows.withColumn("task_key", F.lit(0))
    idx = outcomes.where("success").select("candidate_id", F.lit(0).alias("task_key"))
    g = grade_positional(act, exp, "task_key", ["candidate_id"], list(value_cols), attempt_index=idx)
    scored = outcomes.join(g.select("candidate_id", F.col("score").alias("grade")), "candidate_id", "left")
    scored = scored.withColumns({
        "action_type": F.lit("submit_query"), "grade_used": F.coalesce("grade", F.lit(S.MIN_SCORE)),
        "query_success": F.col("success"), "step": F.lit(1), "max_steps": F.lit(max_steps),
        "prev_best": F.lit(S.MIN_SCORE), "tables": F.array(*[F.lit(t) for t in tables])})
    scored = scored.join(c, "candidate_id").withColumn("query", F.col("sql"))
    scored = with_step_reward(scored, success="query_success")
    reward = F.col("reward")
    if jitter_seed is not None:
        reward = reward + S.jitter(jitter_seed)
    base = completions.select(F.col("completion_id").alias("candidate_id"))
    return base.join(scored.select("candidate_id", "sql", "success", "error_message", "grade_used",
                                   reward.alias("reward")), "candidate_id", "left").select(
        F.col("candidate_id").alias("completion_id"), "sql", F.coalesce("success", F.lit(False)).alias("success"),
        "error_message", F.col("grade_used").alias("grade"), F.coalesce("reward", F.lit(0.0)).alias("reward"))
