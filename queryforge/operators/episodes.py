"""Episode folds over step tables (WN3-WN6, WN9-WN10, EP1, EP3-EP8, PRJ10).

Plan shape of ``fold_episodes``: one shuffle on the session keys.  Step
numbers come from ``row_number() <= the largest max_steps``, which Spark plans with
a partial WindowGroupLimit *before* the shuffle: a session can never use more
steps than the longest task allows (later actions are refused), so even a
session with a third of all events ships at most 30 rows per map task.  All
later windows run over at most 30 rows per episode and share one sort.  Texts
of the tasks, the same in a quarter of all rows, are joined (broadcast) after
the sorts: a shuffle packs them small and a sort unpacks them into memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queryforge.functions import scalar as S
from queryforge.operators.reward import SUCCESS_GRADE, with_step_reward
from queryforge.operators.scan import default_chunk, first_k, ordered_scan
from queryforge.sources.tables import stored

# --- fixed values: episode texts and thresholds ---
NO_QUERY_YET = "No query has been submitted yet."
LAST_STEP_SUCCESS = 0.5
REJECTED = "REVIEWER REJECTION: "

TASK_COLS = ["task_id", "difficulty", "max_steps", "hint", "hint_step", "broken_query", "tables",
             "success_threshold", "description", "expected_output_description"]


def _longest(tasks: DataFrame) -> int:
    """The largest step budget; the catalog is a literal, so this runs no job."""
    budgets = [r[0] for r in tasks.select("max_steps").collect() if r[0] is not None]
    if not budgets:
        raise ValueError("tasks without max_steps: the length of an episode is unknown")
    return int(max(budgets))


def number_steps(steps: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int, admitted: Column | None = None,
                 restart: str | None = None, on_change: str | None = None, chunk: Column | None = None) -> DataFrame:
    """EP6: ``episode_no`` and ``step`` of every row in one ordered pass; rows beyond ``limit`` steps of their episode go.

    ``step`` counts the ``admitted`` rows (default: all) of the episode up to this one; others are kept and count for nothing.
    ``restart``: a boolean column, true where an episode begins (numbers start at 0 before the first of them).
    ``on_change``: an episode begins where this column differs from the row before (numbers start at 1).

    A key is cut into chunks as in ``ordered_scan``.  Chunks are numbered by themselves and cut to ``limit`` rows of each
    episode; that is written once, and the input is not read again.  Then chunks merge: a summary of each (episodes begun,
    steps of the last one, first and last value) gets a segmented prefix over the chunks of its key.
    """
    keys, order = list(keys), list(order)
    d = steps.withColumns({"_admitted": F.lit(1) if admitted is None else F.when(admitted, F.lit(1)).otherwise(F.lit(0)),
                           "_chunk": chunk if chunk is not None else default_chunk(steps, order[0])})
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mark = None
    if restart:
        mark = F.when(F.col(restart), F.lit(1)).otherwise(F.lit(0))
    elif on_change:
        d = d.withColumn("_value", F.struct(on_change))
        d = d.withColumns({"_before": F.lag("_value").over(w), "_from": F.first("_value").over(whole), "_to": F.last("_value").over(whole)})
        mark = F.when(F.col("_before").isNotNull() & (F.col("_before") != F.col("_value")), F.lit(1)).otherwise(F.lit(0))
    in_part = upto
    if mark is None:  # one episode: no other order than the chunk's
        d = d.withColumn("_part", F.lit(0).cast("long"))
    else:
        d = d.withColumn("_mark", mark).withColumn("_part", F.sum("_mark").over(upto))
        in_part = Window.partitionBy(*keys, "_chunk", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_at", F.sum("_admitted").over(in_part)).where((F.col("_at") <= limit) | (F.col("_admitted") == 0))
    d = stored(d.withColumn("_id", F.struct(*keys, "_chunk")).drop("_mark", "_value", "_before", "_chunk"), "numbered-steps")

    values = [F.first("_from").alias("_from"), F.first("_to").alias("_to")] if on_change and not restart else []
    s = d.groupBy("_id").agg(F.max(F.struct("_part", F.least(F.col("_at"), F.lit(limit)).alias("n"))).alias("_end"), *values)
    of = [F.col(f"_id.{k}") for k in keys]
    by_chunk = Window.partitionBy(*of).orderBy("_id._chunk")
    first = F.lit(0)
    if values:
        before = F.lag("_to").over(by_chunk)
        first = F.when(before.isNotNull() & (before != F.col("_from")), F.lit(1)).otherwise(F.lit(0))
    s = s.withColumn("_first", first)
    s = s.withColumn("_last", F.sum(F.col("_end._part") + F.col("_first")).over(by_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    in_last = Window.partitionBy(*of, "_last").orderBy("_id._chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("_running", F.sum("_end.n").over(in_last)).withColumn(
        "_carried", F.when(F.col("_first") == 0, F.coalesce(F.lag("_running").over(by_chunk), F.lit(0))).otherwise(F.lit(0)))
    s = s.select("_id", (F.col("_last") - F.col("_end._part")).alias("_begins"), "_carried")
    out = d.join(s, "_id").withColumns({
        "episode_no": (F.col("_begins") + F.col("_part") + F.lit(1 if values else 0)).cast("long"),
        "step": (F.col("_at") + F.when(F.col("_part") == 0, F.col("_carried")).otherwise(F.lit(0))).cast("long")})
    out = out.where((F.col("step") <= limit) | (F.col("_admitted") == 0))
    return out.drop("_id", "_admitted", "_part", "_at", "_from", "_to", "_begins", "_carried")


def fold_episodes(steps: DataFrame, tasks: DataFrame, keys: Sequence[str] = ("session_id",),
                  order: Sequence[str] = ("ts", "event_id"), approved: str | None = None, reason: str | None = None,
                  restart: str | None = None, on_change: str | None = None) -> DataFrame:
    """EP1: the environment's step function applied to whole step tables.

    Input columns: keys, order, task_id, action_type, query, table_name,
    success (of the submitted query), error_message, grade (submits).  The
    query outcome is kept as ``query_success``; ``success`` is the episode's.  ``tasks`` is the task catalog
    (its largest ``max_steps`` bounds every episode).  Output: one row per accepted step with
    step, prev_best, grade_used, current_score, reward components, is_done,
    success, error_details, current_query, hint, steps_remaining and
    reward_history.

    RW11: with ``approved`` (boolean column), a submit that review rejected (false; null is not reviewed) is admitted
    to no step.  It gives a row with ``review_rejected``, the reward 0.001, the ``reason`` as its error and the state as
    the steps before it left it, also when the episode is over, and changes nothing.

    EP6: with ``restart`` or ``on_change`` (see ``number_steps``) a session holds several episodes, ``episode_no``, each with
    its own steps, best score and budget.
    """
    keys, longest = list(keys), _longest(tasks)
    t = tasks.select(*TASK_COLS)
    s = steps.withColumnRenamed("success", "query_success").join(t.select("task_id"), "task_id")
    if approved is None and restart is None and on_change is None:
        return _fold_numbered(first_k(s, keys, list(order), longest, name="step"), t, keys)
    rejected = F.lit(False) if approved is None else (F.col("action_type") == "submit_query") & ~F.coalesce(F.col(approved), F.lit(True))
    s = number_steps(s.withColumn("review_rejected", rejected), keys, order, longest, ~F.col("review_rejected"), restart, on_change)
    if restart or on_change:
        keys = [*keys, "episode_no"]
    folded = _fold_numbered(s.where(~F.col("review_rejected")), t, keys)
    if approved is None:
        return folded.drop("review_rejected")
    return folded.unionByName(_rejected_rows(s.where("review_rejected"), folded, t, keys, reason), allowMissingColumns=True)


def _rejected_rows(rejected: DataFrame, folded: DataFrame, tasks: DataFrame, keys: list[str], reason: str | None) -> DataFrame:
    """Rejected submits with the state that the accepted steps before them left (an episode has at most its budget of them)."""
    state = folded.groupBy(F.struct(*keys).alias("_k")).agg(F.sort_array(F.collect_list(
        F.struct("step", "current_score", "current_query", "reward"))).alias("_states"))
    r = rejected.withColumn("_k", F.struct(*keys)).join(state, "_k", "left")
    r = r.withColumn("step", F.least(F.col("step"), F.coalesce(F.size("_states"), F.lit(0)).cast("long")))
    r = r.withColumn("step", F.greatest(F.col("step"), F.lit(0).cast("long")))
    r = r.withColumn("_now", F.when(F.col("step") > 0, F.element_at("_states", F.col("step").cast("int"))))
    score = F.coalesce(F.col("_now.current_score"), F.lit(S.MIN_SCORE))
    seen = F.transform(F.slice("_states", F.lit(1), F.col("step").cast("int")), lambda x: x["reward"])
    return r.join(tasks, "task_id").withColumns({
        "prev_best": score, "current_score": score, "current_query": F.col("_now.current_query"), "reward": F.lit(S.MIN_SCORE),
        "error_details": F.concat(F.lit(REJECTED), F.col(reason) if reason else F.lit("")),
        "hint_shown": F.when(F.col("step") >= F.col("hint_step"), F.col("hint")),
        "steps_remaining": F.greatest(F.lit(0), F.col("max_steps") - F.col("step")),
        "is_done": F.lit(False), "success": F.lit(False),
        "reward_history": F.coalesce(seen, F.array().cast("array<double>")),
    }).drop("_k", "_states", "_now")


def _fold_numbered(s: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """The fold of rows that carry their ``step`` (1, 2, .. in each episode); the columns of their task are added."""
    s = s.join(tasks.select("task_id", "max_steps", "broken_query"), "task_id").where(F.col("step") <= F.col("max_steps"))
    a = F.col("action_type")
    submit = a == "submit_query"
    s = s.withColumn("_text", F.when(submit, F.col("query")).when(a == "reset_query", F.col("broken_query"))).drop("broken_query")

    w = Window.partitionBy(*keys).orderBy("step")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)

    submit_grade = F.when(submit, F.col("grade"))
    # columns are added in dependency levels (few plan rewrites, one shared sort)
    s = s.withColumns({
        "step": F.col("step").cast("long"),
        "prev_best": F.greatest(F.lit(S.MIN_SCORE), F.coalesce(F.max(submit_grade).over(before), F.lit(S.MIN_SCORE))),
        # WN9: query carried forward (submitted text, or the broken query after a reset)
        "current_query": F.last("_text", ignorenulls=True).over(upto),
        # WN6: error of the previous action (null when it had none)
        "error_details": F.when(a == "inspect_error", F.when(F.col("step") == 1, F.lit(NO_QUERY_YET))
                                .otherwise(F.lag("error_message", 1).over(w))),
    })
    s = s.drop("_text").join(tasks.drop("max_steps"), "task_id")  # after the sort, whose order a broadcast join keeps
    s = s.withColumns({
        "grade_used": F.when(submit, F.col("grade")).otherwise(F.col("prev_best")),
        "current_score": F.greatest(F.col("prev_best"), F.coalesce(submit_grade, F.lit(S.MIN_SCORE))),
        # EP3 hint unlock and PRJ10 remaining budget
        "hint_shown": F.when(F.col("step") >= F.col("hint_step"), F.col("hint")),
        "steps_remaining": F.greatest(F.lit(0), F.col("max_steps") - F.col("step")),
    })
    reached = F.col("grade_used") >= F.lit(SUCCESS_GRADE)
    last = F.col("step") >= F.col("max_steps")
    s = s.withColumns({"is_done": reached | last,
                       "success": reached | (last & (F.col("current_score") >= F.lit(LAST_STEP_SUCCESS)))})
    # WN5: actions after the first finishing step are refused
    s = s.withColumn("_first_done", F.min(F.when(F.col("is_done"), F.col("step"))).over(whole))
    s = s.where(F.col("_first_done").isNull() | (F.col("step") <= F.col("_first_done")))
    s = with_step_reward(s, success="query_success")
    # WN10: growing reward list (bounded by max_steps)
    s = s.withColumn("reward_history", F.collect_list("reward").over(upto))
    return s.drop("_first_done")


def session_snapshot(folded: DataFrame, keys: Sequence[str] = ("session_id",),
                     state_cols: Sequence[str] = ("task_id", "step", "current_score", "is_done", "success",
                                                  "current_query", "reward")) -> DataFrame:
    """EP5: latest state per session, ``max_by(struct, step)`` (partial aggregation, no sort)."""
    st = F.struct(*[F.col(c) for c in state_cols])
    return folded.groupBy(*keys).agg(F.max_by(st, F.col("step")).alias("s")).select(*keys, "s.*")


def episodes_by_marker(steps: DataFrame, session: str, order: Sequence[str], marker: str | Column,
                       name: str = "episode_no", chunked: bool = True) -> DataFrame:
    """EP6: episode number = running count of restart markers within the session.

    Uses the skew-safe ordered scan, so one very long session does not land in
    one task.
    """
    m = F.col(marker) if isinstance(marker, str) else marker
    d = steps.withColumn("_mark", F.when(m, F.lit(1)).otherwise(F.lit(0)))
    return ordered_scan(d, [session], list(order), [(name, "sum", "_mark")], chunked=chunked).drop("_mark")


def idle_sessions(events: DataFrame, key: str, ts: str, gap: str, tiebreak: str | None = None,
                  method: str = "segments", buckets: int = 1024) -> DataFrame:
    """EP7 (batch): activity sessions closed by ``gap`` of inactivity (a new session starts
    when the time since the previous event is >= gap); session_end = last event + gap.

    ``method="segments"`` (default) merges segments (first time, last time, events), in three steps:
    events of one key in one bucket of ``gap`` length are never parted, so a partial aggregate makes a
    segment of them before anything is shuffled; the segments of ``buckets`` buckets in a row merge
    in a window of at most that many rows; of the result only the first and the last segment of such
    a stretch can go on beyond it, and only these meet in a window over the key, one row or two for
    each stretch of ``gap * buckets``.  The order of equal times does not matter (``tiebreak`` is of no use any more).
    ``method="session_window"`` uses Spark's built-in session window, whose merge step sees every
    event of a key in one task.

    Events without a time are in no session; a null key is a key like any other.
    """
    if method == "session_window":
        return (events.groupBy(key, F.session_window(ts, gap).alias("sw"))
                .agg(F.count(F.lit(1)).alias("n_events"))
                .select(key, F.col("sw.start").alias("session_start"), F.col("sw.end").alias("session_end"),
                        "n_events"))
    gap_time = F.expr(f"INTERVAL {gap}")
    bucket = F.floor(S.wall_micros(events, ts) / F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL {gap})"))
    segments = (events.where(F.col(ts).isNotNull()).groupBy(key, bucket.alias("_bucket"))
                .agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n"))
                .withColumn("_stretch", F.floor(F.col("_bucket") / buckets)))

    def merged(rows: DataFrame, parts: list[str]) -> DataFrame:
        """Segments of each part, merged where less than ``gap`` lies between them, numbered by ``_no``."""
        w = Window.partitionBy(*parts).orderBy("_first")
        last = F.lag("_last").over(w)
        fresh = F.when(last.isNull() | (F.col("_first") >= last + gap_time), F.lit(1)).otherwise(F.lit(0))
        rows = rows.withColumn("_fresh", fresh).withColumn("_no", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return rows.groupBy(*parts, "_no").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_n").alias("_n"))

    local = merged(segments, [key, "_stretch"])
    of = Window.partitionBy(key, "_stretch")
    edge = (F.col("_no") == 1) | (F.col("_no") == F.max("_no").over(of))
    # a segment with others on both sides is a session; it gets a part of its own
    local = local.withColumn("_inner", F.when(~edge, F.struct("_stretch", "_no"))).drop("_stretch", "_no")
    return merged(local, [key, "_inner"]).select(key, F.col("_first").alias("session_start"), (F.col("_last") + gap_time).alias("session_end"),
                                                 F.col("_n").alias("n_events"))


def active_sessions(events: DataFrame, key: str, ts: str, every: str = "1 hour") -> DataFrame:
    """EP8: number of distinct live sessions per tumbling window."""
    return (events.groupBy(F.window(ts, every).alias("w"))
            .agg(F.count_distinct(key).alias("active_sessions"))
            .select(F.col("w.start").alias("window_start"), "active_sessions"))
