"""EP2: the episode fold as a Structured Streaming job (keyed state per session).

``readStream`` -> steps rule (stream-static broadcast join with the task
catalog) -> keyed state -> fold -> reward columns.

* ``fold_stream`` runs without end, in two keyed states.  Rows wait in Spark's own aggregation, one list for each session
  and short span of time, and come out when the watermark has passed the span's end, since no row of the span can follow any
  more.  ``transformWithState`` (RocksDB) then folds what came out: its state is one value per session (steps taken, best
  score, ..), read and written once in a micro-batch, so Python sees a row when it is final and no sooner.  Of a session's rows
  it holds those that can still be a step, at most a task's budget, and the rejected ones, which all answer.  A micro-batch
  costs what its new rows and its expired spans cost, and Spark's look through the spans that wait.  What arrives behind the
  watermark is dropped by Spark, so ``delay`` must cover the lateness of the source.
* ``run_stream_fold`` reads a whole table in any order of files.  Its stream only fills the state, a session's
  first rows in (ts, event_id) order, at most as many as the longest task has steps; a row that
  arrives late but stands earlier displaces a later one, so neither the files nor the
  micro-batches a row comes in change the result.  When the input is at its end, the kept rows are
  read from the state store and folded by ``fold_episodes``.

No session is forgotten when idle: that would restart its step budget.  Inside a micro-batch the
rows of a session arrive as an iterator of Arrow batches, so a very active session never
materialises whole in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from queryforge.functions import scalar as S
from queryforge.operators.episodes import LAST_STEP_SUCCESS, NO_QUERY_YET, REJECTED, fold_episodes
from queryforge.operators.reward import SUCCESS_GRADE, with_step_reward
from queryforge.session import checkpoint_dir
from queryforge.sources.tasks import task_catalog

MIN_SCORE = 0.001
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for a null ts or event_id in the state: before all others, as in the batch fold's order.
NULL_FIRST = -2 ** 63

ROW_SCHEMA = T.StructType([
    T.StructField("at", T.LongType()),  # microseconds of ts
    T.StructField("tie", T.LongType()),  # event_id
    T.StructField("task_id", T.StringType()),
    T.StructField("action_type", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("grade", T.DoubleType()),
])

STATE_SCHEMA = T.StructType([T.StructField("waiting", T.ArrayType(ROW_SCHEMA))])

#: What ``fold_stream`` keeps of a session besides the rows that wait.
EPISODE_SCHEMA = T.StructType([
    T.StructField("steps", T.IntegerType()),
    T.StructField("best", T.DoubleType()),
    T.StructField("done", T.BooleanType()),
    T.StructField("current_query", T.StringType()),
    T.StructField("last_error", T.StringType()),
])

#: A row that waits: with the verdict of the review, null where there was none.
WAITING_SCHEMA = T.StructType([*ROW_SCHEMA.fields, T.StructField("approved", T.BooleanType()), T.StructField("reason", T.StringType())])

FOLDED_SCHEMA = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("at", T.LongType()),
    T.StructField("tie", T.LongType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("action_type", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("query_success", T.BooleanType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("prev_best", T.DoubleType()),
    T.StructField("grade_used", T.DoubleType()),
    T.StructField("current_score", T.DoubleType()),
    T.StructField("is_done", T.BooleanType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error_details", T.StringType()),
    T.StructField("current_query", T.StringType()),
    T.StructField("review_rejected", T.BooleanType()),
])

OUT_COLS = ["session_id", "ts", "event_id", "task_id", "action_type", "query", "query_success", "error_message", "tables",
            "max_steps", "step", "prev_best", "grade_used", "current_score", "is_done", "success", "error_details",
            "current_query", "hint_shown", "steps_remaining", "correctness", "efficiency", "syntax_progress", "schema_bonus",
            "penalty", "reward", "breakdown"]


def _plain(row, schema: T.StructType) -> tuple:
    """A pandas row as plain Python values, missing ones as None."""
    return tuple(None if pd.isna(v) else kind(v) for v, kind in zip(row, _KINDS[len(schema.fields)]))


_KINDS = {len(schema.fields): [{"long": int, "string": str, "boolean": bool, "double": float}[f.dataType.typeName()] for f in schema.fields]
          for schema in (ROW_SCHEMA, WAITING_SCHEMA)}


def _keep_first(key, pdfs: Iterator[pd.DataFrame], state: GroupState, most: int) -> Iterator[pd.DataFrame]:
    """Keep the first ``most`` rows of a session; nothing comes out."""
    waiting = [tuple(r) for r in state.get[0]] if state.exists else []
    for pdf in pdfs:
        if len(pdf):
            first = pdf.sort_values(["at", "tie"], kind="mergesort").head(most)[ROW_SCHEMA.fieldNames()]
            rows = [_plain(r, ROW_SCHEMA) for r in first.itertuples(index=False)]
            waiting = sorted(waiting + rows, key=lambda r: r[:2])[:most]
    state.update((waiting,))
    yield from ()


def _first_of_tasks(rows: list[tuple], tasks: dict[str, tuple[int, str]], steps: int) -> list[tuple]:
    """The rows, in order, that can still be a step after ``steps``: of each task as many as its budget leaves."""
    left = {t: budget - steps for t, (budget, _) in tasks.items()}
    out = []
    for r in sorted(rows, key=lambda r: r[:2]):
        if left[r[2]] > 0:
            left[r[2]] -= 1
            out.append(r)
    return out


class EpisodeProcessor(StatefulProcessor):
    """The environment's step function over rows that the watermark has passed; later calls get later rows."""

    def __init__(self, tasks: dict[str, tuple[int, str]], most_held: int = 4096):
        self.tasks, self.most_held = tasks, most_held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.episode = handle.getValueState("episode", EPISODE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps, best, done, query_now, last_error = self.episode.get() if self.episode.exists() else (0, MIN_SCORE, False, None, None)
        taken, rejected = [], []
        for pdf in rows:
            for r in pdf[WAITING_SCHEMA.fieldNames()].itertuples(index=False):
                row = _plain(r, WAITING_SCHEMA)
                if row[3] == "submit_query" and row[8] is False:
                    rejected.append(row)
                elif not done:  # an episode that is over takes no step; rejections still answer
                    taken.append(row)
            if len(taken) > self.most_held:
                taken = _first_of_tasks(taken, self.tasks, steps)
        out = []
        for at, tie, task_id, action, query, ok, error, grade, approved, reason in sorted(taken + rejected, key=lambda r: r[:2]):
            max_steps, broken_query = self.tasks[task_id]
            if action == "submit_query" and approved is False:
                out.append((*key, at, tie, task_id, action, query, ok, error, steps, best, None, best, False, False,
                            REJECTED + (reason or ""), query_now, True))
                continue
            if done or steps >= max_steps:
                continue
            steps += 1
            submit, prev_best = action == "submit_query", best
            if submit:
                grade_used, query_now, best = grade, query, max(best, MIN_SCORE if grade is None else grade)
            else:
                grade_used = best
                if action == "reset_query":
                    query_now = broken_query
            details = (NO_QUERY_YET if steps == 1 else last_error) if action == "inspect_error" else None
            reached = grade_used is not None and grade_used >= SUCCESS_GRADE
            last = steps >= max_steps
            done, last_error = reached or last, error
            out.append((*key, at, tie, task_id, action, query, ok, error, steps, prev_best, grade_used, best, done,
                        reached or (last and best >= LAST_STEP_SUCCESS), details, query_now, False))
        self.episode.update((steps, best, done, query_now, last_error))
        if out:
            yield pd.DataFrame(out, columns=FOLDED_SCHEMA.fieldNames())

    def close(self) -> None:
        pass


def _tasks(spark: SparkSession) -> dict[str, tuple[int, str]]:
    return {r["task_id"]: (r["max_steps"], r["broken_query"])
            for r in task_catalog(spark).select("task_id", "max_steps", "broken_query").collect()}


def _state_rows(steps: DataFrame, tasks: dict, fields: list[str]) -> DataFrame:
    return steps.where(F.col("task_id").isin(*tasks)).select(
        "session_id", "ts", F.coalesce(S.wall_micros(steps, "ts"), F.lit(NULL_FIRST)).alias("at"),
        F.coalesce("event_id", F.lit(NULL_FIRST)).alias("tie"), *fields[2:])


def _wall_clock(steps: DataFrame) -> bool:
    return steps.schema["ts"].dataType.typeName() == "timestamp_ntz"


def _timed(rows: DataFrame, wall_clock: bool) -> DataFrame:
    """``at`` and ``tie`` as ts and event_id again."""
    null = F.lit(NULL_FIRST)
    ts = F.expr("timestampadd(MICROSECOND, at, timestamp_ntz'1970-01-01 00:00:00')") if wall_clock else F.timestamp_micros("at")
    return rows.withColumns({"ts": F.when(F.col("at") != null, ts),
                             "event_id": F.when(F.col("tie") != null, F.col("tie"))}).drop("at", "tie")


def fold_stream(spark: SparkSession, steps: DataFrame, delay: str = "10 minutes", span_ms: int = 60_000) -> DataFrame:
    """Keyed-state fold of a streaming steps frame; reward columns added after the state.

    ``delay``: how late a row may arrive behind the newest ``ts``.  A row is emitted once the watermark has passed the end of
    its span of ``span_ms``, and then it is final.  Rows without ``ts`` are folded as they come, before all others.  With columns ``approved`` and ``reason`` a
    rejected submit gives a row with ``review_rejected`` and takes no step (RW11, as in ``fold_episodes``).

    The state needs RocksDB, and a query takes its store from the session when it starts, so this sets the session's
    ``STATE_STORE`` to it; ``kept_setting`` puts the former one back.
    """
    spark.conf.set(STATE_STORE, ROCKSDB)
    if _wall_clock(steps):
        # watermarks need an instant type: read wall-clock values in the session time zone
        steps = steps.withColumn("ts", F.col("ts").cast("timestamp"))
    if "approved" not in steps.columns:
        steps = steps.withColumns({"approved": F.lit(None).cast("boolean"), "reason": F.lit(None).cast("string")})
    tasks = _tasks(spark)
    rows = _state_rows(steps.withWatermark("ts", delay), tasks, WAITING_SCHEMA.fieldNames())
    spans = rows.groupBy("session_id", F.window("ts", f"{span_ms} milliseconds")).agg(F.collect_list(F.struct(*WAITING_SCHEMA.fieldNames())).alias("rows"))
    final = spans.select("session_id", F.inline("rows")).unionByName(
        _state_rows(steps.where(F.col("ts").isNull()), tasks, WAITING_SCHEMA.fieldNames()).drop("ts"))  # these wait for nothing
    folded = final.groupBy("session_id").transformWithStateInPandas(EpisodeProcessor(tasks), FOLDED_SCHEMA, "append", "None")
    t = F.broadcast(task_catalog(spark).select("task_id", "max_steps", "hint", "hint_step", "tables"))
    folded = _timed(folded, wall_clock=False).join(t, "task_id").withColumns({
        "hint_shown": F.when(F.col("step") >= F.col("hint_step"), F.col("hint")),
        "steps_remaining": F.greatest(F.lit(0), F.col("max_steps") - F.col("step"))})
    folded = with_step_reward(folded, success="query_success")
    rejected = F.col("review_rejected")
    scores = ("correctness", "efficiency", "syntax_progress", "schema_bonus", "penalty", "breakdown")
    return folded.withColumns({"reward": F.when(rejected, F.lit(MIN_SCORE)).otherwise(F.col("reward")),
                               **{c: F.when(~rejected, F.col(c)) for c in scores}}).select(*OUT_COLS, "review_rejected")


@contextmanager
def kept_setting(spark: SparkSession, name: str) -> Iterator[None]:
    """What is set inside does not last."""
    before = spark.conf.get(name, None)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def replay(spark: SparkSession, slices: list[DataFrame], stream: Callable[[DataFrame], DataFrame], tag: str) -> DataFrame:
    """What ``stream`` emits when the ``slices`` of a table arrive one after the other.

    Each slice is appended to a folder below the session's checkpoint folder and read by one run of the query, which goes on from
    its checkpoint; what is behind the watermark by then is late.
    """
    base = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    for part in slices:
        part.write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(part.schema).parquet(f"{base}/in")
        with kept_setting(spark, STATE_STORE):
            q = (stream(source).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/chk")
                 .outputMode("append").trigger(availableNow=True).start())
            q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def run_stream_fold(spark: SparkSession, source_dir: str, file_glob: str = "events.parquet",
                    max_files_per_trigger: int = 1) -> DataFrame:
    """Run the streaming fold to completion (availableNow) and return the written result.

    ``file_glob`` is a file or a folder of part files.  Output and checkpoint go under the session's
    checkpoint folder (shared on a cluster), in a fresh sub-folder per run.
    """
    from queryforge.plans.views import steps_from_events

    path = f"{source_dir}/{file_glob}"
    events = (spark.readStream.schema(spark.read.parquet(path).schema)
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(f"{source_dir}/{{{file_glob}}}"))  # a stream takes a single file by a pattern only
    steps = steps_from_events(spark, events)
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-fold-{uuid.uuid4().hex}"
    tasks = _tasks(spark)
    most = max(m for m, _ in tasks.values())
    kept = (_state_rows(steps, tasks, ROW_SCHEMA.fieldNames()).drop("ts").groupBy("session_id")
            .applyInPandasWithState(lambda key, pdfs, state: _keep_first(key, pdfs, state, most), FOLDED_SCHEMA, STATE_SCHEMA, "append",
                                    GroupStateTimeout.NoTimeout))
    q = (kept.writeStream.format("noop").option("checkpointLocation", f"{base}/chk")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    # the input is at its end: no row can displace another any more
    kept = (spark.read.format("statestore").load(f"{base}/chk")
            .select(F.col("key.session_id").alias("session_id"), F.explode("value.groupState.waiting").alias("r"))
            .select("session_id", "r.*"))
    folded = fold_episodes(_timed(kept, _wall_clock(steps)), task_catalog(spark))
    folded.select(*OUT_COLS).write.parquet(f"{base}/out")
    return spark.read.parquet(f"{base}/out")


def stream_idle_sessions(events: DataFrame, key: str, ts: str, gap: str, watermark: str | None = None) -> DataFrame:
    """EP7 (stream): activity sessions of a streaming events frame, closed after ``gap``.

    Session windows need a watermark to know when a session can no longer grow;
    ``watermark`` (default: the gap) bounds the state and decides when a session
    is final and emitted (append mode).  Each key keeps only its open sessions
    in state, so state grows with live sessions, not with events.
    """
    if events.schema[ts].dataType.typeName() == "timestamp_ntz":
        # watermarks need an instant type: read wall-clock values in the session time zone
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return (events.withWatermark(ts, watermark or gap)
            .groupBy(key, F.session_window(ts, gap).alias("sw"))
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(key, F.col("sw.start").alias("session_start"), F.col("sw.end").alias("session_end"), "n_events"))


def stream_active_sessions(events: DataFrame, key: str, ts: str, every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """EP8 (stream): number of distinct live sessions per tumbling window, exact, each window once it is final.

    The first event of a session in a window passes, its others are dropped by ``dropDuplicatesWithinWatermark``, and what passes
    is counted; the state holds a session per open window, not its events.  Duplicates are told for as long as the watermark's
    delay, so that is at least ``every``: two events of one window are never further apart.  Events later than the delay
    are dropped by Spark; events without a session or a time are not counted.
    """
    if events.schema[ts].dataType.typeName() == "timestamp_ntz":
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    delay = max(delay, every, key=pd.Timedelta)
    slot = F.window(ts, every)
    first = (events.where(F.col(key).isNotNull()).withWatermark(ts, delay).select(key, ts, slot["start"].alias("window_start"))
             .dropDuplicatesWithinWatermark([key, "window_start"]))
    return first.groupBy(slot.alias("w")).agg(F.count(F.lit(1)).alias("active_sessions")).select(
        F.col("w.start").alias("window_start"), "active_sessions")
