"""Episode fold properties and the streaming fold equal to the batch fold."""

from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_fold_properties(spark):
    from queryforge.plans.q_episodes import folded
    f = folded(spark, SF_SMALL).cache()
    assert f.where((F.col("reward") < 0.001) | (F.col("reward") > 0.999)).count() == 0
    # best score never falls and no step follows a finishing step
    from pyspark.sql import Window
    w = Window.partitionBy("session_id").orderBy("step")
    bad = f.withColumn("p", F.lag("current_score").over(w)).where(F.col("current_score") < F.col("p")).count()
    assert bad == 0
    after_done = f.withColumn("pd", F.lag("is_done").over(w)).where(F.col("pd")).count()
    assert after_done == 0
    assert f.where(F.col("step") > F.col("max_steps")).count() == 0
    f.unpersist()


def test_stream_equals_batch(spark):
    from queryforge.plans.q_episodes import REWARD_COLS, step_rewards
    from queryforge.streaming.episodes import run_stream_fold
    batch = step_rewards(spark, SF_SMALL).select(*REWARD_COLS)
    stream = run_stream_fold(spark, SF_SMALL).select(*REWARD_COLS)
    assert batch.count() == stream.count() > 0
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0


def test_stream_idle_sessions_emit_final_sessions(spark):
    import uuid
    from queryforge.operators.episodes import idle_sessions
    from queryforge.plans.views import T
    from queryforge.streaming.episodes import stream_idle_sessions
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    ev = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)
          .select("user_id", "ts"))
    name = f"idle_{uuid.uuid4().hex}"
    q = (stream_idle_sessions(ev, "user_id", "ts", "6 hours").writeStream.format("memory").queryName(name)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    as_text = lambda d: d.select("user_id", F.date_format("session_start", fmt).alias("s"),
                                 F.date_format("session_end", fmt).alias("e"), "n_events")
    got = as_text(spark.table(name))
    batch = as_text(idle_sessions(T(spark, SF_SMALL, "events").select("user_id", "ts", "event_id"), "user_id",
                                  "ts", "6 hours", tiebreak="event_id"))
    # every emitted (closed) session is exactly one of the batch sessions
    assert got.count() > 0
    assert got.exceptAll(batch).count() == 0


def _interleaved(spark, files=4):
    """A folder whose events.parquet is a folder of files that overlap in time."""
    import tempfile
    base = tempfile.mkdtemp(prefix="qf-test-events-")
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    for i in range(files):
        events.where(F.col("event_id") % files == i).coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
    return base


def test_stream_over_interleaved_part_files_equals_batch(spark):
    from queryforge.plans.q_episodes import REWARD_COLS, step_rewards
    from queryforge.streaming.episodes import run_stream_fold
    batch = step_rewards(spark, SF_SMALL).select(*REWARD_COLS)
    stream = run_stream_fold(spark, _interleaved(spark)).select(*REWARD_COLS)
    assert batch.count() == stream.count() > 0
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0


def test_endless_stream_emits_what_the_watermark_passed(spark):
    import tempfile
    from queryforge.plans.q_episodes import REWARD_COLS, step_rewards
    from queryforge.plans.views import steps_from_events
    from queryforge.streaming.episodes import fold_stream
    base = tempfile.mkdtemp(prefix="qf-test-fold-")
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    times = sorted(r["ts"] for r in events.select("ts").collect())
    bounds = [None, *(times[len(times) * i // 4 - 1] for i in range(1, 5))]
    for low, high in zip(bounds, bounds[1:]):
        part = events.where(F.col("ts") <= F.lit(high))
        (part if low is None else part.where(F.col("ts") > F.lit(low))).coalesce(1).write.mode("append").parquet(f"{base}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/events")
    fold = fold_stream(spark, steps_from_events(spark, stream), delay="1 second")
    q = (fold.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/chk")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got, batch = spark.read.parquet(f"{base}/out").select(*REWARD_COLS), step_rewards(spark, SF_SMALL).select(*REWARD_COLS)
    assert got.count() >= 0.9 * batch.count() and got.exceptAll(batch).count() == 0


def _number_brute(rows, limit, change):
    """episode_no and step per event id, row after row."""
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for mine in by.values():
        episode, step, before = (1 if change else 0), 0, None
        for i, (eid, _, ts, day, restart, ok) in enumerate(sorted(mine, key=lambda r: (r[2], r[0]))):
            if (i and day != before) if change else restart:
                episode, step = episode + 1, 0
            before, step = day, step + ok
            if not ok or step <= limit:
                out[eid] = (episode, min(step, limit) if not ok else step)
    return out


def test_steps_are_numbered_over_chunks(spark):
    import datetime as dt
    import random

    from queryforge.operators.episodes import number_steps

    rnd, t0 = random.Random(6), dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice([1, 1, 1, 2, None]), t0 + dt.timedelta(minutes=rnd.randint(0, 3000)), rnd.choice([None, "a"]) if i % 4 == 0 else "b",
             rnd.random() < 0.08, rnd.random() < 0.8) for i in range(700)]
    df = spark.createDataFrame(rows, "event_id long, session_id long, ts timestamp, day string, restart boolean, ok boolean").repartition(4)
    for change in (True, False):
        kind = {"on_change": "day"} if change else {"restart": "restart"}
        for limit in (3, 1000):
            got = number_steps(df, ["session_id"], ["ts", "event_id"], limit, F.col("ok"), **kind)
            assert set(got.columns) == {*df.columns, "episode_no", "step"}
            # a row that takes no step counts those before it, of which only ``limit`` matter
            found = {r["event_id"]: (r["episode_no"], min(r["step"], limit)) for r in got.collect()}
            assert found == _number_brute(rows, limit, change), (change, limit)


def test_rejected_submits_use_no_step(spark):
    from queryforge.operators.episodes import fold_episodes
    from queryforge.operators.screening import review_columns
    from queryforge.sources.tasks import task_catalog

    schema = ("session_id long, event_id long, ts long, task_id string, action_type string, query string, table_name string, success boolean, "
              "error_message string, grade double")
    submit = lambda i, q, g: (1, i, i, "easy_syntax_fix", "submit_query", q, None, True, None, g)
    rows = [submit(1, "DELETE FROM customers;", None), (1, 2, 2, "easy_syntax_fix", "inspect_schema", None, None, None, None, None),
            submit(3, "SELECT 1", None), submit(4, "SELECT * FROM customers", 0.999), submit(5, "DELETE FROM customers;", None),
            submit(6, "SELECT * FROM customers", 0.5)]
    approved, reason = review_columns("query", ["customers", "orders"])
    df = spark.createDataFrame(rows, schema).withColumns({"approved": approved, "reason": reason})
    got = {r["event_id"]: r for r in fold_episodes(df, task_catalog(spark), approved="approved", reason="reason").collect()}
    assert set(got) == {1, 2, 3, 4, 5}  # the episode is over after 4: no step, but a rejection still answers
    assert [(got[i]["step"], got[i]["review_rejected"], got[i]["is_done"]) for i in (1, 2, 3, 4, 5)] == [
        (0, True, False), (1, False, False), (1, True, False), (2, False, True), (2, True, False)]
    assert {got[i]["reward"] for i in (1, 3, 5)} == {0.001} and got[5]["current_score"] == 0.999 and got[1]["current_score"] == 0.001
    assert got[1]["error_details"] == "REVIEWER REJECTION: Only SELECT queries or CTEs (WITH) are allowed."
    assert got[3]["error_details"].endswith("Available: ['customers', 'orders']") and len(got[5]["reward_history"]) == 2


def test_episodes_of_one_session_have_their_own_budget(spark):
    from queryforge.operators.episodes import fold_episodes
    from queryforge.sources.tasks import task_catalog

    rows = [(1, i, i, "easy_syntax_fix", "submit_query", "SELECT 1", None, True, None, 0.3 if i < 25 else 0.1, i in (0, 25)) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id long, event_id long, ts long, task_id string, action_type string, query string, table_name string, "
                                     "success boolean, error_message string, grade double, restart boolean")
    got = fold_episodes(df, task_catalog(spark), restart="restart").collect()
    assert sorted((r["episode_no"], r["step"]) for r in got) == [(e, s) for e in (1, 2) for s in range(1, 11)]
    assert {r["current_score"] for r in got if r["episode_no"] == 2} == {0.1} and {r["prev_best"] for r in got if r["step"] == 1} == {0.001}


def test_replayed_stream_drops_only_what_is_behind_the_watermark(spark):
    from queryforge.plans.q_episodes import reviewed_steps
    from queryforge.streaming.episodes import STATE_STORE, fold_stream, replay

    before = spark.conf.get(STATE_STORE)
    one = reviewed_steps(spark, SF_SMALL).where("task_id = 'easy_syntax_fix'").orderBy("event_id").limit(1).withColumn("session_id", F.lit(5).cast("long"))

    def at(i, day, session=5):
        return one.withColumns({"event_id": F.lit(i).cast("long"), "session_id": F.lit(session).cast("long"), "action_type": F.lit("inspect_schema"),
                                "ts": F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp_ntz"), "approved": F.lit(None).cast("boolean")})

    slices = [at(1, 2).unionByName(at(3, 8)), at(2, 5).unionByName(at(4, 1)), at(9, 28, session=6)]
    out = replay(spark, slices, lambda s: fold_stream(spark, s, delay="5 days"), "late-rows")
    # after the first slice the watermark is the 3rd: the 5th is late but counts, in its order; the 1st is lost
    assert sorted((r["step"], r["event_id"]) for r in out.where("session_id = 5").collect()) == [(1, 1), (2, 2), (3, 3)]
    assert spark.conf.get(STATE_STORE) == before


def test_stream_active_sessions_counts_late_rows_once(spark):
    import datetime as dt

    from queryforge.streaming.episodes import replay, stream_active_sessions

    def rows(*items):
        return spark.createDataFrame([(u, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for u, m in items], "user_id long, ts timestamp")

    slices = [rows((1, 5), (1, 59), (2, 61), (2, 90), (None, 7)),
              rows((1, 30), (3, 40), (2, 119), (4, 400)),  # 1 again and late, 3 late: within the delay of two hours
              rows((9, 10), (9, 9000))]  # ten minutes past is behind the watermark by now
    out = replay(spark, slices, lambda s: stream_active_sessions(s, "user_id", "ts", "1 hour", "2 hours"), "late-active")
    assert sorted((r["window_start"].hour, r["active_sessions"]) for r in out.collect()) == [(0, 2), (1, 1), (6, 1)]


def test_stream_state_is_touched_once_per_session_and_batch():
    import random

    import pandas as pd

    from queryforge.streaming.episodes import WAITING_SCHEMA, EpisodeProcessor

    class Value:
        def __init__(self):
            self.now, self.calls = None, 0

        def exists(self):
            self.calls += 1
            return self.now is not None

        def get(self):
            self.calls += 1
            return self.now

        def update(self, new):
            self.calls, self.now = self.calls + 1, new

    class Handle:
        def getValueState(self, *_):
            self.value = Value()
            return self.value

    rnd = random.Random(4)
    action = lambda i: rnd.choice(["submit_query", "inspect_schema", "inspect_error", "reset_query"])
    rows = [(60_000_000 * i, i, rnd.choice(["a", "b"]), action(i), f"q{i}", True, None, 0.3, rnd.choice([True, True, False, None]), "no") for i in range(3000)]
    tasks = {"a": (5, "broken"), "b": (9, "other")}

    def run(batches, **kind):
        handle, processor, out = Handle(), EpisodeProcessor(tasks, **kind), []
        processor.init(handle)
        for batch in batches:
            mixed = rnd.sample(batch, len(batch))
            parts = [pd.DataFrame(mixed[i:i + 100], columns=WAITING_SCHEMA.fieldNames()) for i in range(0, len(mixed), 100)]
            out += [tuple(r) for pdf in processor.handleInputRows((1,), iter(parts), None) for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False)]
        assert handle.value.calls <= 3 * len(batches)  # whatever the number of rows and spans
        return sorted(out, key=lambda r: r[1:3])

    whole = run([rows])
    assert whole == run([rows], most_held=50) == run([rows[:7], rows[7:1000], rows[1000:]])
    rejected = [r[1] for r in rows if r[3] == "submit_query" and r[8] is False]
    assert [r[2] for r in whole if r[16]] == rejected and 5 <= max(r[8] for r in whole) <= 9


def test_texts_of_tasks_are_joined_after_the_sorts(spark, monkeypatch):
    from queryforge.operators import episodes
    from queryforge.plans.q_episodes import reviewed_steps
    from queryforge.sources.tasks import task_catalog

    seen = []
    monkeypatch.setattr(episodes, "stored", lambda df, tag: seen.append(df) or df)
    folded = episodes.fold_episodes(reviewed_steps(spark, SF_SMALL), task_catalog(spark), approved="approved", reason="reason")
    texts = {"description", "expected_output_description", "broken_query", "hint", "tables"}
    assert len(seen) == 1 and not texts & set(seen[0].columns)  # what the ordered pass sorts
    assert texts <= set(folded.columns) and folded.where("tables IS NULL OR hint IS NULL").count() == 0
    sorts = [line for line in folded._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert sorts and not any("broken_query" in line or "description" in line for line in sorts)


def test_stream_rows_without_time_are_folded_first(spark):
    from queryforge.plans.q_episodes import reviewed_steps
    from queryforge.streaming.episodes import fold_stream, replay

    one = reviewed_steps(spark, SF_SMALL).where("task_id = 'easy_syntax_fix'").orderBy("event_id").limit(1).withColumn("session_id", F.lit(5).cast("long"))

    def at(i, ts, session=5):
        return one.withColumns({"event_id": F.lit(i).cast("long"), "session_id": F.lit(session).cast("long"), "action_type": F.lit("inspect_schema"),
                                "ts": F.lit(ts).cast("timestamp_ntz"), "approved": F.lit(None).cast("boolean")})

    slices = [at(1, "2024-01-02 00:00:00").unionByName(at(2, None)), at(9, "2024-02-28 00:00:00", session=6)]
    out = replay(spark, slices, lambda s: fold_stream(spark, s, delay="5 days"), "no-time")
    assert sorted((r["step"], r["event_id"]) for r in out.where("session_id = 5").collect()) == [(1, 2), (2, 1)]
