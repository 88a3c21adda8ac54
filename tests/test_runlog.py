"""Run analytics against brute-force Python versions of the stated rules."""

import random
import statistics
import statistics

from pyspark.sql import functions as F

from queryforge.operators import runlog as RL


def test_latency_stats_match_python(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(4001):
        ep = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", "c"])
        rows.append((i, ep, round(rnd.uniform(0.01, 400), 2)))
    df = spark.createDataFrame(rows, "id long, endpoint string, ms double")
    got = {r["endpoint"]: r for r in RL.latency_stats(df, "endpoint", "ms", "id", chunk=F.floor("ms")).collect()}
    for ep in {r[1] for r in rows}:
        vals = sorted(r[2] for r in rows if r[1] == ep)
        n = len(vals)
        assert got[ep]["n"] == n
        assert abs(got[ep]["avg_ms"] - round(statistics.mean(vals), 3)) < 1e-9
        assert abs(got[ep]["p50_ms"] - round(statistics.median(vals), 3)) < 1e-9
        assert got[ep]["p95_ms"] == round(vals[max(0, int(n * 0.95) - 1)], 3)


def _moving_average(values, window):
    return [statistics.fmean(values[max(0, end - window):end]) for end in range(1, len(values) + 1)]


def test_moving_average_matches_running_loop(spark):
    rnd = random.Random(5)
    vals = [round(rnd.random(), 4) for _ in range(537)]
    df = spark.createDataFrame([(0, float(i), v) for i, v in enumerate(vals)], "run int, step double, value double")
    got = [r["moving_avg"] for r in RL.moving_average(df, ["run"], ["step"], "value",
                                                      chunk=F.floor(F.col("step") / 64)).orderBy("step").collect()]
    w = max(5, len(vals) // 20 or 5)
    exp = _moving_average(vals, w)
    assert all(abs(a - b) < 1e-6 for a, b in zip(got, exp))


def test_reward_series_rules(spark):
    # ragged rows: step 0 counts as absent for 'step' and falls through to 'epoch'
    rows = [(0, 0.0, None, 0.5, None), (1, 1.0, 0.2, None, None), (2, 1.0, 0.9, None, None),
            (3, 2.0, None, None, 0.7), (4, None, 0.3, None, None)]
    df = spark.createDataFrame(rows, "log_idx long, step double, reward double, epoch double, `rewards/mean` double")
    got = sorted((r["step"], r["value"]) for r in RL.reward_series(df).collect())
    # idx0: step 0 -> epoch 0.5, no reward -> dropped; idx1 first for step 1; idx2 duplicate dropped;
    # idx3 rewards/mean for step 2; idx4 no step -> dropped
    assert got == [(1.0, 0.2), (2.0, 0.7)]


def test_histogram_rule(spark):
    rnd = random.Random(9)
    vals = [rnd.random() for _ in range(1000)]
    df = spark.createDataFrame([("x", v) for v in vals], "g string, v double")
    got = {r["bin"]: r["count"] for r in RL.histogram(df, "g", "v").collect()}
    lo, hi = min(vals), max(vals)
    w = (hi - lo) / 20
    exp = [0] * 20
    for v in vals:
        exp[min(19, int((v - lo) // w))] += 1
    assert [got[i] for i in range(20)] == exp


def test_before_after_alignment(spark):
    rows = [("t1", "before", 0.2), ("t1", "after", 0.4), ("t2", "after", 0.6)]
    df = spark.createDataFrame(rows, "task_id string, phase string, reward double")
    got = {r["task_id"]: r for r in RL.before_after(df).collect()}
    assert got["t2"]["before_mean"] == 0.0 and got["t2"]["has_before"] is False
    assert got["t1"]["delta"] == 0.2 and got["t2"]["delta"] is None
    assert got["overall"]["before_mean"] == 0.1 and got["overall"]["after_mean"] == 0.5


def test_exact_ranks_by_histograms(spark):
    from queryforge.operators.ranks import select_ranks

    rnd = random.Random(4)
    values = {"hot": [float(rnd.choice([3, 3, 3, 4, 5])) for _ in range(3000)], None: [rnd.lognormvariate(0, 9) for _ in range(700)],
              "wide": [-1.7e308, 1.7e308, 5e-324, 0.0, 1e-323], "one": [2.5] * 9, "ties": [1.0] * 400 + [rnd.random() for _ in range(400)]}
    rows = [(g, v) for g, vs in values.items() for v in vs]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    targets = {g: sorted({1, 2, len(v) // 3 + 1, len(v) // 2, len(v) - 1, len(v)}) for g, v in values.items()}
    wanted = spark.createDataFrame([(g, f"r{t}", t, min(values[g]), max(values[g])) for g, ts in targets.items() for t in ts],
                                   "g string, which string, target long, lo double, hi double")
    expected = sorted(((g, f"r{t}", sorted(values[g])[t - 1]) for g, ts in targets.items() for t in ts), key=repr)
    for few in (0, 50, 100_000):  # by passes alone, mixed, by one ordered remainder
        got = select_ranks(df, "g", "v", wanted, bins=16, few=few)
        assert sorted(map(tuple, got.collect()), key=repr) == expected


def test_latency_of_null_groups_and_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", float("nan")), ("b", 7.0), ("b", float("inf"))], "g string, ms double")
    got = sorted(map(tuple, RL.latency_stats(df, "g", "ms").collect()), key=repr)
    assert got == sorted([(None, 2.0, 2.0, 1.0, 2), ("b", 7.0, 7.0, 7.0, 1)], key=repr)
    assert RL.latency_stats(df.limit(0), "g", "ms").collect() == []


def test_ragged_logs_as_variants(spark, tmp_path):
    import json

    from queryforge.sources.tables import read_log_variant

    files = [[{"step": 1, "reward": None, "rewards/mean": "0.9", "rewards": 0.1}, {"step": 1, "reward": 5}, {"step": 0, "epoch": 0.5, "reward": "x"},
              {"step": 2, "loss": "nan", "eval_loss": 0.25}, "no object", {"global_step": 3, "my_Reward": True}],
             [{"step": 7, "objective/mean_reward": 0.7, "Loss": 2}, {"reward": 1.0}, {"step": 8, "zz_reward": "1", "a_reward_b": 3.5}]]
    for i, rows in enumerate(files):
        (tmp_path / f"part-{i}.json").write_text("\n".join(map(json.dumps, rows)))
    log = read_log_variant(spark, str(tmp_path))
    assert sorted((r["step"], r["value"]) for r in RL.reward_series_variant(log).collect()) == [(1.0, 0.1), (3.0, 1.0), (7.0, 0.7), (8.0, 3.5)]
    assert sorted((r["step"], r["value"]) for r in RL.numeric_series_variant(log, "loss").collect()) == [(2.0, 0.25), (7.0, 2.0)]
    keys = {r["key"]: (r["n_rows"], r["n_numbers"]) for r in RL.log_keys(log).collect()}
    assert keys["reward"] == (4, 2) and keys["step"] == (6, 6) and keys["objective/mean_reward"] == (1, 1) and keys["loss"] == (1, 0)


def test_observation_of_results(spark):
    from queryforge.operators.observations import first_rows_json, observation

    rows = spark.createDataFrame([(1, p, f'a"{p}', None if p == 2 else p / 2) for p in (3, 1, 2, 4)], "event_id long, pos long, name string, v double")
    results = first_rows_json(rows, ["event_id"], "pos", ["name", "v"])
    assert results.first().asDict() == {"event_id": 1, "row_count": 4, "first_rows":
                                        '[{"name": "a\\"1", "v": 0.5}, {"name": "a\\"2", "v": null}, {"name": "a\\"3", "v": 1.5}]'}
    steps = spark.createDataFrame([(5, 1, 1, "submit_query", True, None, None), (5, 2, 2, "inspect_sample", None, None, "t"), (5, 3, 3, "submit_query", True, None, None),
                                   (5, 4, 4, "submit_query", False, "bad", None), (5, 5, 5, "inspect_schema", None, None, None)],
                                  "session_id long, event_id long, step long, action_type string, query_success boolean, error_message string, table_name string")
    samples = spark.createDataFrame([("t", "[1]")], "table_name string, sample_rows string")
    for carry in (False, True):
        got = {r["step"]: (r["result_rows"], r["result_error"], r["schema_info"], r["sample_rows"])
               for r in observation(steps, results, schema=F.lit("s"), samples=samples, carry=carry).collect()}
        assert got == {1: (4, None, None, None), 2: (4 if carry else None, None, None, "[1]"), 3: (0, None, None, None), 4: (None, "bad", None, None),
                       5: (None, "bad" if carry else None, "s", None)}
