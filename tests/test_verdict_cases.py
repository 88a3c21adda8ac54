"""Cases that an earlier version got wrong: long episodes, ungraded steps, commands sent as queries, stores other than the local disk."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

from queryforge.operators import reward, screening
from queryforge.operators.candidates import run_candidates
from queryforge.sources.tables import load_tables


def test_ungraded_submit_earns_no_correctness(spark):
    cols = ("action_type string, grade_used double, success boolean, error_message string, query string, tables array<string>, "
            "step int, max_steps int, prev_best double")
    df = spark.createDataFrame([("submit_query", None, False, "x", "SELECT 1", [], 1, 10, 0.001),
                                ("submit_query", 0.001, False, "x", "SELECT 1", [], 1, 10, 0.001)], cols)
    null, low = df.select(*[c.alias(n) for n, c in reward.reward_columns().items()]).collect()
    assert null == low


@pytest.mark.parametrize("text", ["WITH x AS (SELECT 1 AS a)\nINSERT INTO region SELECT * FROM x", "SET spark.sql.shuffle.partitions=7",
                                  "CREATE TABLE zz AS SELECT 1 AS a"])
def test_commands_never_run(spark, text):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(Exception):
        screening.analyse_query(spark, text)
    outcome, _ = run_candidates(spark, spark.createDataFrame([(1, text)], "candidate_id bigint, sql string"), ["a"])
    assert not outcome.first()["success"]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and not spark.catalog.tableExists("zz")


def test_tables_by_uri(spark):
    assert set(load_tables(spark, f"file://{SF_SMALL}", register=False)) == set(load_tables(spark, SF_SMALL, register=False)) != set()


def test_long_episodes_keep_every_row(spark):
    from queryforge.operators.episodes import fold_episodes
    from queryforge.plans import views
    from queryforge.sources.tasks import task_catalog

    steps, tasks = views.steps(spark, SF_SMALL), task_catalog(spark)
    one = steps.limit(1).drop("event_id")
    many = one.crossJoin(spark.range(50).select(F.col("id").alias("event_id")))
    assert fold_episodes(many, tasks.withColumn("max_steps", F.lit(60))).count() == 50
