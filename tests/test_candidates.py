"""Candidate execution outcomes and positions."""

from pyspark.sql import types as T

from queryforge.operators.candidates import run_candidates
from queryforge.sources.tables import local_frame


def test_outcomes_and_positions(spark):
    spark.range(50).selectExpr("id", "id % 7 AS g").createOrReplaceTempView("qf_nums")
    cand = local_frame(spark, [
        (1, "SELECT id AS x, g AS y FROM qf_nums ORDER BY g DESC, id"),
        (2, "DELETE FROM qf_nums"),
        (3, "SELEC id FROM qf_nums"),
        (4, "SELECT id AS x, id AS X FROM qf_nums"),
        (5, "SELECT id AS z FROM qf_nums"),
    ], T.StructType([T.StructField("candidate_id", T.LongType()), T.StructField("sql", T.StringType())]))
    out, rows = run_candidates(spark, cand, ["x", "y"])
    o = {r["candidate_id"]: r for r in out.collect()}
    assert o[1]["success"] and o[1]["row_count"] == 50
    assert o[2]["error_message"].startswith("BLOCKED") and not o[2]["success"]
    assert "PARSE_SYNTAX_ERROR" in o[3]["error_message"]
    assert "DUPLICATE_OUTPUT_NAMES" in o[4]["error_message"]
    assert o[5]["success"]
    got = [(r["x"], r["y"]) for r in rows.where("candidate_id = 1").orderBy("pos").collect()]
    exp = sorted(((i, i % 7) for i in range(50)), key=lambda t: (-t[1], t[0]))
    assert got == exp
    assert rows.where("candidate_id = 5").count() == 0
