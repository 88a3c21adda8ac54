"""Prompt tables and completion parsing (PD1-PD7) as DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryforge.functions import scalar as S
from queryforge.functions import text as X

# --- fixed values: prompt texts ---
TRAIN_HEAD = "Fix the following SQL query and provide only the fixed SQL."
STEP_TAIL = "What is your next action? (respond with ONLY valid JSON)"
TASK_CUT = 500
RESULT_ROWS = "LAST QUERY RESULT: %d rows returned"
RESULT_SAMPLE = "Sample (first 3): "
SCHEMA_TITLE = "DATABASE SCHEMA:"
SAMPLE_ROWS = "SAMPLE ROWS: "
PROMPT_TITLE = "=== SQL Debugging Task (Step %d) ==="
BROKEN_TITLE = "ORIGINAL BROKEN QUERY:"
SUBMITTED_TITLE = "YOUR LAST SUBMITTED QUERY:"
ERROR_TITLE = "LAST QUERY ERROR: "
DETAILS_TITLE = "ERROR DETAILS: "
HINT_TITLE = "HINT: "


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def training_prompt(description, broken_query, marker: str = X.SQL_MARKER) -> Column:
    """PD1: ``head\\nTask: ..\\nBroken Query: ..\\n<marker>``."""
    return F.concat(F.lit(TRAIN_HEAD + "\nTask: "), _c(description), F.lit("\nBroken Query: "), _c(broken_query),
                    F.lit("\n" + marker))


def replicate(df: DataFrame, n: int, name: str = "copy") -> DataFrame:
    """PD2: n copies of every row (n >= 1) via ``explode(sequence(1, n))``."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(max(1, n)))))


def training_prompts(tasks: DataFrame, n: int, description: str = "description", broken: str = "broken_query",
                     task_id: str = "task_id", marker: str = X.SQL_MARKER) -> DataFrame:
    """PD1 + PD2: (prompt, task_id) rows, ``n`` per task."""
    return replicate(tasks.select(training_prompt(description, broken, marker).alias("prompt"),
                                  F.col(task_id).cast("string").alias("task_id")), n)


def _section(cond: Column, *lines: Column | str) -> Column:
    parts = [F.lit(x) if isinstance(x, str) else x for x in lines]
    return F.when(cond, F.concat_ws("\n", F.lit(""), *parts))


def step_prompt(obs_step, description, broken_query, current_query=None, query_success=None,
                error_message=None, error_details=None, hint=None, current_score="current_score",
                steps_remaining="steps_remaining", expected="expected_output_description",
                result_rows=None, result_sample=None, schema_info=None, sample_rows=None) -> Column:
    """PD3: the multi-section step prompt; absent sections drop out (``concat_ws`` skips nulls).

    ``result_rows``, ``result_sample`` (of the last query, when it ran), ``schema_info`` and ``sample_rows`` come from
    ``observations.observation``.
    """
    cq = _c(current_query) if current_query is not None else F.lit(None).cast("string")
    parts = [
        F.format_string(PROMPT_TITLE, _c(obs_step)),
        F.concat(F.lit("Task: "), F.substring(F.coalesce(_c(description), F.lit("")), 1, TASK_CUT)),
        F.lit(""), F.lit(BROKEN_TITLE), F.lit("```sql"), F.coalesce(_c(broken_query), F.lit("")),
        F.lit("```"),
        _section(cq.isNotNull() & (F.length(cq) > 0), SUBMITTED_TITLE, "```sql", cq, "```"),
    ]
    if result_rows is not None:
        parts.append(_section(_c(result_rows).isNotNull(), F.format_string(RESULT_ROWS, _c(result_rows).cast("long")),
                              F.concat(F.lit(RESULT_SAMPLE), _c(result_sample))))
    if query_success is not None:
        parts.append(_section(_c(query_success) == F.lit(False), F.concat(
            F.lit(ERROR_TITLE), F.coalesce(_c(error_message), F.lit("Unknown error")))))
    if schema_info is not None:
        parts.append(_section(_c(schema_info).isNotNull(), SCHEMA_TITLE, F.when(F.length(_c(schema_info)) > 0, _c(schema_info))))
    if error_details is not None:
        ed = _c(error_details)
        parts.append(_section(ed.isNotNull() & (F.length(ed) > 0), F.concat(F.lit(DETAILS_TITLE), ed)))
    if sample_rows is not None:
        parts.append(_section(_c(sample_rows).isNotNull(), F.concat(F.lit(SAMPLE_ROWS), _c(sample_rows))))
    if hint is not None:
        h = _c(hint)
        parts.append(_section(h.isNotNull() & (F.length(h) > 0), F.concat(F.lit(HINT_TITLE), h)))
    parts += [
        F.lit(""),
        F.concat(F.lit("Current score: "), S.py_fixed(F.coalesce(_c(current_score), F.lit(0.0)), 3)),
        F.concat(F.lit("Steps remaining: "), F.coalesce(_c(steps_remaining), F.lit(0)).cast("string")),
        F.concat(F.lit("Expected output: "), F.coalesce(_c(expected), F.lit(""))),
        F.lit(""),
        F.lit(STEP_TAIL),
    ]
    return F.concat_ws("\n", *parts)


def schema_text(profile: DataFrame) -> DataFrame:
    """PD4: ``  table: col (type), ..`` per table, columns in ordinal order."""
    return (profile.groupBy("table")
            .agg(F.sort_array(F.collect_list(F.struct("ordinal", "column", "type"))).alias("c"))
            .select("table", F.concat(F.lit("  "), F.col("table"), F.lit(": "), F.array_join(
                F.transform("c", lambda x: F.format_string("%s (%s)", x["column"], x["type"])), ", ")).alias("line")))


def extract_sql(df: DataFrame, text: str, marker: str = X.SQL_MARKER, last: bool = False, name: str = "sql") -> DataFrame:
    """PD5: the SQL after the (first or last) marker, stripped; the whole text when absent."""
    return df.withColumn(name, X.after_last(text, marker) if last else X.after_first(text, marker))


def parse_actions(df: DataFrame, text: str) -> DataFrame:
    """PD6 + PD7: fence-stripped JSON action columns (default ``inspect_error``)."""
    return df.withColumn("_a", X.parse_action(text)).select("*", "_a.*").drop("_a")
