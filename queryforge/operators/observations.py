"""PRJ10: what the environment shows after each step, with the result, schema and sample sections.

A result set of any size becomes one row before it meets the steps: its row count and its first rows as JSON
text, gathered by a partial aggregate that drops all other rows map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_object(df: DataFrame, cols: Sequence[str]) -> Column:
    """A row as JSON text with blanks after ``,`` and ``:``; what JSON has no type for (dates, decimals, ..) becomes its text, null stays null."""
    parts = []
    for c in cols:
        plain = df.schema[c].dataType.typeName() in ("string", "boolean", "byte", "short", "integer", "long", "float", "double")
        text = F.to_json(F.array(F.col(c) if plain else F.col(c).cast("string")))
        parts.append(F.concat(F.to_json(F.array(F.lit(c))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(c)))) - 2), F.lit(": "),
                              text.substr(F.lit(2), F.length(text) - 2)))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def first_rows_json(rows: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], first: int = 3) -> DataFrame:
    """(keys, row_count, first_rows): per key its number of rows and the rows at positions 1 to ``first`` as a JSON list."""
    kept = F.when(F.col(pos) <= first, F.struct(F.col(pos), json_object(rows, cols).alias("j")))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.sort_array(F.collect_list(kept)).alias("r"))
    return out.select(*keys, "row_count", F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["j"]), ", "), F.lit("]")).alias("first_rows"))


def observation(folded: DataFrame, results: DataFrame | None = None, result_key: Sequence[str] = ("event_id",), schema: Column | None = None,
                samples: DataFrame | None = None, keys: Sequence[str] = ("session_id",), carry: bool = False) -> DataFrame:
    """PRJ10: the folded steps with last_action_type, result_success, result_rows, result_sample, result_error, schema_info, sample_rows.

    * ``results`` (``first_rows_json`` with ``result_key``): what a submit that ran returned; none of its rows are there for a
      submit without a row in ``results``.  Only a submit shows its result; with ``carry`` every later step shows the newest one.
    * ``schema``: the text that ``inspect_schema`` shows.
    * ``samples`` (table_name, sample_rows): what ``inspect_sample`` of a table shows.
    """
    a = F.col("action_type")
    submit = (a == "submit_query") & F.col("query_success").isNotNull()
    out = folded
    if results is not None:
        r = results.select(F.struct(*result_key).alias("_r"), F.col("row_count").alias("_n"), F.col("first_rows").alias("_rows"))
        out = out.withColumn("_r", F.struct(*result_key)).join(r, "_r", "left").drop("_r")
    else:
        out = out.withColumns({"_n": F.lit(None).cast("long"), "_rows": F.lit(None).cast("string")})
    ran = submit & F.col("query_success")
    last = F.when(submit, F.struct(
        F.col("query_success").alias("success"), F.when(ran, F.coalesce("_n", F.lit(0).cast("long"))).alias("rows"),
        F.when(ran, F.coalesce("_rows", F.lit("[]"))).alias("sample"),
        F.when(~F.col("query_success"), F.coalesce("error_message", F.lit("Unknown error"))).alias("error")))
    if carry:  # an episode has at most its budget of steps
        episode = [k for k in (*keys, "episode_no") if k in folded.columns]
        w = Window.partitionBy(*episode).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = F.last(last, ignorenulls=True).over(w)
    out = out.withColumn("_last", last).withColumns({
        "last_action_type": a, "result_success": F.col("_last.success"), "result_rows": F.col("_last.rows"),
        "result_sample": F.col("_last.sample"), "result_error": F.col("_last.error"),
        "schema_info": F.when(a == "inspect_schema", schema if schema is not None else F.lit(None).cast("string"))}).drop("_last", "_n", "_rows")
    if samples is None:
        return out.withColumn("sample_rows", F.lit(None).cast("string"))
    s = samples.select(F.col("table_name").alias("_t"), "sample_rows")
    return out.join(s, (out["table_name"] == s["_t"]) & (out["action_type"] == "inspect_sample"), "left").drop("_t")
