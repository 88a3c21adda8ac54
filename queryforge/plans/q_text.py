"""Registered screening, completion-parsing and prompt queries (SC1-SC6, PD1-PD7, RW11-RW13, SF10-SF16)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from queryforge.functions import text as X
from queryforge.operators import observations as O
from queryforge.operators import prompts as P
from queryforge.operators import screening as SC
from queryforge.operators.reward import keyword_hit, keyword_reward
from queryforge.plans import q_episodes as QE
from queryforge.plans import q_sources as QS
from queryforge.plans import views as V
from queryforge.plans.registry import register
from queryforge.sources.tables import load_tables, sample_rows, schema_profile

TABLES = V.SQL_TABLES


def dstrip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _duck_guard(s: str, strict: bool) -> str:
    parts = []
    for kw in X.BLOCKED_WORDS:
        if strict:
            cond = f"(starts_with({s}, '{kw}') OR regexp_matches({s}, '(^|\\s){kw}(\\s|;|$)'))"
        else:
            cond = f"(starts_with({s}, '{kw}') OR contains({s}, ' {kw} '))"
        parts.append(f"CASE WHEN {cond} THEN '{kw}' END")
    return "COALESCE(" + ", ".join(parts) + ")"


_U = f"upper({dstrip('text')})"
_TABLES_SQL = "[" + ", ".join(f"'{t}'" for t in TABLES) + "]"
_REFS = f"len(list_filter({_TABLES_SQL}, lambda t: contains(upper(text), upper(t))))"
_RO = f"(starts_with({_U}, 'SELECT') OR starts_with({_U}, 'WITH'))"


@register("sql_write_guard", ("SC1", "SF10", "SF12"), sql=f"""
WITH {V.DUCK_SQL_TEXT}
SELECT text_id, {_duck_guard(_U, False)} AS blocked_kw, {_duck_guard(_U, True)} AS blocked_kw_strict,
  CASE WHEN {_duck_guard(_U, False)} IS NOT NULL THEN
    printf('BLOCKED: Only SELECT queries are allowed. ''%s'' is not permitted.', {_duck_guard(_U, False)}) END AS guard_message
FROM sql_text""")
def sql_write_guard(spark, sf_dir):
    """First blocked word per submitted text (reference rule, and the strict whitespace-aware rule)."""
    t = V.sql_text(spark, sf_dir)
    kw = X.write_guard("text")
    return t.select("text_id", kw.alias("blocked_kw"), X.write_guard("text", strict=True).alias("blocked_kw_strict"),
                    X.guard_message(kw).alias("guard_message"))


@register("sql_table_refs", ("SC2", "SC3", "SF13"), sql=f"""
WITH {V.DUCK_SQL_TEXT}
SELECT text_id, {_RO} AS read_only, {_REFS} AS n_refs,
       CAST({_REFS} AS DOUBLE) / {len(TABLES)} AS ref_fraction
FROM sql_text""")
def sql_table_refs(spark, sf_dir):
    """Read-only flag and known-table references (case-blind substring) per text."""
    t = SC.screen(V.sql_text(spark, sf_dir), "text", TABLES)
    return t.select("text_id", "read_only", "n_refs", "ref_fraction")


@register("sql_review", ("SC4", "RW11"), sql=f"""
WITH {V.DUCK_SQL_TEXT}
SELECT text_id, {_RO} AND {_REFS} > 0 AS approved,
  CASE WHEN NOT {_RO} THEN '{SC.REASON_READ_ONLY}'
       WHEN {_REFS} = 0 THEN '{SC.REASON_NO_TABLE.format(tables=SC.py_list_text(TABLES)).replace("'", "''")}'
       ELSE '{SC.REASON_OK}' END AS reason,
  CASE WHEN NOT ({_RO} AND {_REFS} > 0) THEN 1e-3 END AS review_reward
FROM sql_text""")
def sql_review(spark, sf_dir):
    """Review verdict per text; rejected submits earn the fixed 0.001."""
    return SC.review(V.sql_text(spark, sf_dir), "text", TABLES).select("text_id", "approved", "reason",
                                                                        "review_reward")


@register("sql_failure_report", ("SC6",), sql=f"""
WITH {V.DUCK_SQL_TEXT}
SELECT CASE WHEN {_duck_guard(_U, False)} IS NOT NULL THEN 'unsafe' WHEN NOT {_RO} THEN 'not_read_only'
            WHEN {_REFS} = 0 THEN 'schema_mismatch' ELSE 'ok' END AS failure_class, COUNT(*) AS n
FROM sql_text GROUP BY failure_class""")
def sql_failure_report(spark, sf_dir):
    return SC.failure_report(V.sql_text(spark, sf_dir), "text", TABLES)


_T = dstrip("text")
_TICKS = "chr(96)||chr(96)||chr(96)"
_FENCE_INNER = ("CASE WHEN starts_with(" + _T + ", " + _TICKS + ") THEN regexp_replace(split_part(" + _T + ", "
                + _TICKS + ", 2), '^json', '') ELSE " + _T + " END")
_FENCE_BODY = dstrip(_FENCE_INNER)


@register("completion_extract", ("PD5", "PD6", "SF14", "SF15"), sql=f"""
WITH {V.DUCK_SQL_TEXT}
SELECT text_id,
  {dstrip("CASE WHEN strpos(text, 'Fixed SQL:') > 0 THEN substr(text, strpos(text, 'Fixed SQL:') + 10) ELSE text END")} AS sql_first,
  {dstrip("string_split(text, 'Fixed SQL:')[-1]")} AS sql_last,
  {_FENCE_BODY} AS unfenced
FROM sql_text""")
def completion_extract(spark, sf_dir):
    """SQL after the first / last marker, and the fence-stripped body, per completion."""
    t = V.sql_text(spark, sf_dir)
    return t.select("text_id", X.after_first("text").alias("sql_first"), X.after_last("text").alias("sql_last"),
                    X.strip_fence("text").alias("unfenced"))


@register("completion_actions", ("PD7",), sql=f"""
WITH {V.DUCK_SQL_TEXT},
b AS (SELECT text_id, {_FENCE_BODY} AS body FROM sql_text),
s AS (SELECT text_id, body, regexp_extract(body, '(?s)\\{{.*\\}}', 0) AS span FROM b),
c AS (SELECT text_id, CASE WHEN json_valid(body) AND starts_with(body, '{{') THEN body
                           WHEN length(span) > 0 AND json_valid(span) THEN span END AS chosen FROM s)
SELECT text_id, CASE WHEN chosen IS NULL THEN 'inspect_error' ELSE json_extract_string(chosen, '$.action_type') END AS action_type,
       json_extract_string(chosen, '$.query') AS query, json_extract_string(chosen, '$.table_name') AS table_name
FROM c""")
def completion_actions(spark, sf_dir):
    """JSON action parsed from each completion, defaulting to inspect_error."""
    return P.parse_actions(V.sql_text(spark, sf_dir), "text").select("text_id", "action_type", "query", "table_name")


@register("keyword_rewards", ("RW12", "RW13"), sql=f"""
WITH {V.DUCK_SQL_TEXT}
SELECT text_id, CASE WHEN contains(upper(text), 'SELECT') AND contains(text, ';') THEN 1e0 ELSE 0e0 END AS keyword_reward,
       contains(upper(text), 'SELECT') OR contains(upper(text), 'FROM') OR contains(upper(text), 'WHERE') AS keyword_hit
FROM sql_text""")
def keyword_rewards(spark, sf_dir):
    """Keyword reward (SELECT and ';') and the lenient keyword hit, without jitter."""
    t = V.sql_text(spark, sf_dir)
    return t.select("text_id", keyword_reward("text").alias("keyword_reward"), keyword_hit("text").alias("keyword_hit"))


@register("keyword_accuracy", ("AG23", "RW13"), sql=f"""
WITH {V.DUCK_SQL_TEXT}
SELECT ROUND(AVG(CASE WHEN contains(upper(text), 'SELECT') OR contains(upper(text), 'FROM')
                        OR contains(upper(text), 'WHERE') THEN 1e0 ELSE 0e0 END) * 1e2, 6) AS pct_keyword_hit,
       ROUND(AVG(CASE WHEN contains(upper(text), 'SELECT') THEN 1e0 ELSE 0e0 END) * 1e2, 6) AS pct_select,
       ROUND(AVG(CASE WHEN contains(upper(text), 'SELECT') AND contains(text, ';') THEN 1e0 ELSE 0e0 END) * 1e2, 6) AS pct_reward
FROM sql_text""")
def keyword_accuracy(spark, sf_dir):
    """Accuracy percentages of the keyword checks over all texts."""
    t = V.sql_text(spark, sf_dir)
    pct = lambda c: F.round(F.avg(F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))) * F.lit(100.0), 6)
    return t.agg(pct(keyword_hit("text")).alias("pct_keyword_hit"),
                 pct(X.has_keywords("text", ("SELECT",))).alias("pct_select"),
                 pct(keyword_reward("text") == 1.0).alias("pct_reward"))


@register("training_prompts", ("PD1", "PD2"), sql=f"""
WITH {V.DUCK_SQL_TEXT}
SELECT 'Fix the following SQL query and provide only the fixed SQL.' || chr(10) || 'Task: Repair submission ' ||
       CAST(text_id AS VARCHAR) || chr(10) || 'Broken Query: ' || text || chr(10) || 'Fixed SQL:' AS prompt,
       CAST(text_id AS VARCHAR) AS task_id, c.copy
FROM sql_text, (SELECT unnest(range(1, 4)) AS copy) c""")
def training_prompts(spark, sf_dir):
    """Prompt table: three copies of a repair prompt per submitted text."""
    t = V.sql_text(spark, sf_dir).select(
        F.col("text_id").alias("task_id"), F.concat(F.lit("Repair submission "), F.col("text_id").cast("string"))
        .alias("description"), F.col("text").alias("broken_query"))
    return P.training_prompts(t, 3).select("prompt", "task_id", F.col("copy").cast("long").alias("copy"))


def _duck_fixed3(x: str) -> str:
    return f"printf('%.3f', {x})"


@register("step_prompts", ("PD3", "SF16"), sql=f"""
{QE._FOLD}
SELECT session_id, step,
  concat_ws(chr(10),
    printf('=== SQL Debugging Task (Step %d) ===', step + 1),
    'Task: ' || substr(COALESCE(t2.description, ''), 1, 500),
    '', 'ORIGINAL BROKEN QUERY:', '```sql', COALESCE(f.broken_query, ''), '```',
    CASE WHEN current_query IS NOT NULL AND length(current_query) > 0 THEN
      concat_ws(chr(10), '', 'YOUR LAST SUBMITTED QUERY:', '```sql', current_query, '```') END,
    CASE WHEN query_success = false THEN concat_ws(chr(10), '', 'LAST QUERY ERROR: ' || COALESCE(error_message, 'Unknown error')) END,
    CASE WHEN error_details IS NOT NULL AND length(error_details) > 0 THEN concat_ws(chr(10), '', 'ERROR DETAILS: ' || error_details) END,
    CASE WHEN hint_shown IS NOT NULL AND length(hint_shown) > 0 THEN concat_ws(chr(10), '', 'HINT: ' || hint_shown) END,
    '', 'Current score: ' || {_duck_fixed3('COALESCE(current_score, 0e0)')},
    'Steps remaining: ' || CAST(COALESCE(steps_remaining, 0) AS VARCHAR),
    'Expected output: ' || COALESCE(t2.expected_output_description, ''),
    '', 'What is your next action? (respond with ONLY valid JSON)') AS prompt
FROM f JOIN tasks t2 ON t2.task_id = f.task_id""")
def step_prompts(spark, sf_dir):
    """The prompt the agent would see after each accepted step (for the next step)."""
    f = QE.folded(spark, sf_dir)
    return f.select("session_id", "step", P.step_prompt(
        F.col("step") + 1, "description", "broken_query", "current_query", "query_success", "error_message",
        "error_details", "hint_shown", "current_score", "steps_remaining", "expected_output_description"
    ).alias("prompt"))


@register("jittered_rewards", ("SF19", "SF20", "RW12"))
def jittered_rewards(spark, sf_dir):
    """Keyword reward with seeded +-0.01 jitter and a fresh session id per completion (random: rows only)."""
    from queryforge.functions import scalar as S
    t = V.sql_text(spark, sf_dir)
    return t.select("text_id", keyword_reward("text", jitter_seed=42).alias("reward"),
                    S.session_uuid().alias("session_id"))


# ---------------------------------------------------------- PRJ10, PD3 ---
SHOWN_TABLES = ("customer", "orders")
#: The driver table behind each table that ``inspect_sample`` names, its columns and its key.
SAMPLED = {"customers": ("customer", ["c_custkey", "c_name", "c_acctbal"]), "departments": ("nation", ["n_nationkey", "n_name"]),
           "purchases": ("orders", ["o_orderkey", "o_custkey", "o_orderstatus"]), "orders": ("orders", ["o_orderkey", "o_custkey", "o_orderstatus"])}
_JSON_SQL = {"c_custkey": "%d", "c_name": '"%s"', "c_acctbal": "%s", "n_nationkey": "%d", "n_name": '"%s"', "o_orderkey": "%d", "o_custkey": "%d",
             "o_orderstatus": '"%s"', "status": '"%s"', "amount": "%s"}


def _duck_json(cols) -> str:
    args = ", ".join(f"CAST({c} AS VARCHAR)" if _JSON_SQL[c] == "%s" else c for c in cols)
    return "printf('{" + ", ".join(f'"{c}": {_JSON_SQL[c]}' for c in cols) + "}', " + args + ")"


_DUCK_OBSERVATIONS = f"""
{QE._FOLD}, {QS._DUCK_PROFILE.strip()},
res AS (SELECT task_key, COUNT(*) AS row_count,
               '[' || string_agg(CASE WHEN pos <= 3 THEN {_duck_json(["o_orderkey", "status", "amount"])} END, ', ' ORDER BY pos) || ']' AS first_rows
        FROM (SELECT o_custkey AS task_key, o_orderkey, o_orderstatus AS status, o_totalprice AS amount,
                     row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders) GROUP BY task_key),
sch AS (SELECT string_agg(line, chr(10) ORDER BY line) AS text FROM (
          SELECT '  ' || "table" || ': ' || string_agg("column" || ' (' || type || ')', ', ' ORDER BY ordinal) AS line
          FROM prof WHERE "table" IN {SHOWN_TABLES} GROUP BY "table")),
sam AS ({" UNION ALL ".join(f"SELECT '{name}' AS table_name, (SELECT '[' || string_agg({_duck_json(cols)}, ', ' ORDER BY {cols[0]}) || ']' FROM (SELECT * FROM {t} ORDER BY {cols[0]} LIMIT 3)) AS sample_rows"
                            for name, (t, cols) in SAMPLED.items())}),
obs AS (SELECT f.*, f.query_success AS result_success, CASE WHEN f.query_success THEN COALESCE(res.row_count, 0) END AS result_rows,
               CASE WHEN f.query_success THEN COALESCE(res.first_rows, '[]') END AS result_sample,
               CASE WHEN NOT f.query_success THEN COALESCE(f.error_message, 'Unknown error') END AS result_error,
               CASE WHEN f.action_type = 'inspect_schema' THEN sch.text END AS schema_info,
               CASE WHEN f.action_type = 'inspect_sample' THEN sam.sample_rows END AS sample_rows
        FROM f CROSS JOIN sch LEFT JOIN res ON res.task_key = f.session_id LEFT JOIN sam ON sam.table_name = f.table_name)"""


def observations_of(spark, sf_dir, carry=False):
    """Folded steps with what they show: a submit that ran returns the orders of the customer with the session's number."""
    rows = V.order_expected(spark, sf_dir).withColumnRenamed("task_key", "session_id")
    results = O.first_rows_json(rows, ["session_id"], "pos", ["o_orderkey", "status", "amount"])
    lines = P.schema_text(schema_profile(spark, load_tables(spark, sf_dir, SHOWN_TABLES, register=False)))
    schema = lines.select(F.array_join(F.sort_array(F.collect_list("line")), "\n")).scalar()
    samples = None
    for name, (table, cols) in SAMPLED.items():
        three = sample_rows(V.T(spark, sf_dir, table).select(*cols), 3, [cols[0]])
        three = three.withColumns({"table_name": F.lit(name), "pos": F.row_number().over(Window.orderBy(cols[0]))})  # three rows
        part = O.first_rows_json(three, ["table_name"], "pos", cols).select("table_name", F.col("first_rows").alias("sample_rows"))
        samples = part if samples is None else samples.unionByName(part)
    return O.observation(QE.folded(spark, sf_dir), results, ["session_id"], schema, samples, carry=carry)


OBSERVED = ["session_id", "step", "last_action_type", "result_success", "result_rows", "result_sample", "result_error", "schema_info", "sample_rows",
            "steps_remaining", "current_score", "is_done", "success"]


@register("observations", ("PRJ10",), sql=f"""
{_DUCK_OBSERVATIONS}
SELECT {", ".join("action_type AS last_action_type" if c == "last_action_type" else "ep_success AS success" if c == "success" else c for c in OBSERVED)} FROM obs""")
def observations(spark, sf_dir):
    """One row per accepted step: state, last result with its first rows, schema and sample rows as the action shows them."""
    return observations_of(spark, sf_dir).select(*OBSERVED)


@register("newest_results", ("PRJ10",), sql=f"""
{_DUCK_OBSERVATIONS}
SELECT session_id, step,
       LAST(CASE WHEN query_success IS NOT NULL THEN step END IGNORE NULLS) OVER w AS result_step,
       LAST(CASE WHEN query_success IS NOT NULL THEN COALESCE(result_rows, -1) END IGNORE NULLS) OVER w AS result_rows
FROM obs WINDOW w AS (PARTITION BY session_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def newest_results(spark, sf_dir):
    """As-of form: each step with the rows of the newest result so far (-1: it failed) and the step that gave it."""
    w = Window.partitionBy("session_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    o = observations_of(spark, sf_dir, carry=True)
    return o.select("session_id", "step", F.last(F.when(F.col("query_success").isNotNull(), F.col("step")), ignorenulls=True).over(w).alias("result_step"),
                    F.when(F.col("result_success").isNotNull(), F.coalesce("result_rows", F.lit(-1))).alias("result_rows"))


@register("observation_prompts", ("PD3", "PRJ10"), sql=f"""
{_DUCK_OBSERVATIONS}
SELECT session_id, step,
  concat_ws(chr(10),
    printf('=== SQL Debugging Task (Step %d) ===', step + 1),
    'Task: ' || substr(COALESCE(t2.description, ''), 1, 500),
    '', 'ORIGINAL BROKEN QUERY:', '```sql', COALESCE(obs.broken_query, ''), '```',
    CASE WHEN current_query IS NOT NULL AND length(current_query) > 0 THEN
      concat_ws(chr(10), '', 'YOUR LAST SUBMITTED QUERY:', '```sql', current_query, '```') END,
    CASE WHEN result_rows IS NOT NULL THEN
      concat_ws(chr(10), '', printf('LAST QUERY RESULT: %d rows returned', result_rows), 'Sample (first 3): ' || result_sample) END,
    CASE WHEN query_success = false THEN concat_ws(chr(10), '', 'LAST QUERY ERROR: ' || COALESCE(error_message, 'Unknown error')) END,
    CASE WHEN schema_info IS NOT NULL THEN concat_ws(chr(10), '', 'DATABASE SCHEMA:', schema_info) END,
    CASE WHEN error_details IS NOT NULL AND length(error_details) > 0 THEN concat_ws(chr(10), '', 'ERROR DETAILS: ' || error_details) END,
    CASE WHEN sample_rows IS NOT NULL THEN concat_ws(chr(10), '', 'SAMPLE ROWS: ' || sample_rows) END,
    CASE WHEN hint_shown IS NOT NULL AND length(hint_shown) > 0 THEN concat_ws(chr(10), '', 'HINT: ' || hint_shown) END,
    '', 'Current score: ' || {_duck_fixed3('COALESCE(current_score, 0e0)')},
    'Steps remaining: ' || CAST(COALESCE(steps_remaining, 0) AS VARCHAR),
    'Expected output: ' || COALESCE(t2.expected_output_description, ''),
    '', 'What is your next action? (respond with ONLY valid JSON)') AS prompt
FROM obs JOIN tasks t2 ON t2.task_id = obs.task_id""")
def observation_prompts(spark, sf_dir):
    """The prompt after each accepted step with all sections: result rows, schema and samples too."""
    o = observations_of(spark, sf_dir)
    return o.select("session_id", "step", P.step_prompt(
        F.col("step") + 1, "description", "broken_query", "current_query", "query_success", "error_message",
        "error_details", "hint_shown", "current_score", "steps_remaining", "expected_output_description",
        "result_rows", "result_sample", "schema_info", "sample_rows").alias("prompt"))
