"""Result-set grading over many attempts at once (GR1-GR6, JN9-JN11, ST3).

Inputs are long-form tables: ``actual`` = (attempt keys, task key, pos, value
columns) and ``expected`` = (task key, pos, value columns).  Positions are
explicit columns, so positional comparison (JN9) is an equi-join on
``(task, pos)`` - no window, no skew: a task with a billion expected rows
joins like any other key.  Per-attempt counts use partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryforge.functions import scalar as S
from queryforge.functions import text as X
from queryforge.operators.scan import ordered_scan

# --- fixed values: grading rules ---
COUNT_MISMATCH_CAP = 0.5
NAME_PENALTY = 0.7
TOLERANCE = 1.0
KEYED_WRONG_COUNT = 0.1
KEYED_ALL = 1.0
KEYED_ONE = 0.7
KEYED_NONE = 0.5


def normalize_rows(df: DataFrame, value_cols: Sequence[str], digits: int = 2) -> DataFrame:
    """GR1: strip strings, round floating values to ``digits`` (Python rounding); others as is."""
    out = []
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in df.columns:
        if c in value_cols and isinstance(types[c], T.StringType):
            out.append(X.strip(c).alias(c))
        elif c in value_cols and isinstance(types[c], (T.DoubleType, T.FloatType)):
            out.append(S.py_round(c, digits).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def normalized_names(names) -> Column:
    """Name set after lower-case + strip (as the row dicts are keyed)."""
    return F.array_sort(F.array_distinct(F.transform(names, lambda n: X.lower_strip(n))))


def raw_names(names) -> Column:
    return F.array_sort(F.array_distinct(names))


def match_count(actual: DataFrame, expected: DataFrame, task_key: str, attempt_keys: Sequence[str],
                value_cols: Sequence[str], pos: str = "pos") -> DataFrame:
    """GR2/JN9: per attempt, rows equal at the same position (null == null); extra rows ignored.

    One left join of the actual rows onto (task, pos) of the expected rows gives
    both the attempt's row count and its matches, so the (costly) actual result
    sets are read once.
    """
    a = normalize_rows(actual, value_cols).select(*attempt_keys, task_key, pos,
                                                  *[F.col(c).alias(f"a_{c}") for c in value_cols])
    e = normalize_rows(expected, value_cols).select(task_key, pos, F.lit(True).alias("_e"),
                                                    *[F.col(c).alias(f"e_{c}") for c in value_cols])
    j = a.join(e, [task_key, pos], "left")
    same = F.col("_e").isNotNull()
    for c in value_cols:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"e_{c}"))
    return j.groupBy(*attempt_keys, task_key).agg(F.count(F.lit(1)).alias("n_actual"),
                                                  F.count_if(same).alias("matches"))


def grade_positional(actual: DataFrame, expected: DataFrame, task_key: str, attempt_keys: Sequence[str],
                     value_cols: Sequence[str], pos: str = "pos", actual_names: DataFrame | None = None,
                     expected_names: Sequence[str] | None = None, name_key: Sequence[str] | None = None,
                     attempt_index: DataFrame | None = None) -> DataFrame:
    """GR3: the base grader, per attempt.

    * no actual rows: 0.001;  no expected rows: 0.999 when the attempt is empty
      too (F2 fix), else 0.001;
    * different count: ``min(0.5, matches / n_expected * 0.5)``;
    * same count: ``matches / n_expected``, x0.7 when the raw column-name sets
      differ (F3: only case or outer blanks can differ once rows match);
    * clamped to [0.001, 0.999] and rounded to 3 digits (Python rounding).

    ``actual_names`` (``name_key`` columns + ``names`` array) gives the column
    names each attempt reported; by default they equal ``expected_names``.
    """
    attempt_keys = list(attempt_keys)
    exp_names = list(expected_names or value_cols)
    m = match_count(actual, expected, task_key, attempt_keys, value_cols, pos)
    n_exp = expected.groupBy(task_key).agg(F.count(F.lit(1)).alias("n_expected"))
    g = _with_empty(m, attempt_index, [*attempt_keys, task_key]).join(n_exp, task_key, "left")
    exp_arr = F.array(*[F.lit(n) for n in exp_names])
    if actual_names is not None:
        g = g.join(actual_names, list(name_key or attempt_keys), "left")
        act_arr = F.coalesce(F.col("names"), exp_arr)
    else:
        act_arr = exp_arr
    n_a = F.coalesce(F.col("n_actual"), F.lit(0))
    n_e = F.coalesce(F.col("n_expected"), F.lit(0))
    norm_same = normalized_names(act_arr) == normalized_names(exp_arr)
    raw_same = raw_names(act_arr) == raw_names(exp_arr)
    matches = F.when(norm_same, F.coalesce(F.col("matches"), F.lit(0))).otherwise(F.lit(0))
    ratio = matches.cast("double") / F.greatest(n_e, F.lit(1)).cast("double")
    score = (F.when(n_a == 0, F.when(n_e == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
             .when(n_e == 0, F.lit(0.0))
             .when(n_a != n_e, F.least(F.lit(COUNT_MISMATCH_CAP), ratio * F.lit(COUNT_MISMATCH_CAP)))
             .otherwise(ratio * F.when(raw_same, F.lit(1.0)).otherwise(F.lit(NAME_PENALTY))))
    return g.select(*attempt_keys, task_key, n_a.alias("n_actual"), n_e.alias("n_expected"),
                    matches.alias("matches"), raw_same.alias("names_match"),
                    S.py_clamp_round(score).alias("score"))


def _with_empty(counts: DataFrame, attempt_index: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Per-attempt counts with a row of null counts for every attempt of the index that has no row; null keys match."""
    if attempt_index is None:
        return counts
    index = attempt_index.select(F.struct(*keys).alias("_attempt")).distinct()
    found = counts.select(F.struct(*keys).alias("_attempt"), *[c for c in counts.columns if c not in keys])
    return index.join(found, "_attempt", "left").select("_attempt.*", *[c for c in found.columns if c != "_attempt"])


def grade_sorted_tolerant(actual: DataFrame, expected: DataFrame, task_key: str, attempt_keys: Sequence[str],
                          key_col: str, count_col: str, value_col: str, pos: str = "pos",
                          chunk: Column | None = None, attempt_index: DataFrame | None = None) -> DataFrame:
    """GR4/JN10: needs the exact count; both sides sorted by the key text and paired.

    A pair matches when the keys agree case-blind, the counts are equal and the
    value is within 1.0 (a null expected accepts null or 0).  Score =
    matches / n, clamped and rounded.  Sorting is a skew-safe ordinal (stable:
    ties keep the submitted position).  An attempt of ``attempt_index`` without
    rows scores 0.001, also where no row is expected.
    """
    attempt_keys = list(attempt_keys)
    a = actual.withColumn("_k", F.coalesce(F.col(key_col).cast("string"), F.lit("")))
    a = ordered_scan(a, [*attempt_keys, task_key], ["_k", pos], [("_spos", "count", None)], chunk=chunk)
    e = expected.withColumn("_k", F.coalesce(F.col(key_col).cast("string"), F.lit("")))
    e = ordered_scan(e, [task_key], ["_k", pos], [("_spos", "count", None)], chunk=chunk)
    av = a.select(*attempt_keys, task_key, "_spos", F.col("_k").alias("a_k"), F.col(count_col).alias("a_n"),
                  F.col(value_col).alias("a_v"))
    ev = e.select(task_key, "_spos", F.col("_k").alias("e_k"), F.col(count_col).alias("e_n"),
                  F.col(value_col).alias("e_v"))
    ev = ev.withColumn("_e", F.lit(True))
    j = av.join(ev, [task_key, "_spos"], "left")  # one pass over the actual rows: count and matches
    ok = (F.col("_e").isNotNull() & (F.lower(F.col("a_k")) == F.lower(F.col("e_k")))
          & (F.col("a_n").cast("long") == F.col("e_n").cast("long"))
          & S.tolerant_equal("a_v", "e_v", TOLERANCE))
    per = j.groupBy(*attempt_keys, task_key).agg(F.count(F.lit(1)).alias("n_actual"), F.count_if(ok).alias("matches"))
    g = (_with_empty(per, attempt_index, [*attempt_keys, task_key])
         .join(expected.groupBy(task_key).agg(F.count(F.lit(1)).alias("n_expected")), task_key, "left"))
    n_a, n_e = F.coalesce(F.col("n_actual"), F.lit(0)), F.coalesce(F.col("n_expected"), F.lit(0))
    matches = F.coalesce(F.col("matches"), F.lit(0))
    score = F.when((n_a == 0) | (n_a != n_e), F.lit(0.0)).otherwise(matches.cast("double") / n_e.cast("double"))
    return g.select(*attempt_keys, task_key, n_a.alias("n_actual"), n_e.alias("n_expected"),
                    matches.alias("matches"), S.py_clamp_round(score).alias("score"))


def grade_keyed_tiers(actual: DataFrame, expected: DataFrame, task_key: str, attempt_keys: Sequence[str],
                      name_col: str, value_cols: Sequence[str], attempt_index: DataFrame | None = None) -> DataFrame:
    """GR5/JN11: keyed lookup with tiers (unclamped, F4).

    Empty (an attempt of ``attempt_index`` without rows) 0.0; wrong row count
    0.1; every expected key right 1.0; exactly one right 0.7; otherwise 0.5.  A
    row is right when its name is expected and all values equal
    ``float(v or 0)``; unknown names are skipped.
    """
    attempt_keys = list(attempt_keys)
    a = actual.select(*attempt_keys, task_key, name_col, *[S.zero_default(c).alias(f"a_{c}") for c in value_cols])
    e = expected.select(task_key, name_col, *[F.col(c).cast("double").alias(f"e_{c}") for c in value_cols])
    j = a.join(e, [task_key, name_col], "left")
    known = F.lit(False)
    for c in value_cols:
        known = known | F.col(f"e_{c}").isNotNull()
    right = F.lit(True)
    for c in value_cols:
        right = right & (F.col(f"a_{c}") == F.coalesce(F.col(f"e_{c}"), F.lit(0.0)))
    per = j.groupBy(*attempt_keys, task_key).agg(
        F.count(F.lit(1)).alias("n_actual"),
        F.count_if(known & right).alias("correct"))
    n_exp = expected.groupBy(task_key).agg(F.count(F.lit(1)).alias("n_expected"))
    g = _with_empty(per, attempt_index, [*attempt_keys, task_key]).join(n_exp, task_key, "left")
    n_a, n_e, c = (F.coalesce(F.col(x), F.lit(0)) for x in ("n_actual", "n_expected", "correct"))
    score = (F.when(n_a == 0, F.lit(0.0)).when(n_a != n_e, F.lit(KEYED_WRONG_COUNT))
             .when(c == n_e, F.lit(KEYED_ALL)).when(c == 1, F.lit(KEYED_ONE)).otherwise(F.lit(KEYED_NONE)))
    return g.select(*attempt_keys, task_key, n_a.alias("n_actual"), n_e.alias("n_expected"),
                    c.alias("correct"), score.alias("score"))


def unknown_tasks(refs: DataFrame, tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """JN12 (anti form): referenced task ids with no catalog entry."""
    return refs.join(F.broadcast(tasks.select(key)), key, "left_anti")


def with_task(refs: DataFrame, tasks: DataFrame, key: str = "task_id", cols: Sequence[str] = ()) -> DataFrame:
    """JN12: task-dimension lookup (the catalog is a fixed four-row table: broadcast)."""
    return refs.join(F.broadcast(tasks.select(key, *cols)), key, "inner")


# --- task plug-ins (UD2): graders by name; a task may bring a function of its own with the same arguments ---
def _positional(actual, expected, keys, cols, grading, index):
    return grade_positional(actual, expected, "task_key", keys, cols, attempt_index=index)


def _sorted_tolerant(actual, expected, keys, cols, grading, index):
    return grade_sorted_tolerant(actual, expected, "task_key", keys, grading["key"], grading["count"], grading["value"], attempt_index=index)


def _keyed_tiers(actual, expected, keys, cols, grading, index):
    return grade_keyed_tiers(actual, expected, "task_key", keys, grading["name"], grading["values"], attempt_index=index)


GRADERS = {"positional": _positional, "sorted_tolerant": _sorted_tolerant, "keyed_tiers": _keyed_tiers}


def grade_for_task(spark, task_id: str, actual: DataFrame, attempt_keys: Sequence[str] = ("attempt",),
                   pos: str = "pos", attempt_index: DataFrame | None = None) -> DataFrame:
    """GR6/UD2: grade attempts at one registered task with the grader the task declares.

    ``actual`` holds the attempt keys, ``pos`` and the task's output columns;
    the expected rows are the task's golden rows (GR7), positioned in
    their query order.  ``attempt_index`` (attempt keys) adds attempts without rows.
    """
    from queryforge.operators.scan import ordinal
    from queryforge.sources.tasks import TASKS, golden_rows

    task, keys = TASKS[task_id], list(attempt_keys)
    gold = golden_rows(spark, task_id)
    exp = ordinal(gold.withColumn("_mid", F.monotonically_increasing_id()).withColumn("task_key", F.lit(0)),
                  ["task_key"], ["_mid"], "pos").drop("_mid")
    act = actual.withColumnRenamed(pos, "pos").withColumn("task_key", F.lit(0))
    index = None if attempt_index is None else attempt_index.select(*keys).withColumn("task_key", F.lit(0))
    grader = task.grader if callable(task.grader) else GRADERS[task.grader]
    return grader(act, exp, keys, gold.columns, dict(task.grading), index).drop("task_key")
