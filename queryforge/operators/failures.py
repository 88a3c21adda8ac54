"""SC6: failure classes of result sets, by a multiset difference against the expected rows.

Every attempt gets the number of rows that are missing, that are too many, and whose values are wrong, and of the
latter how many are multiples of the expected ones.  Expected rows are counted by identity first and written, so an
attempt's row meets one row at most, on the task and the row's identity, never per task; after that join all that goes
on are counts by attempt and identity, summed before they move.  Where an identity has several expected values, its rows
meet them a second time, by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryforge.functions import text as X
from queryforge.operators.grading import normalize_rows
from queryforge.sources.tables import stored

#: The classes, in the order in which the first that holds is taken.
CLASSES = ("unsafe", "schema_mismatch", "error", "join_logic", "aggregation", "ok")
CENT = 0.005


def _multiple(actual: Column, expected: Column) -> Column:
    """``actual`` is two or more times ``expected``, to the cent."""
    times = F.round(actual / F.nullif(expected, F.lit(0.0)))
    return F.coalesce((times >= 2) & (F.abs(actual - times * expected) <= CENT * times), F.lit(False))


def result_diff(actual: DataFrame, expected: DataFrame, task_key: str, attempt_keys: Sequence[str], id_cols: Sequence[str],
                value_cols: Sequence[str], attempts: DataFrame | None = None) -> DataFrame:
    """Per attempt: n_actual, n_expected, n_missing, n_extra, n_wrong, n_multiplied.

    Rows are the same when ``id_cols`` agree (null equals null) after normalisation.  ``n_missing`` and ``n_extra`` count by
    identity, with repetitions; ``n_wrong`` are the rows found whose values differ; ``n_multiplied`` those of them, single on
    both sides, in which every numeric value that differs is a multiple of the expected one and no other value differs.
    ``attempts``: attempt keys and task, also of attempts without rows.
    """
    names = [*attempt_keys, task_key]
    numeric = [f.name for f in expected.schema.fields if f.name in value_cols and f.dataType.typeName() not in ("string", "boolean")]
    other = [c for c in value_cols if c not in numeric]

    def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
        return normalize_rows(df, [*id_cols, *value_cols]).select(
            F.struct(*keys).alias("_of"), F.struct(task_key).alias("_task"), F.struct(*id_cols).alias("_id"), F.struct(*value_cols).alias("_value"))

    a = keyed(actual, names)
    e = keyed(expected, [task_key]).groupBy("_task", "_id", "_value").agg(F.count(F.lit(1)).alias("n_e"))
    of_id = stored(e.groupBy("_task", "_id").agg(F.sum("n_e").alias("n_e"), F.first("_value").alias("w"), F.count(F.lit(1)).alias("values")), "expected-rows")
    alike = F.lit(True)
    for c in value_cols:
        alike = alike & F.col(f"_value.{c}").eqNullSafe(F.col(f"w.{c}"))
    number = lambda side, c: F.col(f"{side}.{c}").cast("double")
    multiplied = F.lit(True)
    for c in numeric:
        multiplied = multiplied & (F.col(f"_value.{c}").eqNullSafe(F.col(f"w.{c}")) | _multiple(number("_value", c), number("w", c)))
    for c in other:
        multiplied = multiplied & F.col(f"_value.{c}").eqNullSafe(F.col(f"w.{c}"))
    by_id = a.join(of_id, ["_task", "_id"], "left").select(
        "_of", "_id", "n_e", F.when(F.col("values") == 1, alike).alias("alike"), (~alike & multiplied).alias("multiplied")).groupBy("_of", "_id").agg(
        F.count(F.lit(1)).alias("n_a"), F.max("n_e").alias("n_e"), F.count_if("alike").alias("n_same"), F.count_if("multiplied").alias("n_multiplied"))
    per = by_id.groupBy("_of").agg(
        F.sum("n_a").alias("n_actual"), F.sum(F.least("n_a", F.coalesce("n_e", F.lit(0)))).alias("found"),
        F.sum(F.least("n_same", F.coalesce("n_e", F.lit(0)))).alias("same"),
        F.count_if((F.col("n_a") == 1) & (F.col("n_e") == 1) & (F.col("n_multiplied") == 1)).alias("n_multiplied"))
    several = of_id.where(F.col("values") > 1).select("_task", "_id")
    if not several.isEmpty():
        again = a.join(several, ["_task", "_id"], "left_semi").groupBy("_of", "_task", "_id", "_value").agg(F.count(F.lit(1)).alias("n_a"))
        more = again.join(e, ["_task", "_id", "_value"]).groupBy("_of").agg(F.sum(F.least("n_a", "n_e")).alias("more"))
        per = per.join(more, "_of", "left").withColumn("same", F.col("same") + F.coalesce("more", F.lit(0))).drop("more")
    if attempts is not None:
        per = attempts.select(F.struct(*names).alias("_of")).distinct().join(per, "_of", "left")
    total = of_id.groupBy("_task").agg(F.sum("n_e").alias("n_expected"))
    per = per.withColumn("_task", F.struct(F.col(f"_of.{task_key}").alias(task_key))).join(total, "_task", "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_actual", "n_expected", "same", "found", "n_multiplied")}
    return per.select("_of.*", n["n_actual"].alias("n_actual"), n["n_expected"].alias("n_expected"), (n["n_expected"] - n["found"]).alias("n_missing"),
                      (n["n_actual"] - n["found"]).alias("n_extra"), (n["found"] - n["same"]).alias("n_wrong"), n["n_multiplied"].alias("n_multiplied"))


def failure_classes(diff: DataFrame, attempts: DataFrame, keys: Sequence[str], sql: str | None = None, error: str | None = None) -> DataFrame:
    """``diff`` with ``failure_class`` of every attempt; ``attempts`` holds the submitted text and the error message, where there are any.

    unsafe: the write guard blocks the text; schema_mismatch: the error names an unknown table or column; error: any other one;
    join_logic: rows are missing or too many, or all wrong values are multiples of the right ones (a sum over a fan-out);
    aggregation: values are wrong otherwise.
    """
    d = attempts.withColumn("_k", F.struct(*keys)).join(diff.withColumn("_k", F.struct(*keys)).drop(*keys), "_k").drop("_k")
    blocked = X.write_guard(sql).isNotNull() if sql else F.lit(False)
    message = F.col(error) if error else F.lit(None).cast("string")
    unknown = X.error_progress(F.lit(False), message) > 0
    fan = (F.col("n_missing") > 0) | (F.col("n_extra") > 0) | ((F.col("n_wrong") > 0) & (F.col("n_multiplied") == F.col("n_wrong")))
    tests = (blocked, unknown, message.isNotNull(), fan, F.col("n_wrong") > 0)
    out = F.lit(CLASSES[-1])
    for test, name in reversed(list(zip(tests, CLASSES))):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(out)
    return d.withColumn("failure_class", out)
