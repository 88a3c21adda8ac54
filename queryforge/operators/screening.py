"""Query-text screening as DataFrame transforms (SC1-SC4, SC6, RW11).

Everything but the optional syntax check is a Column expression, so a table
of any size is screened in one narrow stage.  The syntax check
(``review_syntax``) asks Spark's own parser/analyzer about each *distinct*
candidate text on the driver - meant for a bounded candidate list (a task's
presets, one trainer batch), like ``run_candidates``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queryforge.functions import text as X

# --- fixed values: review reasons ---
REASON_READ_ONLY = "Only SELECT queries or CTEs (WITH) are allowed."
REASON_NO_TABLE = "Query does not reference any valid tables. Available: {tables}"
REASON_OK = "Query approved"


def py_list_text(names: Sequence[str]) -> str:
    """Python's repr of a list of strings, as the review message prints it."""
    return "[" + ", ".join(repr(n) for n in names) + "]"


def screen(df: DataFrame, sql: str, tables: Sequence[str], strict: bool = False) -> DataFrame:
    """SC1-SC3: blocked word, read-only flag and table references as new columns."""
    return df.withColumns({
        "blocked_kw": X.write_guard(sql, strict=strict),
        "read_only": X.read_only(sql),
        "n_refs": X.table_ref_count(sql, list(tables)),
        "ref_fraction": X.table_ref_fraction(sql, list(tables)),
    })


def review_columns(sql, tables: Sequence[str] | Column) -> tuple[Column, Column]:
    """SC4 (first two checks): read-only, then at least one known table; first failure is the reason.

    ``tables``: the names for all rows, or an array column with each row's own.
    """
    ro = X.read_only(sql)
    if isinstance(tables, Column):
        refs, some = X.table_ref_count(sql, tables), F.size(tables) > 0
        names = F.concat(F.lit("['"), F.array_join(tables, "', '"), F.lit("']"))
    else:
        refs, some, names = X.table_ref_count(sql, list(tables)), F.lit(len(tables) > 0), F.lit(py_list_text(tables))
    before, after = (F.lit(x) for x in REASON_NO_TABLE.split("{tables}"))
    reason = (F.when(~ro, F.lit(REASON_READ_ONLY)).when((refs == 0) & some, F.concat(before, names, after))
              .otherwise(F.lit(REASON_OK)))
    return ro & ((refs > 0) | ~some), reason


def review(df: DataFrame, sql: str, tables: Sequence[str]) -> DataFrame:
    """SC4 + RW11: approved, reason, and the fixed 0.001 reward of a rejected submit."""
    approved, reason = review_columns(sql, tables)
    return df.withColumns({"approved": approved, "reason": reason}).withColumn(
        "review_reward", F.when(~F.col("approved"), F.lit(0.001)))


def failure_class(sql, tables: Sequence[str]) -> Column:
    """SC6 class of a submitted text: unsafe / not_read_only / schema_mismatch / ok."""
    return (F.when(X.write_guard(sql).isNotNull(), F.lit("unsafe"))
            .when(~X.read_only(sql), F.lit("not_read_only"))
            .when(X.table_ref_count(sql, list(tables)) == 0, F.lit("schema_mismatch"))
            .otherwise(F.lit("ok")))


def failure_report(df: DataFrame, sql: str, tables: Sequence[str]) -> DataFrame:
    """SC6: counts per failure class."""
    return df.groupBy(failure_class(sql, tables).alias("failure_class")).agg(F.count(F.lit(1)).alias("n"))


def analyse_query(spark: SparkSession, text: str) -> None:
    """Parse and analyse a text as a subquery, where no command (INSERT, CREATE, SET, ...) can stand; raises if it is none."""
    spark.sql(f"SELECT * FROM (\n{(text or '').strip().rstrip(';')}\n) LIMIT 0").schema  # noqa: S608


def review_syntax(spark: SparkSession, texts: DataFrame, sql: str = "sql") -> DataFrame:
    """SC4 syntax part: parse and analyse each distinct text with Spark on the driver.

    Planning a text is work of the driver; the texts come one at a time, and
    none is run: only a query passes (``analyse_query``).
    """
    distinct = texts.select(sql).distinct()
    rows = []
    for r in distinct.toLocalIterator():
        q = r[0]
        try:
            analyse_query(spark, q)
            rows.append((q, True, None))
        except Exception as e:  # noqa: BLE001 - any analysis failure is a rejection reason
            rows.append((q, False, f"Syntax error caught by Reviewer: {e}"))
    checked = spark.createDataFrame(rows, f"{sql} string, syntax_ok boolean, syntax_reason string")
    return texts.join(checked, sql, "left")
