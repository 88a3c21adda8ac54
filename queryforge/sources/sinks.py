"""Sinks: JSON lines, one-object metrics, series bundles and CSV (SRC5-SRC8).

All writers are distributed DataFrame writes; the single-object outputs
(metrics, series) are built as one-row DataFrames by aggregation, so no data
row is collected on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SRC5: one JSON object per line (nulls omitted, as a dict dump of present keys)."""
    df.write.mode(mode).json(path)


def metrics_frame(series: DataFrame, log_rows: DataFrame, order_col: str = "log_idx",
                  value: str = "value") -> DataFrame:
    """One-row metrics object: log_rows, reward_points, reward_first/last (in log order)/max."""
    summary = series.agg(
        F.count(F.lit(1)).alias("reward_points"),
        F.min_by(value, order_col).alias("reward_first"),
        F.max_by(value, order_col).alias("reward_last"),
        F.max(value).alias("reward_max"),
    )
    n_rows = log_rows.select(F.count(F.lit(1))).scalar()  # scalar subquery, no join
    return summary.select(
        F.unix_timestamp(F.current_timestamp()).cast("double").alias("generated_at_epoch_s"),
        n_rows.alias("log_rows"), "reward_points", "reward_first", "reward_last", "reward_max")


def write_metrics(metrics: DataFrame, path: str, extra: DataFrame | None = None) -> None:
    """SRC6: one JSON object; ``extra`` (one row) extends it, as the before/after update does."""
    row = metrics if extra is None else metrics.select(
        "*", *[extra.select(c).scalar().alias(c) for c in extra.columns])  # one-row extension
    row.select(F.to_json(F.struct(*row.columns)).alias("value")) \
        .coalesce(1).write.mode("overwrite").text(path)


def series_rows(series: dict[str, DataFrame], step: str = "step", value: str = "value") -> DataFrame:
    """SRC7 body: every named series as rows (series, step, value)."""
    out = None
    for name, df in series.items():
        cols = df.columns
        part = df.select(F.lit(name).alias("series"),
                         (F.col(step) if step in cols else F.lit(None)).cast("double").alias("step"),
                         F.col(value).cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def write_series(series: dict[str, DataFrame], path: str, step: str = "step", value: str = "value") -> None:
    """SRC7: reward, loss and before/after samples written together.

    The source writes one JSON object holding every series as an array; a
    series grows with the run (one point per logged step or sample), so here it
    is written as JSON lines ``{"series", "step", "value"}`` by all tasks - no
    series is gathered into one row, task or the driver.  Readers regroup by
    ``series`` and order by ``step``.
    """
    series_rows(series, step, value).write.mode("overwrite").json(path)


def write_log_csv(df: DataFrame, path: str) -> None:
    """SRC8: log history as CSV with a header row."""
    df.write.mode("overwrite").option("header", True).csv(path)
