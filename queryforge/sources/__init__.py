"""Sources and sinks (SRC1-SRC10) plus the task catalog and fixtures."""

from queryforge.sources.tables import (DRIVER_TABLES, load_tables, read_log_history, read_table,
                                       sample_rows, schema_profile)
from queryforge.sources.sinks import (metrics_frame, series_rows, write_jsonl, write_log_csv,
                                      write_metrics, write_series)
from queryforge.sources.tasks import fixture_tables, golden_rows, task_catalog

__all__ = [
    "DRIVER_TABLES", "load_tables", "read_log_history", "read_table", "sample_rows", "schema_profile",
    "metrics_frame", "series_rows", "write_jsonl", "write_log_csv", "write_metrics", "write_series",
    "fixture_tables", "golden_rows", "task_catalog",
]
