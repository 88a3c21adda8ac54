"""Column-level helpers: scores, dates, formatting (``scalar``) and SQL/completion text (``text``)."""

from queryforge.functions import scalar, text

__all__ = ["scalar", "text"]
