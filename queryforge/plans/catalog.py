"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from queryforge.plans import (q_candidates, q_episodes, q_grading, q_relational, q_runs,  # noqa: F401
                              q_sources, q_text)
from queryforge.plans.registry import COVERS, ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE", "COVERS"]
