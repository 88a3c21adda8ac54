"""Registry of named queries: each is ``fn(spark, sf_dir) -> DataFrame`` plus,
where the result is SQL-expressible, its DuckDB twin over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def _bigint_count_if(sql: str) -> str:
    """DuckDB's COUNT_IF is HUGEINT; wrap each call as BIGINT so both engines report bigint."""
    out, i, key = [], 0, "COUNT_IF("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j])
        out.append("CAST(" + sql[j:k + 1] + " AS BIGINT)")
        i = k + 1


def register(name: str, covers: tuple[str, ...] = (), sql: str | None = None):
    """Decorator: add a query (and its oracle SQL, when given) under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        COVERS[name] = tuple(covers)
        if sql is not None:
            ORACLE[name] = _bigint_count_if(sql.strip())
        return fn
    return deco
