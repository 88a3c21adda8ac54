"""Text Column helpers over submitted SQL and model completions.

SF10-SF15, SC1-SC3, SC5 and PD5-PD7 as Column expressions (regex, JSON and
array higher-order functions), so screening a billion submissions is a
narrow map stage with no Python in the loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: write-guard words (in checking order) and parse defaults ---
BLOCKED_WORDS = ("DROP", "DELETE", "UPDATE", "INSERT", "CREATE", "ALTER",
                 "TRUNCATE", "REPLACE", "ATTACH", "DETACH")
READ_PREFIXES = ("SELECT", "WITH")
DEFAULT_ACTION = "inspect_error"
SQL_MARKER = "Fixed SQL:"
# Python's str.strip() whitespace as a Java regex class (ASCII part plus common Unicode spaces)
_WS = r"[\s\x0b\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """``str.strip()``: drop leading and trailing whitespace (tabs and newlines too)."""
    return F.regexp_replace(_c(x), f"^{_WS}+|{_WS}+$", "")


def upper_strip(x) -> Column:
    """SF10."""
    return F.upper(strip(x))


def lower_strip(x) -> Column:
    """SF11."""
    return F.lower(strip(x))


def write_guard(sql, strict: bool = False) -> Column:
    """SC1: first blocked word found, else null.

    Default rule: the word starts the upper-cased stripped text, or occurs with a
    blank on each side.  ``strict=True`` (F6 fix) also catches words set off by
    tabs or newlines or ending the text.
    """
    s = upper_strip(sql)
    hits = []
    for kw in BLOCKED_WORDS:
        if strict:
            cond = s.rlike(rf"(^|\s){kw}(\s|;|$)") | s.startswith(kw)
        else:
            cond = s.startswith(kw) | s.contains(f" {kw} ")
        hits.append(F.when(cond, F.lit(kw)))
    return F.coalesce(*hits)


def guard_message(kw) -> Column:
    """The blocked-query error text for a guard hit."""
    return F.when(_c(kw).isNotNull(), F.format_string(
        "BLOCKED: Only SELECT queries are allowed. '%s' is not permitted.", _c(kw)))


def read_only(sql) -> Column:
    """SC2: text starts with SELECT or WITH (case-blind, after strip)."""
    s = upper_strip(sql)
    return s.startswith(READ_PREFIXES[0]) | s.startswith(READ_PREFIXES[1])


def table_ref_count(sql, tables) -> Column:
    """SC3: how many known table names occur (case-blind substring) in the text.

    ``tables`` is an array column (e.g. from the broadcast task catalog) or a list.
    """
    arr = F.array(*[F.lit(t) for t in tables]) if isinstance(tables, (list, tuple)) else _c(tables)
    u = F.upper(_c(sql))
    return F.size(F.filter(arr, lambda t: u.contains(F.upper(t)))).cast("long")


def table_ref_fraction(sql, tables) -> Column:
    arr = F.array(*[F.lit(t) for t in tables]) if isinstance(tables, (list, tuple)) else _c(tables)
    n = F.size(arr)
    return F.when(n > 0, table_ref_count(sql, arr) / n)


def contains_ci(text, needle: str) -> Column:
    """SF13: case-blind substring test."""
    return F.locate(needle.lower(), F.lower(_c(text))) > 0


def error_progress(success, error_message) -> Column:
    """SC5: valid 0.10, unknown column 0.03, unknown table 0.01, else 0.0.

    Accepts SQLite-style messages and Spark error conditions
    (UNRESOLVED_COLUMN*, TABLE_OR_VIEW_NOT_FOUND).  Null ``success`` (no query
    result at all) gives 0.0.
    """
    msg = F.lower(F.coalesce(_c(error_message), F.lit("")))
    return (F.when(_c(success).isNull(), F.lit(0.0))
            .when(_c(success), F.lit(0.1))
            .when((F.locate("no such column", msg) > 0) | (F.locate("unresolved_column", msg) > 0), F.lit(0.03))
            .when((F.locate("no such table", msg) > 0) | (F.locate("table_or_view_not_found", msg) > 0), F.lit(0.01))
            .otherwise(F.lit(0.0)))


# completion parsing ------------------------------------------------------
def after_first(text, marker: str = SQL_MARKER) -> Column:
    """SF14 / PD5: ``text.split(marker, 1)[-1].strip()`` if the marker occurs, else ``text.strip()``."""
    t = _c(text)
    pos = F.locate(marker, t)
    return strip(F.when(pos > 0, F.substr(t, pos + F.lit(len(marker)))).otherwise(t))


def after_last(text, marker: str = SQL_MARKER) -> Column:
    """SF15: ``text.split(marker)[-1]`` stripped."""
    return strip(F.substring_index(_c(text), marker, -1))


def strip_fence(text) -> Column:
    """PD6: text between the first pair of triple backticks, minus a leading ``json``."""
    t = strip(text)
    inner = F.element_at(F.split(t, "```"), 2)
    body = F.when(t.startswith("```"), F.regexp_replace(inner, "^json", "")).otherwise(t)
    return strip(body)


def parse_action(text, schema: str = "action_type string, query string, table_name string") -> Column:
    """PD7: JSON action from a completion.

    Fence-stripped text parsed as JSON; failing that, the outermost ``{...}``
    span; failing that, ``{"action_type": "inspect_error"}``.  Validity is
    decided by ``try_parse_json`` so malformed text never raises.
    """
    body = strip_fence(text)
    span = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    whole_ok = F.try_parse_json(body).isNotNull() & body.startswith("{")
    span_ok = F.try_parse_json(span).isNotNull() & (F.length(span) > 0)
    chosen = F.when(whole_ok, body).when(span_ok, span)
    parsed = F.from_json(chosen, schema)
    return F.when(chosen.isNull(), F.struct(
        F.lit(DEFAULT_ACTION).alias("action_type"), F.lit(None).cast("string").alias("query"),
        F.lit(None).cast("string").alias("table_name"))).otherwise(parsed)


def has_keywords(text, words: Sequence[str] = ("SELECT", ";"), mode: str = "all") -> Column:
    """RW12/RW13 predicate: all (or any) of the words occur, case-blind."""
    u = F.upper(_c(text))
    conds = [F.locate(w.upper(), u) > 0 for w in words]
    out = conds[0]
    for c in conds[1:]:
        out = (out & c) if mode == "all" else (out | c)
    return out
