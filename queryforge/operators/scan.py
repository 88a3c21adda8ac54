"""Ordered scans (running aggregates, ordinals, lag) that survive hot keys.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one
task; if one session, run or customer holds a third of the table, that task
does a third of the work alone.  ``ordered_scan`` splits each key into
contiguous *chunks* instead:

1. ``_chunk`` is a deterministic bucket of the leading order column (hour of a
   timestamp, day of a date, ``floor(x / width)`` of a number) - so it never
   decreases along the order inside a key, and a hot key spans many chunks;
2. a local window over ``(key, _chunk)`` computes running values inside a
   chunk (the shuffle is hashed on the pair, so a hot key's chunks spread
   over all tasks);
3. a small per-(key, chunk) summary (partial aggregation, one row per pair)
   gets an exclusive prefix over chunks per key;
4. joining the prefix back on ``(key, _chunk)`` - the partitioning the local
   window already has, so only the small side moves - and combining gives the
   exact running value.

The chunk is a pure function of the row, so the two consumers of the input
(local window and summary) agree on it even when a stage is recomputed after
a lost executor; no sampling-based range partitioning is involved.

Supported kinds: ``count`` (ordinal), ``sum``, ``max``, ``min``, ``last``
(last non-null so far) and ``lag`` (previous row's value).  Frames are
"unbounded preceding .. current row" (``lag``: previous row).  A null key is a
key like any other, and rows whose order column is null come first; the order
must be total (add a unique tiebreak column).

``chunked=False`` gives the plain single-window plan, for bounded groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Spec = tuple[str, str, "str | None"]  # (output, kind, input column)


def _order_cols(order: Sequence) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _order_names(order: Sequence) -> list[str]:
    names = []
    for o in order:
        if not isinstance(o, str):
            raise TypeError("ordered_scan takes ascending column names as order")
        names.append(o)
    return names


def _plain(df: DataFrame, keys: list[str], order: list[str], specs: Sequence[Spec]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df
    for name, kind, col in specs:
        c = F.lit(1) if col is None else F.col(col)
        if kind == "count":
            expr = F.count(c).over(wr)
        elif kind == "sum":
            expr = F.sum(c).over(wr)
        elif kind == "max":
            expr = F.max(c).over(wr)
        elif kind == "min":
            expr = F.min(c).over(wr)
        elif kind == "last":
            expr = F.last(c, ignorenulls=True).over(wr)
        elif kind == "lag":
            expr = F.lag(c, 1).over(w)
        else:
            raise ValueError(kind)
        out = out.withColumn(name, expr)
    return out


def default_chunk(df: DataFrame, col: str, width: int = 1 << 16) -> Column:
    """Order-monotone bucket of ``col``: hour of a timestamp, day of a date, a two-character
    prefix of a string, ``floor(x)`` of a fractional number, ``floor(x / width)`` of an integer."""
    dt = df.schema[col].dataType
    name = dt.typeName()
    if name in ("timestamp", "timestamp_ntz"):
        return F.date_trunc("hour", F.col(col))  # same type as the column: no time-zone conversion
    if name == "date":
        return F.unix_date(F.col(col)).cast("long")
    if name == "string":
        return F.substring(F.col(col), 1, 2)
    if name in ("double", "float") or name.startswith("decimal"):
        return F.floor(F.col(col))
    return F.floor(F.col(col).cast("double") / F.lit(float(width)))


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: Sequence[Spec],
                 chunked: bool = True, chunk: Column | None = None) -> DataFrame:
    """Add running columns per ``keys`` in ``order`` (see module docstring).

    ``chunk`` overrides the bucket; it must never decrease along ``order``
    within a key.
    """
    keys, order = list(keys), _order_names(order)
    if not chunked:
        return _plain(df, keys, order, specs)

    # key and chunk as one struct: structs with nulls in the same places are equal, so null keys
    # and chunks group and join like others, on the partitioning that the window has
    d = df.withColumn("_chunk", F.struct(*keys, (chunk if chunk is not None else default_chunk(df, order[0])).alias("_chunk")))

    # Local running values: one shuffle on (key, chunk) and one ordered window pass.
    w = Window.partitionBy("_chunk").orderBy(*order)
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {"_lrn": F.row_number().over(w)}
    aggs = []
    ordkey = F.struct(*order)
    for name, kind, col in specs:
        c = F.lit(1) if col is None else F.col(col)
        if kind == "count":
            cols[f"_l_{name}"] = F.count(c).over(wr)
            aggs.append(F.count(c).alias(f"_t_{name}"))
        elif kind == "sum":
            cols[f"_l_{name}"] = F.sum(c).over(wr)
            aggs.append(F.sum(c).alias(f"_t_{name}"))
        elif kind in ("max", "min"):
            fn = F.max if kind == "max" else F.min
            cols[f"_l_{name}"] = fn(c).over(wr)
            aggs.append(fn(c).alias(f"_t_{name}"))
        elif kind == "last":
            cols[f"_l_{name}"] = F.last(c, ignorenulls=True).over(wr)
            aggs.append(F.max_by(c, F.when(c.isNotNull(), ordkey)).alias(f"_t_{name}"))
        elif kind == "lag":
            cols[f"_l_{name}"] = F.lag(c, 1).over(w)
            aggs.append(F.max_by(c, ordkey).alias(f"_t_{name}"))
        else:
            raise ValueError(kind)
    local = d.withColumns(cols)
    kinds = [(name, kind) for name, kind, _ in specs]

    # Chunk totals: a partial (map-side) aggregate per (key, chunk), so only one
    # small row per chunk and map task is shuffled; then an exclusive prefix over
    # the chunks of each key (at most keys + chunks rows).
    summary = d.groupBy("_chunk").agg(*aggs)
    pw = Window.partitionBy(*[f"_chunk.{k}" for k in keys]).orderBy("_chunk._chunk")
    pwr = pw.rowsBetween(Window.unboundedPreceding, -1)
    pcols = {}
    for name, kind in kinds:
        t = F.col(f"_t_{name}")
        if kind in ("count", "sum"):
            pcols[f"_p_{name}"] = F.sum(t).over(pwr)
        elif kind == "max":
            pcols[f"_p_{name}"] = F.max(t).over(pwr)
        elif kind == "min":
            pcols[f"_p_{name}"] = F.min(t).over(pwr)
        elif kind == "last":
            pcols[f"_p_{name}"] = F.last(t, ignorenulls=True).over(pwr)
        else:  # lag: last row of the nearest earlier chunk holding this key
            pcols[f"_p_{name}"] = F.lag(t, 1).over(pw)
    prefix = summary.withColumns(pcols).select("_chunk", *pcols)

    joined = local.join(prefix, on="_chunk", how="left")
    out = {}
    for name, kind in kinds:
        lc, pc = F.col(f"_l_{name}"), F.col(f"_p_{name}")
        if kind == "count":
            out[name] = lc + F.coalesce(pc, F.lit(0))
        elif kind == "sum":
            out[name] = F.when(lc.isNull(), pc).when(pc.isNull(), lc).otherwise(lc + pc)
        elif kind == "max":
            out[name] = F.greatest(lc, pc)
        elif kind == "min":
            out[name] = F.least(lc, pc)
        elif kind == "last":
            out[name] = F.coalesce(lc, pc)
        else:
            out[name] = F.when(F.col("_lrn") == 1, pc).otherwise(lc)
    joined = joined.withColumns(out)
    drop = ["_chunk", "_lrn"] + [f"_{x}_{n_}" for n_, _ in kinds for x in ("l", "t", "p")]
    return joined.drop(*drop)


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos",
            chunked: bool = True, chunk: Column | None = None) -> DataFrame:
    """1-based position of each row within its key group, in ``order`` (exact, skew-safe)."""
    return ordered_scan(df, keys, order, [(name, "count", None)], chunked=chunked, chunk=chunk)


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, name: str = "rn") -> DataFrame:
    """Rows ranked 1..k per key.

    ``row_number() <= k`` with a literal k is planned with a partial
    WindowGroupLimit before the shuffle, so each map task ships at most k rows
    per key: a hot key costs k rows per partition, not its full size.
    """
    w = Window.partitionBy(*keys).orderBy(*_order_cols(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= F.lit(k))
