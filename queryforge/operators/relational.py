"""Relational building blocks (JN2-JN8, AG1-AG13 shapes, SL1-SL3, ST1-ST2).

Broadcast policy: only the fixed task catalog is broadcast by hint.  Every
data-derived side is left to the planner, where ``autoBroadcastJoinThreshold``
(static statistics) and AQE (runtime sizes) broadcast it only when its
measured size is under the threshold and fall back to a shuffle join
otherwise - a checked size, never an assumption.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def left_join_filtered(left: DataFrame, right: DataFrame, on: Sequence[str] | Column,
                       right_pred: Column | None = None) -> DataFrame:
    """JN3: left outer join with the right-side condition kept in ON.

    The predicate is applied to the right input *before* the join (so it also
    reaches the right scan as a pushed filter); putting it in WHERE after the
    join would let Catalyst turn the outer join into an inner one and drop
    empty groups.
    """
    r = right if right_pred is None else right.where(right_pred)
    return left.join(r, on=on, how="left")


def preaggregate_then_join(parent: DataFrame, key: str, children: Sequence[tuple[DataFrame, str, Mapping[str, Column]]],
                           parent_key: str | None = None) -> DataFrame:
    """JN4: fan-trap-safe totals.

    ``children`` = [(df, child_key, {out_name: agg_expr}), ...].  Each child is
    aggregated by its key first (partial aggregation map-side, one shuffle of
    the *aggregated* rows), then left-joined to the parent, so row counts never
    multiply.  A hot key costs one partial row per map task.
    """
    pk = parent_key or key
    out = parent
    for df, ck, aggs in children:
        agg = df.groupBy(F.col(ck).alias(f"__k_{ck}")).agg(*[e.alias(n) for n, e in aggs.items()])
        out = out.join(agg, out[pk] == agg[f"__k_{ck}"], "left").drop(f"__k_{ck}")
    return out


def naive_fan_totals(parent: DataFrame, key: str, child_a: tuple[DataFrame, str, str, str],
                     child_b: tuple[DataFrame, str, str, str], parent_key: str | None = None) -> DataFrame:
    """JN5: the totals a naive ``parent LEFT JOIN a LEFT JOIN b GROUP BY`` would report.

    ``child_x`` = (df, child_key, value_column, out_name).  The naive join emits
    |a_k| x |b_k| rows per key; its sums are ``sum_a * max(|b_k|, 1)`` and
    ``sum_b * max(|a_k|, 1)``.  They are computed from per-key pre-aggregates,
    so the multiplied result is exact without ever materialising the pairs.
    Money columns are summed as decimals.
    """
    pk = parent_key or key

    def pre(spec, tag):
        df, ck, vc, _ = spec
        return df.groupBy(F.col(ck).alias(f"__k{tag}")).agg(
            F.sum(F.col(vc).cast("decimal(18,2)")).alias(f"__s{tag}"),
            F.count(F.lit(1)).alias(f"__n{tag}"))

    a, b = pre(child_a, "a"), pre(child_b, "b")
    j = parent.join(a, parent[pk] == a["__ka"], "left").join(b, parent[pk] == b["__kb"], "left")
    na = F.greatest(F.coalesce(F.col("__na"), F.lit(0)), F.lit(1))
    nb = F.greatest(F.coalesce(F.col("__nb"), F.lit(0)), F.lit(1))
    return (j.withColumn(child_a[3], F.col("__sa") * nb)
             .withColumn(child_b[3], F.col("__sb") * na)
             .drop("__ka", "__kb", "__sa", "__sb", "__na", "__nb"))


def exists_in(left: DataFrame, right: DataFrame, on, right_pred: Column | None = None) -> DataFrame:
    """JN2: rows of ``left`` having any match in ``right`` - a left-semi join.

    Unlike join + DISTINCT it never multiplies rows and needs no second shuffle.
    """
    r = right if right_pred is None else right.where(right_pred)
    return left.join(r, on=on, how="left_semi")


def semi_on_aggregate(left: DataFrame, left_key: str, right: DataFrame, right_key: str,
                      having: Column) -> DataFrame:
    """JN6: ``key IN (SELECT k FROM r GROUP BY k HAVING ..)`` as an aggregate + left-semi join."""
    agg = right.groupBy(F.col(right_key).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).where(having)
    return left.join(agg, left[left_key] == agg["__k"], "left_semi")


def first_per_key(df: DataFrame, key: str, value: str, name: str, pred: Column | None = None) -> DataFrame:
    """JN7 (correlated repair): per-key minimum as an aggregate, ready to join."""
    src = df if pred is None else df.where(pred)
    return src.groupBy(key).agg(F.min(value).alias(name))


def global_first(df: DataFrame, value: str, pred: Column | None = None) -> Column:
    """JN7 (uncorrelated form): one scalar subquery, evaluated once and inlined."""
    src = df if pred is None else df.where(pred)
    return src.select(F.min(value)).scalar()


def full_align(left: DataFrame, right: DataFrame, key: str, left_vals, right_vals,
               fill: float | None = 0.0) -> DataFrame:
    """JN8 / ST1: full outer alignment of keyed measures (the key set is the union of
    both sides); a missing side's measures become ``fill`` (None keeps nulls)."""
    lv = [left_vals] if isinstance(left_vals, str) else list(left_vals)
    rv = [right_vals] if isinstance(right_vals, str) else list(right_vals)
    j = left.select(key, *lv).join(right.select(key, *rv), on=key, how="full_outer")
    if fill is None:
        return j
    return j.select(key, *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in lv + rv])


def top_k(df: DataFrame, k: int, by: Sequence[Column]) -> DataFrame:
    """SL1/SL3: ``ORDER BY .. LIMIT k``.

    Planned as TakeOrderedAndProject: each partition keeps only its own top k,
    so the final merge sees k x partitions rows, independent of table size.
    Give a unique tiebreak in ``by`` for a repeatable answer.
    """
    return df.orderBy(*by).limit(k)


def key_union(*dfs: DataFrame, key: str) -> DataFrame:
    """ST1: distinct union of key columns."""
    out = dfs[0].select(key)
    for d in dfs[1:]:
        out = out.union(d.select(key))
    return out.distinct()


def append(*dfs: DataFrame) -> DataFrame:
    """ST2: append by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
