"""Exact values at given ranks without ordering all rows (AG14).

``select_ranks`` refines histograms.  Every wanted rank has a range of values that
holds it.  A pass reads the rows, counts those of each range in equal bins (partial
aggregation: a task ships at most ``bins`` rows for each rank, however many rows its
group has), and keeps the one bin in which the rank falls, with its own least and
greatest value.  A range of one value is an answer, so a value with a third of all
rows ends a search at once.  As soon as the open ranges hold few rows in all, only
those rows are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queryforge.sources.tables import stored


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Which of the equal bins of [lo, hi] holds v; halves, so that the width of the widest range is finite."""
    width = hi / 2 - lo / 2
    return F.when(width == 0, F.when(v > lo, F.lit(bins - 1)).otherwise(F.lit(0))).otherwise(
        F.least(F.lit(bins - 1), F.floor((v / 2 - lo / 2) / width * F.lit(float(bins))).cast("int")))


def select_ranks(samples: DataFrame, group: str, value: str, wanted: DataFrame, bins: int = 1024, few: int = 100_000) -> DataFrame:
    """(group, which, v): the value at each wanted rank of its group, exact.

    ``wanted``: (group, which, target, lo, hi) with the 1-based rank ``target`` and the least and greatest value of
    the group, both finite; rows of ``samples`` with a null or non-finite value count for no rank.  A null group is a
    group like any other.  Each pass but the last makes every open range at least ``bins`` times as narrow.
    """
    key = F.struct(F.col(group).alias("g"))  # structs with nulls in the same places are equal
    rows = samples.select(key.alias("k"), F.col(value).cast("double").alias("v"))
    state = stored(wanted.select(key.alias("k"), "which", "target", F.col("lo").cast("double"), F.col("hi").cast("double"),
                                 F.lit(None).cast("long").alias("n")), "ranks")
    found = []
    while True:
        found.append(state.where("lo = hi").select("k", "which", F.col("lo").alias("v")))
        opened = state.where("lo < hi")
        left = opened.agg(F.count(F.lit(1)).alias("ranges"), F.sum(F.coalesce("n", F.lit(few + 1))).alias("rows")).first()
        if not left["ranges"]:
            break
        near = rows.join(opened.drop("n"), "k").where("v >= lo and v <= hi")
        if left["rows"] <= few:
            order = Window.partitionBy("k", "which").orderBy("v")
            found.append(near.withColumn("r", F.row_number().over(order)).where("r = target").select("k", "which", "v"))
            break
        counts = (near.withColumn("bin", _bin(F.col("v"), F.col("lo"), F.col("hi"), bins)).groupBy("k", "which", "target", "bin")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
        upto = F.sum("n").over(Window.partitionBy("k", "which").orderBy("bin"))  # at most ``bins`` rows
        state = stored(counts.withColumn("upto", upto).where("target <= upto and target > upto - n")
                       .select("k", "which", (F.col("target") - F.col("upto") + F.col("n")).alias("target"), "lo", "hi", "n"), "ranks")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.col("k.g").alias(group), "which", "v")
