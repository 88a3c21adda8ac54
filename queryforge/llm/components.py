"""Connected components of an edge table by repeated contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of ``edges`` (a, b); nodes share a label when a path joins them.

    Each round sends every node to the neighbour (or itself) with the least hash and
    renames the edges; a fresh hash per round shrinks any graph, long chains
    too, by a constant factor in expectation.  Every table stays in Spark and is written to the shared
    folder between rounds.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, turn = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("node"))  # noqa: E731, B023
        least = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
        parents = materialize(least.select(F.col("a").alias("node"), F.least(rank("a"), F.col("near"))["node"].alias("parent")), "parents")
        if labels is None:
            labels = parents.withColumnRenamed("parent", "label")
        else:
            labels = labels.join(sized(parents.select(F.col("node").alias("label"), "parent")), "label", "left")
            labels = labels.select("node", F.coalesce("parent", "label").alias("label"))
        labels = materialize(labels, "labels")
        for end in ("a", "b"):
            edges = edges.join(sized(parents.withColumnsRenamed({"node": end, "parent": f"to_{end}"})), end).drop(end)
        edges = materialize(edges.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
                            .distinct(), "edges")
        turn += 1
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
