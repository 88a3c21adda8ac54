"""Exact deduplication with a heavy-hitter split (native: DataFrame functions only).

Each row is reduced once to a narrow record (doc_id, length, SHA-256 of the
normalised text) in a scratch table.  Misra-Gries (``DataFrame.freqItems``, the
Karp-Schenker-Papadimitriou variant) names every digest that may hold more than
``support`` of the rows, at most ``1 / support`` of them.  These candidates are
recounted exactly; the verified ones and their winners are broadcast and decide
their rows on the map side, without a shuffle.  All other digests hold at most
``support`` of the rows each and take the ordinary route: a partial aggregate and
a join on the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, keep_rows, materialize

#: Characters that do not count when texts are compared (fixed by the contract).
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    """The text (null: empty) without any character of ``[\\x20\\x09-\\x0D]``."""
    out = F.coalesce(text, F.lit(""))
    for b in BLANKS:
        out = F.replace(out, F.lit(b), F.lit(""))
    return out


def _best() -> Column:
    """Most code points, then the smallest doc_id (a null id comes last), then the first row."""
    return F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("has_id"),
                          F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("low_id"),
                          F.bitwise_not("row").alias("low_row"))).alias("best")


def exact_duplicates(docs: DataFrame, support: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, text_sha256, n_chars, group_size, keep_id, kept.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; a null text is empty.
    Of equal texts the row with the most code points stays, then the smallest doc_id (null ids last),
    then, for rows that repeat both, the first row read: exactly one row of a group has ``kept``.
    An empty table gives no rows; further columns of ``docs`` are ignored.
    """
    text = F.col("text")
    base = materialize(doc_rows(docs, id_col, text_col).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("text_hash"),
        F.char_length(F.coalesce(text, F.lit(""))).alias("n_chars"), F.sha2(normalised(text), 256).alias("text_sha256")), "digests")
    summary = [_best(), F.count("*").alias("group_size")]
    # at most 1/support digests leave freqItems, so these broadcasts are bounded whatever the corpus size
    maybe = base.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    heavy = materialize(base.join(F.broadcast(maybe), "text_sha256").groupBy("text_sha256").agg(*summary).where("group_size > 1"),
                        "heavy")
    rest = base.join(F.broadcast(heavy), "text_sha256", "left_anti")
    decided = (base.join(F.broadcast(heavy), "text_sha256")
               .unionByName(rest.join(rest.groupBy("text_sha256").agg(*summary), "text_sha256")))
    low = F.col("best.low_id")
    return decided.select("doc_id", "text_hash", "text_sha256", "n_chars", "group_size",
                          F.when(F.col("best.has_id"), F.bitwise_not(low)).alias("keep_id"),
                          (F.col("row") == F.bitwise_not("best.low_row")).alias("kept"))


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay."""
    return keep_rows(docs, exact_duplicates(docs, **options))
