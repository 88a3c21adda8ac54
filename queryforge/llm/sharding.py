"""Sharding by sampled splitters (native: DataFrame functions only).

Records are ordered by (CRC-32 of the text, doc_id), so equal texts lie side by
side.  A size-weighted sample of keys gives quantile splitters; they cut the key
space into ranges of about equal bytes.  A range that still holds more than
``range_rows`` rows is subdivided, first by CRC and then, where one CRC fills it
(copies of one text), by doc_id.  Exact row and byte counts of the ranges, summed
in key order, give every range its offset; a window inside each range gives every
row its exact place, from which the law derives the shard.  No window ever spans
more than one range, and only the table of ranges is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_rows, materialize, sized

#: CRC-32 values are looked up in 2**12 cells that hold the splitters falling into them.
_CELL_BITS = 12


def _splitters(keys: DataFrame, total_bytes: int, ranges: int, per_range: int) -> DataFrame:
    """``ranges - 1`` quantile keys of a size-weighted sample of about ``ranges * per_range`` keys.

    A row is drawn when a hash of its key falls below its share of the bytes, so a
    retried task draws the same rows.
    """
    share = F.col("size") * F.lit(float(ranges * per_range) / max(total_bytes, 1))
    drawn = F.pmod(F.xxhash64("text_crc32", "doc_id", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share
    sample = keys.where(drawn).select("text_crc32", "order_id")
    ranked = sample.select("text_crc32", "order_id", F.ntile(ranges).over(Window.orderBy("text_crc32", "order_id")).alias("part"))
    cuts = ranked.groupBy("part").agg(F.min(F.struct("text_crc32", "order_id")).alias("cut")).where("part > 1")
    return cuts.select(F.shiftright(F.col("cut.text_crc32"), 32 - _CELL_BITS).alias("cell"), "cut")


def _ranges(keys: DataFrame, cuts: DataFrame) -> DataFrame:
    """``keys`` with the number of the splitter range that holds each key."""
    cells = cuts.groupBy("cell").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    # one row for each of the 2**12 cells: the splitters below it, and those inside it
    every = keys.sparkSession.range(1 << _CELL_BITS).withColumnRenamed("id", "cell").join(cells, "cell", "left")
    before = F.coalesce(F.sum(F.size("cuts")).over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = every.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<text_crc32:bigint,order_id:bigint>>")))
    every = every.select("cell", "cuts", before.alias("before"))
    key = F.struct("text_crc32", "order_id")
    inside = F.size(F.filter("cuts", lambda c: c <= key))
    cell = F.shiftright("text_crc32", 32 - _CELL_BITS)
    return (keys.join(F.broadcast(every), cell == F.col("cell"))  # 2**12 rows and fewer than ``ranges`` splitters
            .withColumn("range", F.array((F.col("before") + inside).cast("long"))).drop("cell", "cuts", "before"))


def _subdivide(keys: DataFrame, by: str, range_rows: int) -> DataFrame:
    """Cut every range of more than ``range_rows`` rows into equal steps of ``by``, in key order."""
    full = keys.groupBy("range").agg(F.count("*").alias("n"), F.min(by).alias("low"), F.max(by).alias("high"),
                                     F.min("text_crc32").alias("c0"), F.max("text_crc32").alias("c1"))
    if by != "text_crc32":
        full = full.where("c0 = c1")  # only inside one CRC does doc_id follow the key order
    full = full.where((F.col("n") > range_rows) & (F.col("high") > F.col("low")))
    full = full.select("range", "low", (F.col("high") - F.col("low") + F.lit(1.0)).alias("span"),
                       F.ceil(F.col("n") / range_rows).alias("steps"))
    step = F.coalesce(F.floor((F.col(by) - F.col("low")) * F.col("steps") / F.col("span")), F.lit(0)).cast("long")
    return keys.join(full, "range", "left").withColumn("range", F.concat("range", F.array(step))).drop("low", "span", "steps")


def shard(docs: DataFrame, shards: int = 16, law: str = "bytes", ranges: int = 256, per_range: int = 32,
          range_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: not the ``key`` law).

    ``size`` is the UTF-8 length of the text plus 1.  Law ``bytes`` puts a row into the
    shard in which its first byte falls when all rows lie end to end in key order, so a shard's
    size differs from an even share by less than the largest row; law ``rows`` does the same with row numbers, so counts differ
    by one at most.  Equal texts are neighbours: a group is split only where a shard ends inside it.
    ``slot`` counts from 0 without gaps in each shard.  A null text is empty (CRC 0, size 1), a null
    doc_id sorts first, rows that repeat a key take neighbouring slots; an empty table gives no rows.
    Other columns are ignored.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law!r}")
    text = F.coalesce("text", F.lit(""))
    keys = materialize(doc_rows(docs, id_col, text_col).select(
        "doc_id", F.coalesce("doc_id", F.lit(-1 << 63)).alias("order_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash")), "keys")
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cuts = materialize(_splitters(keys, total, ranges, per_range), "splitters")
    keys = _ranges(keys, cuts)
    for by in ("text_crc32", "order_id"):
        keys = _subdivide(keys, by, range_rows)
    keys = materialize(keys, "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = keys.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    starts = materialize(sums.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"),
                                     F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0")), "starts")
    inside = Window.partitionBy("range").orderBy("text_crc32", "order_id", "size", "text_hash")
    placed = keys.withColumns({"row": F.row_number().over(inside) - 1,
                               "byte": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    placed = placed.join(sized(starts), "range").withColumns({"row": F.col("row") + F.col("row0"), "byte": F.col("byte") + F.col("byte0")})
    at, whole = ("byte", total) if law == "bytes" else ("row", rows)
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "row", F.expr(
        f"cast((cast({at} as decimal(38,0)) * {shards}) div {max(whole, 1)} as int)").alias("shard")), "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("row") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
