"""Helpers shared by the operators: scratch tables, text normalisation, row keys."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queryforge.session import checkpoint_dir

#: Bytes that end a word in the ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` word rule (after lower-casing A-Z).
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                   for b in range(256))
WORD_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """At most ``rows`` rows in an Arrow batch from now on in this session, so whole texts of one batch stay small.

    Spark has this as a session setting only; a smaller value of the session stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values, by their lengths."""
    total = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            total += F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif kind == "array" and f.dataType.elementType.typeName() in ("string", "binary"):
            total += F.coalesce(F.aggregate(c, F.lit(8).cast("bigint"), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 8), F.lit(8).cast("bigint"))
        elif kind == "array":
            total += F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)) * 8 + 8
        else:
            total += 16
    return total


def sized(df: DataFrame, most_rows: int = 500_000, most_bytes: int = 40_000_000) -> DataFrame:
    """``df`` (a materialised table) with a broadcast hint if it has at most ``most_rows`` rows and ``most_bytes`` bytes, by their lengths.

    Beyond these bounds the join is an ordinary shuffle join, so nothing that
    grows with the corpus is ever sent to every executor.
    """
    rows, size = df.agg(F.count("*"), F.sum(_row_bytes(df))).first()
    return F.broadcast(df) if rows <= most_rows and (size or 0) <= most_bytes else df


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; texts without other letters take the fast built-in."""
    return (F.when(F.octet_length(c) == F.char_length(c), F.lower(c))
            .otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase)))


def words(c: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text (null: no words)."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(c, F.lit(""))), WORD_SEPARATORS), "")


def text_words(text: str | None) -> list[bytes]:
    """The same words as UTF-8 bytes, for code that runs inside tasks."""
    return (text or "").encode().translate(WORD_BYTES).split()


def doc_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id bigint, text): other columns, clashing names included, stay outside the operator."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              one_of_repeats: bool = True) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (doc_id, text_hash = xxhash64 of the text, kept) keeps, with all their columns.

    Dropped keys leave by an anti join.  Where rows repeat both doc_id and text,
    one of them stays when any was kept; without ``one_of_repeats`` (filters) all of them.
    """
    names = docs.columns
    keys = materialize(decided.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("any_kept"), F.count("*").alias("n"))
                       .where("not any_kept or n > 1" if one_of_repeats else "not any_kept"), "decided")
    keys = keys.select(F.col("doc_id").alias("__qf_id"), F.col("text_hash").alias("__qf_hash"), "any_kept")
    rows = docs.withColumns({"__qf_id": F.col(id_col).cast("bigint"), "__qf_hash": F.xxhash64(F.col(text_col).cast("string"))})

    def same(other: DataFrame):
        return rows["__qf_id"].eqNullSafe(other["__qf_id"]) & (rows["__qf_hash"] == other["__qf_hash"])

    repeated = keys.where("any_kept")
    out = rows.join(sized(keys), same(keys), "left_anti")
    if one_of_repeats and not repeated.isEmpty():
        out = out.unionByName(rows.join(sized(repeated), same(repeated), "left_semi").dropDuplicates(["__qf_id", "__qf_hash"]))
    return out.select(*[F.col(f"`{n}`") for n in names])
