"""Table sources: loading, schema profiles, ordered samples (SRC1-SRC3, SRC10)."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from queryforge.session import checkpoint_dir

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(_sql_literal(x) for x in v) + ")"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small table built from driver-side literals (bounded metadata: names, schemas, outcomes).

    Rendered as an inline ``VALUES`` table, which the analyzer turns into a
    local relation: no Python worker or RDD is involved when a query reads it,
    and its size is known to the planner.
    """
    cast = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    names = ", ".join(f"`{f.name}`" for f in schema.fields)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})").select(*cast)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; the scan stays lazy so Catalyst can prune and push down.
    """
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_tables(spark: SparkSession, sf_dir: str, names: Iterable[str] | None = None,
                register: bool = True) -> dict[str, DataFrame]:
    """SRC1: load the named tables (default: all present) and register temp views."""
    out = {}
    for n in DRIVER_TABLES if names is None else names:
        try:
            df = read_table(spark, sf_dir, n)
        except AnalysisException as e:  # any store that Spark reads, not the driver's own disk
            if names is not None or e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if register:
            df.createOrReplaceTempView(n)
        out[n] = df
    return out


def _type_name(dt: T.DataType) -> str:
    return dt.simpleString().upper()


def schema_profile(spark: SparkSession, tables: Mapping[str, DataFrame],
                   primary_keys: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """SRC2: one row per column of every table, ordered by table name then ordinal.

    Columns: table, ordinal, column, type, nullable ('YES'/'NO'), primary_key ('YES'/'NO').
    Built from the schemas only (no data is read).
    """
    pks = {k: set(v) for k, v in (primary_keys or {}).items()}
    rows = []
    for tname in sorted(tables):
        for i, f in enumerate(tables[tname].schema.fields):
            rows.append((tname, i, f.name, _type_name(f.dataType),
                         "YES" if f.nullable else "NO",
                         "YES" if f.name in pks.get(tname, ()) else "NO"))
    schema = T.StructType([
        T.StructField("table", T.StringType(), False),
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("column", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("nullable", T.StringType(), False),
        T.StructField("primary_key", T.StringType(), False),
    ])
    return local_frame(spark, rows, schema)


def sample_rows(df: DataFrame | None, n: int = 3, order_by: list[str | Column] | None = None) -> DataFrame | None:
    """SRC3: first ``n`` rows of a table in a repeatable order.

    ``orderBy(..).limit(n)`` plans as TakeOrderedAndProject: every partition
    keeps its own top ``n`` and only those reach the final task, so the cost
    is one scan regardless of table size.  A missing table (``None``) gives None,
    the caller's "empty" answer.
    """
    if df is None:
        return None
    keys = order_by or [df.columns[0]]
    return df.orderBy(*keys).limit(n)


def read_log_history(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: trainer log rows with ragged keys; schema merged by inference."""
    return spark.read.option("primitivesAsString", "false").json(path)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once below the shared checkpoint folder and read back: cuts the lineage, survives lost executors."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_log_variant(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: trainer log rows as one variant column ``v`` and their order ``log_idx`` (file, place in it); one read, no schema inference.

    Keys that only some rows or later files have are there as well, and a value keeps the type of its row.
    """
    log = spark.read.format("json").option("singleVariantColumn", "v").load(path)
    return log.select("v", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                    F.monotonically_increasing_id().alias("row")).alias("log_idx"))
