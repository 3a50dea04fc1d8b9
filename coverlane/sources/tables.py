"""Table access: parameterised SQL, appends by name, and keyed tables rewritten by partition."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def query(spark: SparkSession, statement: str, args: dict[str, Any] | None = None, **frames: DataFrame) -> DataFrame:
    """SQL with ``:name`` parameters; ``{frame}`` stands for a DataFrame given by name."""
    return spark.sql(statement, args=args or {}, **frames)


def append(rows: DataFrame, path: str, schema: T.StructType) -> None:
    """Append to a table by column name. Columns the rows lack become null; unknown ones are an error."""
    if unknown := [c for c in rows.columns if c not in schema.names]:
        raise ValueError(f"the table has no column {unknown}")
    aligned = rows.sparkSession.createDataFrame([], schema).unionByName(rows, allowMissingColumns=True)
    aligned.select(schema.names).write.mode("append").parquet(path)


def create_if_absent(spark: SparkSession, name: str, schema: T.StructType, path: str | None = None) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{place}")


# Tables partitioned by a hash of their key -----------------------------------------
#
# A keyed table is a Parquet folder partitioned by ``part``, a hash of the key columns.
# A change rewrites only the partitions it touches, by Spark's dynamic partition
# overwrite: the new files are staged and replace their partitions when the job commits,
# so a job that dies half-way changes nothing, and untouched partitions keep their files.
# ``_ledger`` beside the partitions (hidden from readers of the table) lists the
# (stream, batch) pairs that were applied.

PART = "part"
BUCKETS = 64


def bucket(*key: str, buckets: int = BUCKETS) -> Column:
    """The partition of a row: a hash of its key columns, nulls included, modulo ``buckets``."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(buckets)).cast("int")


def create_keyed(rows: DataFrame, path: str, key: tuple[str, ...], buckets: int = BUCKETS) -> None:
    """A new keyed table at ``path`` from ``rows``."""
    rows.withColumn(PART, bucket(*key, buckets=buckets)).write.mode("errorifexists").partitionBy(PART).parquet(path)


def read_keyed(spark: SparkSession, path: str, parts: list[int] | None = None) -> DataFrame:
    """The table, or only the listed partitions (pruned at the scan)."""
    rows = spark.read.parquet(path)
    return rows if parts is None else rows.where(F.col(PART).isin(parts))


def overwrite_parts(rows: DataFrame, path: str) -> None:
    """Replace the partitions that ``rows`` have (by their ``part``); all others stay as they are.

    Rows are dealt by partition first, so that each partition is written as one file.
    """
    rows.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def _ledger(path: str) -> str:
    return f"{path.rstrip('/')}/_ledger"


def applied(spark: SparkSession, path: str, stream: str, batch: int) -> bool:
    """Whether this batch of this stream is in the ledger of the table."""
    if not exists(spark, _ledger(path)):
        return False
    entries = spark.read.parquet(_ledger(path))
    return bool(entries.where((F.col("stream") == stream) & (F.col("batch") == batch)).head(1))


def record(spark: SparkSession, path: str, stream: str, batch: int) -> None:
    spark.createDataFrame([(stream, batch)], "stream string, batch long").coalesce(1).write.mode("append").parquet(_ledger(path))


def exists(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    """Whether a readable table with rows (or a Parquet schema) is at ``path``."""
    try:
        spark.read.format(fmt).load(path).schema
        return True
    except AnalysisException:
        return False
