"""Registration of this subpackage's queries."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

#: Words are runs of anything but blanks and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that go to Python at a time: texts can be long, and a batch is held on both sides.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows where there is one."""

    def keep(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
