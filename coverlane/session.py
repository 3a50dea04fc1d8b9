"""Session set-up and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "coverlane",
                  shared: str | None = None) -> SparkSession:
    """A session for tests and the benchmark; a cluster job brings its own.

    ``shared`` becomes ``spark.checkpoint.dir``.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Spark takes that setting at start only; where it was not given, ``coverlane.sharedDir``
    can name the folder later.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("coverlane.sharedDir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, used by one run only."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from there.

    It is worked out once however often it is read, it outlives the executors, and its
    measured size is known to the joins that follow. (``checkpoint()`` would run the last
    stage a second time for its own write.)
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
