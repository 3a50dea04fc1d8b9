"""Readers and writers for message, task and page files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlane.operators import messages

LINE_SCHEMA = "delivery_tag long, attempt int, body string"


def spread(rows: DataFrame) -> DataFrame:
    """Even out a scan before costly per-row work.

    Splits say nothing about rows: a Parquet row group is read whole by one of them, however
    many splits its file has, so a small file of many rows is one task's work. Rows are dealt
    out evenly: one task a core where there are few splits, thus little data, else four or
    more. Columns that are not read later don't take part.
    """
    cores, splits = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    return rows.repartition(cores if splits * 4 <= cores else max(4 * cores, splits))


def message_files(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, read whole as bytes: ``path``, ``modified`` and ``body``.

    Files carry no delivery tag; ``with_tags`` adds one.
    """
    return spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), F.col("content").alias("body"))


def with_tags(files: DataFrame) -> DataFrame:
    """A repeatable delivery tag: files go by modification time, then path."""
    return files.withColumn("delivery_tag", F.struct("modified", "path"))


def message_lines(spark: SparkSession, path: str) -> DataFrame:
    """Queue export: one JSON line per message with its tag, attempt and body."""
    return spark.read.schema(LINE_SCHEMA).json(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pretty-printed JSON, one document per file, with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def url_tasks(spark: SparkSession, path: str, **options: Column) -> DataFrame:
    """Scrape tasks from a text file with one address per line."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")
    return messages.make_tasks(lines, **options)


def captured_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def publish(rows: DataFrame, body: Column, path: str, routing_key: str | Column, mode: str = "append") -> None:
    """Write messages as lines of JSON text, one folder per routing key."""
    key = F.lit(routing_key) if isinstance(routing_key, str) else routing_key
    rows.select(body.alias("value"), key.alias("routing_key")).write.mode(mode).partitionBy("routing_key").text(path)


def registry(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """The processors that exist, as a table; the list is the one in the code."""
    schema = "code string, name string, country string, active boolean"
    return spark.createDataFrame([tuple(e.get(c) for c in ("code", "name", "country", "active")) for e in entries], schema)
