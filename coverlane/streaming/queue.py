"""Message streams: file source, dispositions, retries and per-batch callbacks.

Delivery is at least once: the checkpoint repeats a batch after a crash, and every
sink folder is named by batch and overwritten, so a repeat leaves the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coverlane.operators import catalog as lookups
from coverlane.operators import messages, upsert
from coverlane.session import settle
from coverlane.sources import tables
from coverlane.sources.files import LINE_SCHEMA


def message_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New message files under a folder; the limit per trigger is the back-pressure."""
    return (spark.readStream.schema(LINE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
            .option("recursiveFileLookup", "true").json(path))


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Handle everything that is there now, batch by batch, then stop."""
    return (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _batch_dir(out: str, stream: str, batch_id: int) -> str:
    return f"{out.rstrip('/')}/stream={stream}/batch={batch_id}"


def write_dispositions(out: str, decide: Callable[[DataFrame], DataFrame], stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """Batch callback: rows with their ``disposition``, one folder per stream, batch and disposition.

    ``stream`` names the checkpoint, as for ``upsert_batches``: a new checkpoint under a new
    name never writes over the folders of another.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        decide(batch).write.mode("overwrite").partitionBy("disposition").json(_batch_dir(out, stream, batch_id))

    return each


def insurer_policy(batch: DataFrame) -> DataFrame:
    """Insurer worker: every readable container is done with, the rest is dead."""
    return messages.parse(batch).select("delivery_tag", "attempt", "body", "route", "disposition")


def scrape_policy(max_attempts: int) -> Callable[[DataFrame], DataFrame]:
    """Scrape worker: bad JSON is dropped, a task without url is retried up to a cap.

    The attempt count of a retried row goes up by one, ready to be read again.
    """

    def decide(batch: DataFrame) -> DataFrame:
        tasks = messages.read_tasks(batch, F.coalesce("attempt", F.lit(0)), max_attempts)
        again = F.col("disposition") == messages.RETRY
        return tasks.select(
            "delivery_tag", F.when(again, F.coalesce("attempt", F.lit(0)) + 1).otherwise(F.col("attempt")).alias("attempt"),
            "body", "url", "disposition")

    return decide


def retry_sink(decided: DataFrame, inbox: str, batch_id: int, stream: str = "stream") -> None:
    """Put retried tasks back into the input folder, ready for a later trigger.

    Named by stream and batch and overwritten, so a repeated batch puts them back once, and
    a stream under another name (a new checkpoint) never writes over waiting tasks it reads.
    """
    again = decided.filter(F.col("disposition") == messages.RETRY).select("delivery_tag", "attempt", "body")
    again.write.mode("overwrite").json(f"{inbox.rstrip('/')}/retry-{stream}-{batch_id}")


def scrape_worker(inbox: str, out: str, max_attempts: int, stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """Batch callback: dispositions to ``out``, retried tasks back to ``inbox``.

    The batch is decided once (written to the shared folder) and both outputs are written
    from that. Retries are written first, dispositions last: a batch whose dispositions are
    complete was handled and is skipped when the checkpoint repeats it.
    """
    decide = scrape_policy(max_attempts)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _batch_dir(out, stream, batch_id)
        if tables.exists(spark, done, "json"):
            return
        decided = settle(decide(batch), "scrape-decided")
        retry_sink(decided, inbox, batch_id, stream)
        decided.write.mode("overwrite").partitionBy("disposition").json(done)

    return each


def enrich_batches(catalog: Callable[[SparkSession], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Batch callback: clients with their catalog entry. The catalog is opened for each batch, so a new row is seen."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write(lookups.enrich(batch, catalog(batch.sparkSession)), batch_id)

    return each


def upsert_batches(target_path: str, to_source: Callable[[DataFrame], DataFrame], stream: str = "stream",
                   buckets: int = tables.BUCKETS) -> Callable[[DataFrame, int], None]:
    """Batch callback: apply each batch to the keyed target, rewriting only the partitions it touches.

    ``stream`` names the checkpoint: batch numbers start again with a new one, which then
    needs a new name. A batch in the target's ledger is not applied again. A batch whose
    data was written but whose ledger entry was not (a crash between the two) is applied
    once more, which changes nothing: keyed messages set the same values again, and rows of
    messages without key are not inserted again where their id (made from the message) is
    there already. One writer at a time.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if tables.applied(spark, target_path, stream, batch_id):
            return
        source = to_source(batch).withColumn("_part", tables.bucket(*upsert.KEY, buckets=buckets))
        touched = [r[0] for r in source.select("_part").distinct().collect()]  # at most ``buckets`` rows
        if touched:
            target = tables.read_keyed(spark, target_path, touched)
            columns = [c for c in target.columns if c != tables.PART]
            source = upsert.without_known(source.drop("_part"), target)
            merged = upsert.upsert(source, target.select(*columns))
            # Dynamic overwrite stages the new files and swaps partitions at commit, so the
            # partitions read here stay whole until then, also for tasks run again.
            tables.overwrite_parts(merged.withColumn(tables.PART, tables.bucket(*upsert.KEY, buckets=buckets)), target_path)
        tables.record(spark, target_path, stream, batch_id)

    return each
