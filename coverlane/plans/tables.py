"""Parameterised scans and the message stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlane import session
from coverlane.operators import messages, upsert
from coverlane.plans.messages import BODY
from coverlane.plans.registry import query, table
from coverlane.schemas import NAME_PARTS
from coverlane.sources import tables
from coverlane.streaming import queue


@query("param_scan", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_discount IS NOT NULL AND l_discount <> 0 AND l_tax = 0.02 ORDER BY l_orderkey, l_linenumber""")
def param_scan(spark, sf_dir):
    return tables.query(spark, """
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM {lines}
        WHERE l_returnflag = :flag AND l_linestatus = :status AND l_discount IS NOT NULL AND l_discount <> 0 AND l_tax = :tax
        ORDER BY l_orderkey, l_linenumber""", {"flag": "R", "status": "O", "tax": 0.02}, lines=table(spark, sf_dir, "lineitem"))


@query("stream_dispositions", f"""
WITH b AS (SELECT event_id, {BODY} AS body FROM events),
k AS (SELECT event_id, CASE WHEN json_valid(body) THEN json_type(body) END AS kind FROM b)
SELECT CASE WHEN kind IS NULL OR kind IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN 'ack' ELSE 'dead_letter' END AS disposition,
  count(*) AS n, CAST(sum(event_id) AS BIGINT) AS tags FROM k GROUP BY 1""")
def stream_dispositions(spark, sf_dir):
    """All events as message files, streamed to one folder per batch and disposition."""
    base = session.fresh_dir(spark, "dispositions")
    inbox = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("delivery_tag"), F.lit(0).alias("attempt"), F.expr(BODY).alias("body"))
    inbox.write.json(f"{base}/in")
    stream = queue.message_stream(spark, f"{base}/in")
    queue.run_available(stream, queue.write_dispositions(f"{base}/out", queue.insurer_policy), f"{base}/state").awaitTermination()
    out = spark.read.schema("delivery_tag long, disposition string, batch int").json(f"{base}/out")
    return out.groupBy("disposition").agg(F.count("*").alias("n"), F.sum("delivery_tag").alias("tags"))


@query("stream_retries", """
SELECT CASE WHEN event_type = 'error' THEN 'drop' WHEN event_type IN ('view', 'click') THEN 'dead_letter' ELSE 'ack' END AS disposition, count(*) AS n,
  max(CASE WHEN event_type IN ('view', 'click') THEN 2 ELSE 0 END) AS last_attempt FROM events GROUP BY 1""")
def stream_retries(spark, sf_dir):
    """Scrape tasks in a stream that puts retried ones back into its own input until their third try.

    Views have no url; clicks are JSON but no object; errors are no JSON.
    """
    base = session.fresh_dir(spark, "retries")
    url = F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit("https://e/"), F.col("event_id")))
    events = table(spark, sf_dir, "events").select("event_id", "event_type", url.alias("url"))
    made = messages.make_tasks(events, created=F.lit(0.0))
    odd = F.element_at(F.array(F.lit("7"), F.lit("[1]"), F.lit("null")), (F.col("event_id") % 3 + 1).cast("int"))
    body = F.when(F.col("event_type") == "click", odd).when(F.col("event_type") == "error", "{'no json").otherwise(F.col("body"))
    made.select(F.col("event_id").alias("delivery_tag"), F.lit(0).alias("attempt"), body.alias("body")).write.json(f"{base}/in/first")
    worker = queue.scrape_worker(f"{base}/in", f"{base}/out", max_attempts=3)
    for _ in range(3):  # each run takes what is there when it starts
        queue.run_available(queue.message_stream(spark, f"{base}/in"), worker, f"{base}/state").awaitTermination()
    out = spark.read.schema("delivery_tag long, attempt int, disposition string, batch int").json(f"{base}/out")
    final = out.filter(F.col("disposition") != messages.RETRY)
    return final.groupBy("disposition").agg(F.count("*").alias("n"), F.max("attempt").alias("last_attempt"))


@query("stream_upsert", """
WITH t AS (SELECT concat('T', c_custkey) AS id, c_custkey AS invoice_id, CASE WHEN c_nationkey < 5 THEN 0 ELSE 1 END AS status FROM customer),
m AS (SELECT o_custkey * 2 + 2 AS invoice_id, max_by(CAST(o_orderkey AS VARCHAR), o_orderkey) AS policy_no FROM orders GROUP BY 1)
SELECT t.invoice_id, coalesce(m.policy_no, 'old') AS policy_no, t.status FROM t LEFT JOIN m ON m.invoice_id = t.invoice_id AND t.status = 1
UNION ALL SELECT invoice_id, policy_no, 1 FROM m WHERE invoice_id NOT IN (SELECT invoice_id FROM t WHERE status = 1)""")
def stream_upsert(spark, sf_dir):
    """Orders streamed in three files into a keyed invoice table, the last by a second stream, one batch repeated.

    Each batch rewrites only the hash partitions of the keys it holds."""
    base = session.fresh_dir(spark, "upsert")
    blank = {c: F.lit("") for c in NAME_PARTS}
    start = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("T"), "c_custkey").alias("id"), F.col("c_custkey").alias("invoice_id"), F.lit(1).cast("long").alias("insurer_id"),
        F.lit("d").alias("doc_id"), F.lit("old").alias("policy_no"), F.lit("0").alias("dependent_no"),
        F.when(F.col("c_nationkey") < 5, 0).otherwise(1).cast("byte").alias("status"))
    tables.create_keyed(start.withColumns(blank).withColumn("created_at", F.lit(None).cast("timestamp")), f"{base}/table", upsert.KEY)
    source = "delivery_tag long, pos int, invoice_id long, insurer_id long, doc_id string, policy_no string, dependent_no string"
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("delivery_tag"), F.lit(0).alias("pos"), (F.col("o_custkey") * 2 + 2).alias("invoice_id"), F.lit(1).cast("long").alias("insurer_id"),
        F.lit("D").alias("doc_id"), F.col("o_orderkey").cast("string").alias("policy_no"), F.lit("0").alias("dependent_no"))
    cut = orders.agg(F.percentile_approx("delivery_tag", [0.3, 0.6])).first()[0] or [0, 0]
    parts = [F.col("delivery_tag") <= cut[0], (F.col("delivery_tag") > cut[0]) & (F.col("delivery_tag") <= cut[1]), F.col("delivery_tag") > cut[1]]
    for k, (part, stream) in enumerate(zip(parts, ("a", "a", "b"))):
        orders.filter(part).write.json(f"{base}/in-{stream}/{k}")
        read = spark.readStream.schema(source).option("recursiveFileLookup", "true").json(f"{base}/in-{stream}")
        each = queue.upsert_batches(f"{base}/table", lambda batch: batch.withColumns(blank), stream)
        queue.run_available(read, each, f"{base}/state-{stream}").awaitTermination()
    each(orders.filter(parts[0]), 0)  # batch 0 of the second stream again: nothing happens
    return tables.read_keyed(spark, f"{base}/table").select("invoice_id", "policy_no", F.col("status").cast("int").alias("status"))
