"""Readers, writers and rules that other queries don't go through."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlane import session
from coverlane.operators import catalog, messages, rules, upsert
from coverlane.plans.registry import query, table
from coverlane.schemas import INVOICE_TEXT_LIMITS, NAME_PARTS, SCRAPE_RESULTS
from coverlane.sources import files, tables
from coverlane.streaming import queue


@query("published", "SELECT event_type AS routing_key, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS tags FROM events GROUP BY 1")
def published(spark, sf_dir):
    """Every event sent under its own routing key and read back from there."""
    path = session.fresh_dir(spark, "published")
    files.publish(table(spark, sf_dir, "events"), F.to_json(F.struct("event_id")), path, F.col("event_type"))
    sent = spark.read.text(path).withColumn("event_id", F.get_json_object("value", "$.event_id").cast("long"))
    return sent.groupBy("routing_key").agg(F.count("*").alias("n"), F.sum("event_id").alias("tags"))


@query("url_list", "SELECT url, count(*) AS n FROM pages GROUP BY 1")
def url_list(spark, sf_dir):
    """Tasks from a text file of addresses with blanks around them and empty lines."""
    path = session.fresh_dir(spark, "urls")
    line = F.when(F.col("page_id") >= 0, F.concat(F.lit("  "), "url", F.lit(" \n"))).alias("value")
    table(spark, sf_dir, "pages").select(line).write.text(path)
    tasks = messages.read_tasks(files.url_tasks(spark, path).select(F.lit(0).cast("long").alias("delivery_tag"), "body"))
    return tasks.groupBy("url").agg(F.count("*").alias("n"))


@query("appended", """
SELECT url, 'page' AS title, CAST(NULL AS DOUBLE) AS processing_time FROM pages UNION ALL SELECT url, NULL, length(html) / 2 FROM pages""")
def appended(spark, sf_dir):
    """Two appends with different columns to a table that is created once."""
    path, name = session.fresh_dir(spark, "appended"), f"appended_{session.fresh_dir(spark, 'x')[-12:]}"
    pages = table(spark, sf_dir, "pages")
    for _ in range(2):
        tables.create_if_absent(spark, name, SCRAPE_RESULTS, path)
    tables.append(pages.select(F.lit("page").alias("title"), "url"), path, SCRAPE_RESULTS)
    tables.append(pages.select("url", (F.length("html") / 2).alias("processing_time")), path, SCRAPE_RESULTS)
    out = spark.read.schema(SCRAPE_RESULTS).parquet(path).select("url", "title", "processing_time")
    spark.sql(f"DROP TABLE {name}")  # external: its files stay
    return out


@query("json_files", """
SELECT c_mktsegment AS segment, c_nationkey % 5 AS part, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1, 2""")
def json_files(spark, sf_dir):
    """Customers as JSON documents with a declared schema, one array of them in each file."""
    path = session.fresh_dir(spark, "documents")
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 5).alias("part"), "c_custkey")
    text = F.concat(F.lit('{\n "segment": "'), "segment", F.lit('",\n "part": '), F.col("part").cast("string"),
                    F.lit(',\n "keys": ['), F.array_join(F.collect_list(F.col("c_custkey").cast("string")), ",\n"), F.lit("]\n}"))
    rows.groupBy("segment", "part").agg(text.alias("value")).repartition("segment", "part").select(
        F.concat_ws("-", "segment", "part").alias("folder"), "value").write.partitionBy("folder").text(path)
    read = files.json_documents(spark, path, "segment string, part int, keys array<long>")
    return read.select("segment", "part", F.size("keys").cast("long").alias("n"), F.aggregate("keys", F.lit(0).cast("long"), lambda a, x: a + x).alias("keys"))


@query("sorted_fields", """
SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_quantity END, l_linenumber) AS lines
FROM lineitem GROUP BY 1""")
def sorted_fields(spark, sf_dir):
    """Lists of settings in their stable order, where a missing place counts as 0."""
    item = F.struct(F.col("l_linenumber").alias("name"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("int")).alias("ord"))
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return listed.select("l_orderkey", F.array_join(F.transform(catalog.sort_by_ord(F.col("items")), lambda x: x["name"].cast("string")), ",").alias("lines"))


@query("created_today", "SELECT o_orderkey AS invoice_id, 1 AS status, true AS is_new FROM orders")
def created_today(spark, sf_dir):
    """New invoice rows carry the current time."""
    blank = {c: F.lit("") for c in (*NAME_PARTS, "doc_id", "policy_no", "dependent_no")}
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("delivery_tag"), F.lit(0).alias("pos"),
                                                 F.col("o_orderkey").alias("invoice_id"), F.lit(1).cast("long").alias("insurer_id")).withColumns(blank)
    made = upsert.insert_rows(rows, F.current_timestamp())
    fresh = F.abs(F.datediff(F.to_date("created_at"), F.current_date())) <= 1
    return made.select("invoice_id", F.col("status").cast("int").alias("status"), fresh.alias("is_new"))


@query("stream_enriched", """
SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 OR o_orderkey % 2 = 1 THEN concat('NATION_', o_custkey % 25) END AS name FROM orders""")
def stream_enriched(spark, sf_dir):
    """Orders streamed in two runs; half of the catalog appears between them, and the second run sees it."""
    base = session.fresh_dir(spark, "enriched")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("timestamp").alias("created_at"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("NATION_"), F.col("o_custkey") % 25, F.when(F.col("o_custkey") % 2 == 0, "").otherwise("_LATE")).alias("insurer_name"))
    late = nations.withColumn("name", F.concat("name", F.lit("_LATE")))
    read = lambda s: s.read.schema(nations.schema).option("recursiveFileLookup", "true").parquet(f"{base}/catalog")
    write = lambda batch, n: batch.select("o_orderkey", F.regexp_replace("catalog.name", "_LATE$", "").alias("name")).write.mode("overwrite").parquet(f"{base}/out-{n}")
    for run, known in enumerate((nations, late)):
        known.write.parquet(f"{base}/catalog/{run}")
        orders.where(F.col("o_orderkey") % 2 == run).write.json(f"{base}/in-{run}")
        each = queue.enrich_batches(read, lambda batch, n, run=run: write(batch, run))
        stream = spark.readStream.schema("o_orderkey long, insurer_name string").json(f"{base}/in-{run}")
        queue.run_available(stream, each, f"{base}/state-{run}").awaitTermination()
    found = spark.read.schema("o_orderkey long, name string").parquet(f"{base}/out-0", f"{base}/out-1")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(found, "o_orderkey", "left")


@query("rules_worker", f"""
SELECT c_custkey, concat_ws(';', {", ".join(f"CASE WHEN c_custkey % {i + 2} = 0 THEN '{n} is not set' END" for i, n in enumerate(rules.REQUIRED_TEXT))},
  {", ".join(f"CASE WHEN c_nationkey % {i + 3} = 0 THEN '{n} is not set' END" for i, n in enumerate(rules.REQUIRED_NUMBERS))}) AS errors FROM customer""")
def rules_worker(spark, sf_dir):
    """The settings a worker needs, with texts and numbers missing here and there."""
    settings = table(spark, sf_dir, "customer").select(
        "c_custkey", *[F.when(F.col("c_custkey") % (i + 2) != 0, F.col("c_name")).otherwise("").alias(n) for i, n in enumerate(rules.REQUIRED_TEXT)],
        *[F.when(F.col("c_nationkey") % (i + 3) != 0, F.lit(0)).alias(n) for i, n in enumerate(rules.REQUIRED_NUMBERS)])
    found = rules.missing_settings(rules.REQUIRED_TEXT, rules.REQUIRED_NUMBERS)
    return settings.select("c_custkey", F.array_join(found, ";").alias("errors"))


@query("rules_invoice", f"""
SELECT c_custkey, concat_ws(';', {", ".join(f"CASE WHEN c_custkey % {i + 2} = 0 THEN '{n} is longer than {size}' END" for i, (n, size) in enumerate(INVOICE_TEXT_LIMITS.items()))},
  CASE WHEN c_custkey % 3 = 1 THEN 'invoice_id is not a number' END) AS errors FROM customer""")
def rules_invoice(spark, sf_dir):
    """The limits of the invoice table and its ids, on rows that break some of them."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", *[F.repeat(F.lit("x"), F.when(F.col("c_custkey") % (i + 2) == 0, size + 1).otherwise(size)).alias(n)
                       for i, (n, size) in enumerate(INVOICE_TEXT_LIMITS.items())],
        F.when(F.col("c_custkey") % 3 == 0, "17").when(F.col("c_custkey") % 3 == 1, "1x").alias("invoice_id"))
    found = F.concat(rules.limit_errors(rows), rules.id_errors(["invoice_id"]))
    return rows.select("c_custkey", F.array_join(found, ";").alias("errors"))
