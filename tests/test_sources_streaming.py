import json
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from coverlane.operators import messages, sessions, upsert
from coverlane.schemas import NAME_PARTS, SCRAPE_RESULTS
from coverlane.session import fresh_dir
from coverlane.sources import files, tables
from coverlane.streaming import queue
from coverlane.streaming.sessions import session_stream


def test_append_by_name(spark, tmp_path):
    path = str(tmp_path / "results")
    tables.append(spark.createDataFrame([("t", "u")], "title string, url string"), path, SCRAPE_RESULTS)
    tables.append(spark.createDataFrame([("v", 2.5)], "url string, processing_time double"), path, SCRAPE_RESULTS)
    back = spark.read.parquet(path)
    assert back.columns == SCRAPE_RESULTS.names
    assert sorted((r["url"], r["title"], r["processing_time"]) for r in back.collect()) == [("u", "t", None), ("v", None, 2.5)]


def test_create_if_absent(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    for _ in range(2):
        tables.create_if_absent(spark, name, SCRAPE_RESULTS, str(tmp_path / name))
    assert spark.table(name).columns == SCRAPE_RESULTS.names
    spark.sql(f"DROP TABLE {name}")


def test_keyed_tables(spark, tmp_path):
    path = str(tmp_path / "keyed")
    tables.create_keyed(spark.range(100).withColumn("k", F.col("id") % 7), path, ("k",), buckets=4)
    assert tables.read_keyed(spark, path).count() == 100 and tables.read_keyed(spark, path, [9]).count() == 0
    one = tables.read_keyed(spark, path).where("part = 1")
    big = one.where("id >= 50").count()
    tables.overwrite_parts(one.where("id < 50"), path)
    assert big > 0 and tables.read_keyed(spark, path).count() == 100 - big
    assert not tables.applied(spark, path, "s", 0)
    tables.record(spark, path, "s", 0)
    assert tables.applied(spark, path, "s", 0) and not tables.applied(spark, path, "s", 1)
    assert "stream" not in tables.read_keyed(spark, path).columns
    assert not tables.exists(spark, str(tmp_path / "none"))


def test_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"Clientes": [{"NombreCompleto": "Ñ"}], "Version": "1"}, indent=2), "utf-8")
    read = files.with_tags(files.message_files(spark, str(tmp_path / "m.json")))
    assert messages.parse(read).first()["route"] == "batch"
    doc = files.json_documents(spark, str(tmp_path / "m.json"), "Version string, Clientes array<struct<NombreCompleto:string>>")
    assert doc.first()["Clientes"][0]["NombreCompleto"] == "Ñ"
    (tmp_path / "urls.txt").write_text("https://a\n\n https://b \n")
    tasks = files.url_tasks(spark, str(tmp_path / "urls.txt")).collect()
    assert [json.loads(t["body"])["url"] for t in tasks] == ["https://a", "https://b"]
    out = str(tmp_path / "queue")
    files.publish(spark.createDataFrame([("ñ",)], "v string"), F.to_json(F.struct("v")), out, "tasks")
    assert [tuple(r) for r in spark.read.text(out).collect()] == [('{"v":"ñ"}', "tasks")]
    listed = files.registry(spark, [{"code": "A", "name": "Insurer A", "active": True}])
    assert listed.first()["country"] is None


def test_parameters_are_bound(spark):
    data = spark.createDataFrame([("a'b", 1), ("c", 2)], "name string, n int")
    assert [r["n"] for r in tables.query(spark, "SELECT n FROM {t} WHERE name = :name", {"name": "a'b"}, t=data).collect()] == [1]


def test_stream_dispositions_equal_batch(spark, rows):
    base = fresh_dir(spark, "test-stream")
    bodies = ['{"NombreCompleto":"A"}', "7", "junk", '{"Clientes":[]}', "[1]"]
    inbox = spark.createDataFrame([(i, 0, bodies[i % 5]) for i in range(50)], "delivery_tag long, attempt int, body string")
    inbox.repartition(7).write.json(f"{base}/in")
    stream = queue.message_stream(spark, f"{base}/in", files_per_trigger=2)
    queue.run_available(stream, queue.write_dispositions(f"{base}/out", queue.insurer_policy), f"{base}/state").awaitTermination()
    got = spark.read.json(f"{base}/out").select("delivery_tag", "disposition")
    assert rows(got) == rows(messages.parse(inbox).select("delivery_tag", "disposition"))
    # A repeated batch leaves the same files.
    queue.write_dispositions(f"{base}/out", queue.insurer_policy)(spark.read.schema("delivery_tag long, attempt int, body string").json(f"{base}/in").limit(0), 99)
    assert rows(spark.read.json(f"{base}/out").select("delivery_tag", "disposition")) == rows(got)


def test_session_stream_equals_batch(spark, rows):
    base = fresh_dir(spark, "test-sessions")
    schema = "name string, t bigint, seq bigint, opens boolean, closes boolean, reset boolean"
    steps = [(n, i * 7_000_000, i, i % 5 != 0, i % 3 != 0, i % 11 == 10) for i in range(40) for n in ("a", "b")]
    for part in range(4):
        spark.createDataFrame(steps[part * 20:part * 20 + 20], schema).coalesce(1).write.json(f"{base}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{base}/in")
    out = session_stream(stream, "name", 30).writeStream.format("parquet").option("path", f"{base}/out")
    out.option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    batch = sessions.phases(spark.createDataFrame(steps, schema), "name", 30).select("name", "t", "seq", "phase")
    assert rows(spark.read.parquet(f"{base}/out").select("name", "t", "seq", "phase")) == rows(batch)


def test_upsert_stream_equals_one_batch(spark, rows):
    base = fresh_dir(spark, "test-upsert")
    blank = {c: F.lit("") for c in NAME_PARTS}
    schema = "id string, invoice_id long, insurer_id long, doc_id string, policy_no string, dependent_no string, status byte"
    target = spark.createDataFrame([("T", 1, 1, "d", "old", "0", 1)], schema).withColumns(blank).withColumn("created_at", F.lit(None).cast("timestamp"))
    tables.create_keyed(target, f"{base}/table", upsert.KEY)
    source = "delivery_tag long, pos int, invoice_id long, insurer_id long, doc_id string, policy_no string, dependent_no string"
    msgs = [(i, 0, i % 3, 1, f"D{i}", f"P{i}", "0") for i in range(12)]
    for part in range(3):
        spark.createDataFrame(msgs[part * 4:part * 4 + 4], source).coalesce(1).write.json(f"{base}/in/{part}")
    stream = spark.readStream.schema(source).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{base}/in")
    each = queue.upsert_batches(f"{base}/table", lambda batch: batch.withColumns(blank))
    queue.run_available(stream, each, f"{base}/state").awaitTermination()
    once = upsert.upsert(spark.createDataFrame(msgs, source).withColumns(blank), target)
    names = ["invoice_id", "insurer_id", "doc_id", "policy_no", "dependent_no", "status"]
    assert rows(tables.read_keyed(spark, f"{base}/table"), *names) == rows(once, *names)
    assert spark.read.parquet(f"{base}/table/_ledger").count() == 3


def test_batches_rewrite_only_touched_partitions_and_replays_change_nothing(spark, tmp_path, rows):
    import os

    path = str(tmp_path / "table")
    blank = {c: F.lit("") for c in NAME_PARTS}
    schema = "id string, invoice_id long, insurer_id long, doc_id string, policy_no string, dependent_no string, status byte"
    source = "delivery_tag long, pos int, invoice_id long, insurer_id long, doc_id string, policy_no string, dependent_no string"
    start = spark.createDataFrame([(f"T{i}", i, 1, "d", "old", "0", 1) for i in range(200)], schema)
    tables.create_keyed(start.withColumns(blank).withColumn("created_at", F.lit(None).cast("timestamp")), path, upsert.KEY)

    def files():
        return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("part=")}

    before = files()
    msgs = spark.createDataFrame([(1, 0, 7, 1, "D", "P7", "0"), (2, 0, None, 1, "D", "N", "0"), (3, 0, 999, 1, "D", "P999", "0")], source)
    each = queue.upsert_batches(path, lambda b: b.withColumns(blank), "s")
    each(msgs, 0)
    after = files()
    touched = {f"part={r.p}" for r in msgs.select(tables.bucket(*upsert.KEY).alias("p")).distinct().collect()}
    assert len(touched) <= 3 and len(before) >= 40
    assert all(after[d] == before[d] for d in before if d not in touched)
    assert all(after[d] != before.get(d) for d in touched)
    once = rows(tables.read_keyed(spark, path), "id", "invoice_id", "policy_no")
    assert len(once) == 202 and ("T7" in {r[0] for r in once})
    # data written but no ledger entry (a crash between the two): applying again changes nothing
    shutil.rmtree(f"{path}/_ledger")
    each(msgs, 0)
    assert rows(tables.read_keyed(spark, path), "id", "invoice_id", "policy_no") == once


def test_catalog_is_read_for_each_batch(spark, tmp_path):
    base = str(tmp_path)
    schema = "id string, name string, created_at timestamp"
    for k, name in enumerate(("A", "Z")):
        spark.createDataFrame([(name, k)], "insurer_name string, n int").coalesce(1).write.json(f"{base}/in/{k}")
    spark.createDataFrame([("1", "A", None), ("2", "A", None)], schema).write.json(f"{base}/catalog/0")
    seen = []

    def write(batch, batch_id):
        seen.extend((r["insurer_name"], r["catalog"]["id"]) for r in batch.collect())
        spark.createDataFrame([("3", "Z", None), ("4", "A", None)], schema).write.mode("overwrite").json(f"{base}/catalog/1")

    each = queue.enrich_batches(lambda s: s.read.schema(schema).option("recursiveFileLookup", "true").json(f"{base}/catalog"), write)
    for k in range(2):
        stream = spark.readStream.schema("insurer_name string, n int").json(f"{base}/in/{k}")
        queue.run_available(stream, each, f"{base}/state-{k}").awaitTermination()
    assert seen == [("A", "1"), ("Z", "3")]


def test_upsert_after_restart_and_from_a_second_stream(spark, tmp_path):
    path = str(tmp_path / "table")
    blank = {c: F.lit("") for c in NAME_PARTS}
    schema = "id string, invoice_id long, insurer_id long, doc_id string, policy_no string, dependent_no string, status byte"
    source = "delivery_tag long, pos int, invoice_id long, insurer_id long, doc_id string, policy_no string, dependent_no string"
    start = spark.createDataFrame([("T", 1, 1, "d", "old", "0", 1)], schema).withColumns(blank).withColumn("created_at", F.lit(None).cast("timestamp"))
    tables.create_keyed(start, path, upsert.KEY)
    batch = lambda policy: spark.createDataFrame([(1, 0, 1, 1, "D", policy, "0")], source)
    policy = lambda: [r["policy_no"] for r in tables.read_keyed(spark, path).collect()]
    first, second = (queue.upsert_batches(path, lambda b: b.withColumns(blank), name) for name in ("one", "two"))
    first(batch("P0"), 0)
    first(batch("P1"), 1)
    assert policy() == ["P1"]
    second(batch("Q0"), 0)
    assert policy() == ["Q0"]
    first(batch("P1"), 1)
    assert policy() == ["Q0"] and spark.read.parquet(f"{path}/_ledger").count() == 3


def test_append_rejects_unknown_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.append(spark.createDataFrame([("t", "u")], "title string, other string"), str(tmp_path / "t"), SCRAPE_RESULTS)


def test_scrape_policy_drops_only_what_is_no_json(spark):
    bodies = [b"7", b"[1]", b"null", b"\xff", b"{", b'{"url":"u"}', b'{"url":""}', None]
    inbox = spark.createDataFrame([(i, 0, b) for i, b in enumerate(bodies)], "delivery_tag long, attempt int, body binary")
    got = [r["disposition"] for r in queue.scrape_policy(3)(inbox).orderBy("delivery_tag").collect()]
    assert got == ["retry", "retry", "retry", "retry", "drop", "ack", "retry", "retry"]


def test_no_shared_folder_is_an_error():
    from types import SimpleNamespace

    from coverlane.session import shared_dir

    settings = {}
    session = SimpleNamespace(conf=SimpleNamespace(get=settings.get))
    with pytest.raises(RuntimeError):
        shared_dir(session)
    settings["coverlane.sharedDir"] = "/a"
    assert shared_dir(session) == "/a"
    settings["spark.checkpoint.dir"] = "/b"
    assert shared_dir(session) == "/b"


def test_retries_survive_a_new_checkpoint_and_a_repeated_batch(spark):
    base = fresh_dir(spark, "test-retries")
    urls = spark.createDataFrame([(i, "" if i % 3 == 0 else f"https://e/{i}") for i in range(30)], "event_id long, url string")
    made = messages.make_tasks(urls, created=F.lit(0.0))
    made.select(F.col("event_id").alias("delivery_tag"), F.lit(0).alias("attempt"), "body").coalesce(1).write.json(f"{base}/in/first")
    first = queue.scrape_worker(f"{base}/in", f"{base}/out", max_attempts=3, stream="one")
    queue.run_available(queue.message_stream(spark, f"{base}/in"), first, f"{base}/state-one").awaitTermination()
    waiting = spark.read.json(f"{base}/in/retry-one-0").select("delivery_tag", "attempt").collect()
    assert sorted(r.delivery_tag for r in waiting) == list(range(0, 30, 3)) and {r.attempt for r in waiting} == {1}
    # the checkpoint repeats batch 0: skipped, nothing written twice
    first(spark.read.schema("delivery_tag long, attempt int, body string").json(f"{base}/in/first"), 0)
    assert spark.read.json(f"{base}/out/stream=one").count() == 30
    # a new checkpoint under another name reads the waiting tasks and leaves them where they are
    second = queue.scrape_worker(f"{base}/in", f"{base}/out", max_attempts=3, stream="two")
    queue.run_available(queue.message_stream(spark, f"{base}/in"), second, f"{base}/state-two").awaitTermination()
    assert spark.read.json(f"{base}/in/retry-one-0").count() == 10
    again = spark.read.json(f"{base}/in/retry-two-0").select("delivery_tag", "attempt").collect()
    assert sorted((r.delivery_tag, r.attempt) for r in again) == sorted([(i, 1) for i in range(0, 30, 3)] + [(i, 2) for i in range(0, 30, 3)])
