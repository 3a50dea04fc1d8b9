"""Round trips, revisits, predicates in the reader, gzip archives and odd rows."""

import glob
import gzip
import hashlib
import io

from coverlane.llm import warc

BIG = "<p>é\r\n\r\nWARC/1.0\r\n</p>" * 60
PAGES = [(1, "http://a/", BIG, 0), (2, "http://b/\r\nX: y", BIG, 0), (3, None, None, 0), (4, "http://c/", "", 0), (None, "http://d/", BIG, 0),
         (5, "http://e/", "small", 0), (6, "http://f/", "small", 0), (2, "http://b/\r\nX: y", BIG, 0), (7, "http://g/", "x" * 300_000, 0)]


def written(spark, tmp_path, rows=PAGES, **options):
    path = f"{tmp_path}/archive"
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string, payload int"), path, **options)
    return path


def test_round_trip_and_revisits(spark, tmp_path):
    path = written(spark, tmp_path)
    out = warc.read_warc(spark, f"file://{path}").collect()
    assert sorted((r.record_id, r.record_type, r.refers_to) for r in out) == sorted([
        ("<urn:page:1>", "revisit", "<urn:page:2>"), ("<urn:page:>", "revisit", "<urn:page:2>"), *[("<urn:page:2>", "response", None)] * 2,
        *[(f"<urn:page:{i}>", "response", None) for i in (3, 4, 5, 6, 7)]])
    texts = {r.record_id: bytes(r.payload).decode() for r in out if r.payload is not None}
    assert texts == {"<urn:page:2>": BIG, "<urn:page:3>": "", "<urn:page:4>": "", "<urn:page:5>": "small", "<urn:page:6>": "small", "<urn:page:7>": "x" * 300_000}
    assert all(r.payload_digest == "sha1:" + hashlib.sha1(r.payload).hexdigest() for r in out if r.payload is not None)
    assert {r.target_uri for r in out if r.record_id == "<urn:page:2>"} == {"http://b/%0D%0AX: y"}


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_pages(empty, f"{tmp_path}/none")
    assert warc.read_warc(spark, f"{tmp_path}/none").count() == 0


def test_predicates_reach_the_reader(spark, tmp_path):
    out = warc.read_warc(spark, written(spark, tmp_path)).where("record_type = 'revisit' AND content_length < 1000 AND target_uri LIKE 'http://a%'")
    assert [r.record_id for r in out.collect()] == ["<urn:page:1>"]
    assert "Filter" not in out._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    assert warc.read_warc(spark, f"{tmp_path}/archive", payload=False).where("payload IS NOT NULL").count() == 0


def test_unwanted_payloads_are_not_read(spark, tmp_path):
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            self.taken += n
            return super().read(n)

    data = b"".join(open(f, "rb").read() for f in sorted(glob.glob(written(spark, tmp_path, compression="none") + "/part-*")))
    file = Counting(data)
    tests = [("record_type", lambda x: x == "revisit")]
    assert len(list(warc.records(file, tests, True))) == 2 and file.taken == 0
    assert len(list(warc.records(Counting(data), [], True))) == len(PAGES)
    with gzip.open(f"{tmp_path}/one.warc.gz", "wb") as f:
        f.write(data)
    assert warc.read_warc(spark, f"{tmp_path}/one.warc.gz").count() == len(PAGES)
