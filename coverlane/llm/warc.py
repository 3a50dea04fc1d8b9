"""WARC archives: written by Spark's text writer, read by a Python data source.

A record is one line of a text file whose line ends are the two line breaks that close a
record, so archives go to any file system that Spark writes to. The reader plans partitions
from file sizes, takes predicates on record type and headers, parses headers first, and
skips the payload of a record that a predicate rejects or that nobody asked for.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
    LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)

from coverlane.llm.registry import query, table
from coverlane.session import fresh_dir

BREAK = "\r\n"
HTTP = f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}{BREAK}"

#: Columns of a record, and the header each comes from.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type"}
NUMBERS = {"content_length": "content-length", "payload_length": "x-payload-length"}
SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in HEADERS] + [T.StructField(name, T.LongType()) for name in NUMBERS]
                      + [T.StructField("payload", T.BinaryType())])


def write_pages(pages: DataFrame, path: str, least_revisit: int = 1000, date: str = "2000-01-01T00:00:00Z",
                compression: str = "gzip") -> None:
    """A record per row of ``pages`` (``page_id, url, html``), in archives under ``path``.

    The payload is the html in UTF-8, empty if null. Of rows with equal payloads of
    ``least_revisit`` bytes or more, those with the largest ``page_id`` are responses, the
    others revisits of it without payload. A null ``page_id`` counts as smallest and is an
    empty number in the record's name; a null url has no header; line breaks in a url are
    percent-encoded. Repeated rows are repeated records. Other columns are left out. With
    ``compression`` none, the reader can pass over payloads without reading them.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("_html"), F.octet_length(html).cast("long").alias("_bytes"), F.sha1(html.cast("binary")).alias("_sha1"))
    copies = (rows.where(F.col("_bytes") >= least_revisit).groupBy("_sha1", "_bytes").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
              .where("_n > 1").select("_sha1", "_bytes", "_last"))
    marked = rows.join(copies, ["_sha1", "_bytes"], "left")
    revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    url = F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    url = F.when(F.col("url").rlike("[\r\n]"), url).otherwise(F.col("url"))
    name = lambda number: F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(BREAK))
    optional = lambda key, value: F.coalesce(line(key, value), F.lit(""))
    record = F.concat(
        F.lit(f"WARC/1.0{BREAK}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        optional("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("_last"))),
                                 line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("X-Payload-Length", F.col("_bytes").cast("string")),
        line("Content-Length", (F.lit(len(HTTP)) + F.when(revisit, F.lit(0)).otherwise(F.col("_bytes"))).cast("string")),
        F.lit(BREAK + HTTP),
        F.when(revisit, "").otherwise(F.col("_html")),
    )
    marked.select(record.alias("value")).write.option("lineSep", BREAK * 2).option("compression", compression).text(path)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _test(f: Filter):
    """A predicate on the value of one column, or None if this filter can't be judged by headers."""
    if len(f.attribute) != 1 or f.attribute[0] not in {*HEADERS, *NUMBERS}:
        return None
    v = getattr(f, "value", None)
    kinds = {
        EqualTo: lambda x: x == v, In: lambda x: x in v, GreaterThan: lambda x: x > v, GreaterThanOrEqual: lambda x: x >= v,
        LessThan: lambda x: x < v, LessThanOrEqual: lambda x: x <= v, StringStartsWith: lambda x: x.startswith(v),
        StringEndsWith: lambda x: x.endswith(v), StringContains: lambda x: v in x,
    }
    if type(f) is IsNull:
        return f.attribute[0], lambda x: x is None
    if type(f) is IsNotNull:
        return f.attribute[0], lambda x: x is not None
    test = kinds.get(type(f))
    return test and (f.attribute[0], lambda x: x is not None and test(x))


def records(file, tests: list, with_payload: bool) -> Iterator[tuple]:
    """Rows of SCHEMA from an open archive; the payload of a rejected record is passed over unread."""
    while line := file.readline():
        if not line.strip():
            continue  # the line breaks after a record
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := file.readline().rstrip(b"\r\n")):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        row = {name: headers.get(key) for name, key in HEADERS.items()}
        row |= {name: int(headers[key]) if headers.get(key, "").isdigit() else None for name, key in NUMBERS.items()}
        size = row["content_length"] or 0
        wanted = all(test(row[name]) for name, test in tests)
        payload = None
        if wanted and with_payload and row["record_type"] != "revisit":
            payload = file.read(size)
            if len(payload) < size:
                raise ValueError("the archive ends inside a record")
            if (row["content_type"] or "").startswith("application/http"):
                payload = payload.partition(b"\r\n\r\n")[2]
        else:
            file.seek(size, io.SEEK_CUR)
        if wanted:
            yield (*row.values(), payload)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.with_payload = options["path"], options.get("payload", "true").lower() == "true"
        self.split, self.filters = int(options.get("splitbytes", 32 << 20)), []

    def _open(self):
        path = self.path
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[Files]:
        store, root = self._open()
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(pa.fs.FileSelector(root, recursive=True))
        files = sorted(((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", "."))))
        out, size = [[]], 0
        for path, n in files:
            if out[-1] and size + n > self.split:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [Files(paths) for paths in out if paths]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._open()
        tests = [_test(f) for f in self.filters]
        kinds = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in SCHEMA])
        rows, size = [], 0
        for path in partition.paths if partition else ():
            raw = store.open_input_file(path)
            with gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20) as file:
                for row in records(file, tests, self.with_payload):
                    rows.append(row)
                    size += len(row[-1] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


class WarcSource(DataSource):
    """``spark.read.format("warc")``: options ``path``, ``payload`` (false: headers only) and ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of all archives under ``path``, plain or ``.gz``; the payload is null for revisits and if not asked for.

    Files are never split: a partition has whole files of 32 MB together, or one larger one.
    Turns on Spark's setting for filters that go to Python sources. No files give no rows.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


@query("op3_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) END AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
    CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM m
""")
def op3_warc(spark, sf_dir):
    path = fresh_dir(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    number = lambda name: F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1)
    as_long = lambda name: F.when(number(name) != "", number(name)).cast("long")
    return read_warc(spark, path).select(
        as_long("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type", as_long("refers_to").alias("refers_to"))
