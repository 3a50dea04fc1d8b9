"""Costly per-row work is dealt out evenly and holds little at a time."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from coverlane.functions import html
from coverlane.sources.files import spread


def test_one_row_group_is_dealt_out(spark, tmp_path):
    """A file of many splits whose rows are all in one row group, thus in one split."""
    rows = pa.table({"id": list(range(40_000)), "name": [f"row {i}" for i in range(40_000)]})
    pq.write_table(rows, tmp_path / "t.parquet", row_group_size=40_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        found = spread(spark.read.parquet(str(tmp_path / "t.parquet")))
        per_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == 40_000 and max(per_task) <= 40_000 // spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_pages_are_parsed_a_few_at_a_time(monkeypatch):
    """Elements of a whole Arrow batch are never Python objects at once; nulls and pages without elements stay."""
    most = []

    class Counted(html._Flattener):
        def arrow(self, ends):
            most.append(len(ends) - 1)
            return super().arrow(ends)

    monkeypatch.setattr(html, "_Flattener", Counted)
    pages = [None if i % 7 == 0 else "" if i % 7 == 1 else f"<p id=a{i}>x{i}<b>y</b></p>" * (i % 5) for i in range(500)]
    found = html._elements.func(pa.array(pages, pa.string())).to_pylist()
    assert max(most) <= html.PAGES_AT_ONCE < 500 and sum(most) == 500
    alone = [html._elements.func(pa.array([p], pa.string())).to_pylist()[0] for p in pages]
    assert found == alone and found[0] is None and found[1] == [] and len(found[3]) == 4 * (3 % 5)
    assert html._elements.func(pa.array([], pa.string())).to_pylist() == []
