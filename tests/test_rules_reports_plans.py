import datetime as dt

from pyspark.sql import functions as F

from coverlane.operators import catalog, plugins, reports, rules
from coverlane.plans import QUERIES
from coverlane.sources import files

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_required_settings(spark):
    df = spark.createDataFrame([("", None), ("h", 0)], "host string, delay int")
    assert [r[0] for r in df.select(rules.missing_settings(["host"], ["delay"])).collect()] == [["host is not set", "delay is not set"], []]
    assert "RABBITMQ_ROUTING_KEY" not in rules.REQUIRED_TEXT


def test_id_and_length_limits(spark):
    df = spark.createDataFrame([("12", "x" * 26), ("1a", "x"), (None, None)], "invoice_id string, doc_id string")
    ids = [r[0] for r in df.select(rules.id_errors(["invoice_id"])).collect()]
    assert ids == [[], ["invoice_id is not a number"], []]
    good, bad = rules.split_rejects(df, rules.limit_errors(df))
    assert good.count() == 2 and bad.first()["errors"] == ["doc_id is longer than 25"]


def test_capture_needs_a_document_number(spark):
    df = spark.createDataFrame([(0, ""), (2, ""), (2, None), (2, "1"), (None, None)], "n int, doc string")
    assert [r[0] for r in df.select(reports.can_capture(F.col("n"), F.col("doc"))).collect()] == [True, False, False, True, True]


def test_small_scans_are_spread_and_larger_ones_are_not(spark):
    pages = files.captured_pages(spark, f"{SF}/pages.parquet")
    assert pages.columns == ["page_id", "url", "html"]
    assert files.spread(pages).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = pages.repartition(5)
    assert files.spread(wide).rdd.getNumPartitions() == 5


def test_outcome_depends_on_fresh_login(spark):
    cases = [("", True, True, "login", True), ("A", False, True, "live", True), ("A", True, False, "none", False), ("A", True, True, "login", False),
             ("A", True, True, "live", False), ("A", True, True, "late", True), ("A", True, True, "none", True), (None, True, True, "live", True)]
    df = spark.createDataFrame(cases, "name string, url boolean, needs boolean, phase string, ok boolean")
    got = df.select(reports.outcome(F.col("name"), F.col("url"), F.col("needs"), F.col("phase"), F.col("ok"))).collect()
    assert [r[0] for r in got] == ["no_name", "no_url", "ok", "ok", "capture_failed", "ok", "login_failed", "no_name"]


def test_sort_by_ord_is_stable(spark):
    df = spark.sql("SELECT array(named_struct('ord', 2, 'n', 'a'), named_struct('ord', null, 'n', 'b'), named_struct('ord', 0, 'n', 'c')) AS x")
    assert [x["n"] for x in df.select(catalog.sort_by_ord(F.col("x"))).first()[0]] == ["b", "c", "a"]


def test_first_catalog_row(spark):
    late, early = dt.datetime(2024, 2, 1), dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("2", "A", late), ("3", "A", early), ("1", "B", early)], "id string, name string, created_at timestamp")
    assert sorted(tuple(r)[:2] for r in catalog.first_per_name(df).collect()) == [("1", "B"), ("3", "A")]


def test_listing_defaults(spark):
    df = spark.createDataFrame([("a", None, "", None)], "code string, name string, country string, active boolean")
    assert tuple(plugins.listing(df).first()) == ("a", "N/A", "N/A", False)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["param_scan"](spark, SF))
    assert "EqualTo(l_returnflag,R)" in text and "l_extendedprice" not in text
    text = plan(QUERIES["daily_stats"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in text


def test_top_lists_do_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["latest10"](spark, SF))
    assert "WindowGroupLimit" in plan(QUERIES["attempts"](spark, SF))


def test_pages_are_parsed_once_and_not_shuffled(spark):
    frame = QUERIES["html_table"](spark, SF)
    text = plan(frame)
    assert text.count("ArrowEvalPython") == 1
    assert "hashpartitioning" not in text and "BatchEvalPython" not in text
