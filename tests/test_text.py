import datetime as dt

from pyspark.sql import functions as F

from coverlane.functions import text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_strip_takes_every_blank(spark):
    samples = ["\x1c a b\xa0", " x　", "\t\n", "", "a", "﻿b "]
    got = spark.createDataFrame([(s,) for s in samples], "s string").select(text.strip("s").alias("v")).collect()
    assert [r["v"] for r in got] == [s.strip() for s in samples]


def test_fold_name_is_split_join_upper(spark):
    samples = [" ana\xa0\tluz ", "straße\x1fñu", "", " ", "Año  Nuevo"]
    got = spark.createDataFrame([(s,) for s in samples], "s string").select(text.fold_name("s").alias("v")).collect()
    assert [r["v"] for r in got] == [" ".join(s.split()).upper() for s in samples]


def test_full_name_rules(spark):
    cases = [(" ANA ", "", "PRUEBA", "X"), ("A", None, "B", "C"), ("", " ", "", "\xa0"), ("A", "B", "C", "")]
    got = spark.createDataFrame(cases, "a string, b string, c string, d string").select(text.full_name("a", "b", "c", "d").alias("v")).collect()
    assert [r["v"] for r in got] == ["ANA  PRUEBA X", None, None, "A B C"]


def test_field_tells_missing_from_null(spark):
    bodies = ['{"k":"v"}', '{"k":null}', "{}", '{"k":""}']
    df = spark.createDataFrame([(b,) for b in bodies], "b string").withColumn("m", F.from_json("b", "map<string,string>"))
    assert [r[0] for r in df.select(text.field("m", "k", "d")).collect()] == ["v", None, "d", ""]


def test_falsy_values(spark):
    df = spark.createDataFrame([(None, None), ("", 0), ("0", 7)], "s string, i long")
    assert [tuple(r) for r in df.select(text.has_value("s"), text.has_id("i")).collect()] == [(False, False), (False, False), (True, True)]
    assert value(spark, text.first_filled(F.lit(None).cast("string"), F.lit(""), F.lit("x"))) == "x"
    assert value(spark, text.first_filled(F.lit(""))) == ""
    assert value(spark, text.shown(F.lit(""), "N/A")) == "N/A"


def test_lists_flags_numbers(spark):
    assert value(spark, text.comma_list(F.lit(""))) == []
    assert value(spark, text.comma_list(F.lit("a,,b"))) == ["a", "", "b"]
    assert value(spark, text.flag(F.lit("YES"), "yes")) is True
    assert value(spark, text.flag(F.lit(None).cast("string"), "true", "true")) is True
    assert value(spark, text.number(F.lit(""), "int", 5)) == 5
    assert value(spark, text.number(F.lit("x"), "int", 5)) is None
    assert value(spark, text.contains_any(F.lit("a póliza b"), ["zzz", "póliza"])) is True


def test_time_texts(spark):
    whole, part = dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 60)
    for moment in (whole, part):
        assert value(spark, text.iso(F.lit(moment))) == moment.isoformat()
        assert value(spark, text.stamp(F.lit(moment))) == moment.strftime("%Y-%m-%d %H:%M:%S")
    df = spark.createDataFrame([(whole,)], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Guayaquil")
        got = df.select(text.micros(df, "t")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == int(whole.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


def test_stable_id_repeats(spark):
    df = spark.range(3).withColumn("i", text.stable_id("id", F.lit(0)))
    assert df.collect() == df.collect()
    assert all(len(r["i"]) == 32 for r in df.collect())
