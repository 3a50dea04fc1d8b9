import random

import pytest
from pyspark.sql import functions as F

from coverlane.operators import upsert
from coverlane.schemas import NAME_PARTS

SOURCE = "delivery_tag long, pos int, invoice_id long, insurer_id long, doc_id string, policy_no string, dependent_no string"
TARGET = "id string, invoice_id long, insurer_id long, doc_id string, policy_no string, dependent_no string, status byte"


def one_by_one(source, target):
    table = [list(r) for r in target]
    inserted = 0
    for tag, pos, invoice, insurer, doc, policy, dependent in sorted(source, key=lambda r: r[:2]):
        hits = sorted((r for r in table if invoice and insurer and r[1] == invoice and r[2] == insurer and r[6] == 1), key=lambda r: r[0])
        old = [r for r in hits if not r[0].startswith("new")] or hits
        if old:
            old[0][4], old[0][5] = policy, dependent
        else:
            table.append([f"new{inserted:04}", invoice, insurer, doc, policy, dependent, 1])
            inserted += 1
    return sorted((tuple(r[1:]) for r in table), key=repr)


def frames(spark, source, target):
    blank = {c: F.lit("") for c in NAME_PARTS}
    left = spark.createDataFrame(source, SOURCE).repartition(3).withColumns(blank)
    right = spark.createDataFrame(target, TARGET).withColumns(blank).withColumn("created_at", F.lit(None).cast("timestamp"))
    return left, right


@pytest.mark.parametrize("seed", range(3))
def test_same_as_message_by_message(spark, seed):
    rng = random.Random(seed)
    ids = [None, 0, 1, 2, 3]
    target = [(f"T{i}", rng.choice(ids), rng.choice(ids), "d", "old", "0", rng.choice([0, 1, 1])) for i in range(12)]
    source = [(i // 3, i % 3, rng.choice(ids), rng.choice(ids), f"D{i}", f"P{i}", f"X{i}") for i in range(60)]
    after = upsert.upsert(*frames(spark, source, target))
    got = sorted((tuple(r) for r in after.select("invoice_id", "insurer_id", "doc_id", "policy_no", "dependent_no", "status").collect()), key=repr)
    assert got == one_by_one(source, target)


def test_counts_and_repeatable_ids(spark):
    left, right = frames(spark, [(1, 0, 1, 1, "D", "P", ""), (2, 0, None, 1, None, "Q", None)], [("T", 1, 1, "d", "old", "0", 1)])
    updates, inserts = upsert.changes(left, right)
    assert [tuple(r) for r in updates.collect()] == [("T", "P", "")]
    first, again = inserts.collect(), upsert.changes(left, right)[1].collect()
    assert first[0]["id"] == again[0]["id"] and first[0]["doc_id"] == "" and first[0]["invoice_id"] is None


def test_settings_edit(spark, rows):
    settings = spark.createDataFrame([("u", "a", 1), ("u", "b", 2)], "url_id string, field_name string, ord int")
    edits = spark.createDataFrame([("u", "b", 9), ("v", "a", 5)], "url_id string, field_name string, ord int")
    assert rows(upsert.edit_settings(settings, edits, ("url_id", "field_name"), ("ord",))) == [("u", "a", 1), ("u", "b", 9), ("v", "a", 5)]


def test_repeated_edits_of_one_key(spark, rows):
    settings = spark.createDataFrame([("u", "a", 1)], "url_id string, field_name string, ord int")
    edits = spark.createDataFrame([("u", "a", 9, 1), ("u", "a", 5, 2), ("v", "a", 7, 1), ("v", "a", 6, 2)], "url_id string, field_name string, ord int, at int")
    got = upsert.edit_settings(settings, edits, ("url_id", "field_name"), ("ord",), ("at",)).select("url_id", "field_name", "ord")
    assert rows(got) == [("u", "a", 5), ("v", "a", 6)]
