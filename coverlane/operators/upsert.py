"""Update-or-insert as set operations.

Messages are handled one by one in order, and a later message can update what an
earlier one inserted. Per key that comes down to: identity from the first message,
policy values from the last. So the whole batch is one aggregation and one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlane.functions import text
from coverlane.schemas import NAME_PARTS

KEY = ("invoice_id", "insurer_id")
ORDER = ("delivery_tag", "pos")
VALUES = ("policy_no", "dependent_no")
IDENTITY = ("doc_id", *NAME_PARTS)
ACTIVE = 1


def _keyed() -> Column:
    return text.has_id(KEY[0]) & text.has_id(KEY[1])


def _reduced(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per key the identity of its first message and the values of its last; and the messages without key."""
    at = F.struct(*ORDER)
    per_key = source.filter(_keyed()).groupBy(*KEY).agg(
        F.min_by(F.struct(*ORDER, *IDENTITY), at).alias("first"), F.max_by(F.struct(*VALUES), at).alias("last"))
    return per_key, source.filter(~_keyed()).select(*KEY, *ORDER, *IDENTITY, *VALUES)


def changes(source: DataFrame, target: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The updates (``id`` and new values) and the rows to insert.

    ``source`` holds matched clients only: key, order, identity and value columns.
    """
    per_key, alone = _reduced(source)
    existing = target.filter((F.col("status") == ACTIVE) & _keyed()).groupBy(*KEY).agg(F.min("id").alias("id"))
    decided = per_key.join(existing, list(KEY), "left")
    updates = decided.filter(F.col("id").isNotNull()).select("id", "last.*")
    fresh = decided.filter(F.col("id").isNull()).select(*KEY, "first.*", "last.*")
    return updates, insert_rows(fresh.unionByName(alone), now if now is not None else F.current_timestamp())


def insert_rows(rows: DataFrame, moment: Column) -> DataFrame:
    """New invoice rows. The id is derived from the message, so a retry repeats it."""
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in (*IDENTITY, *VALUES)]
    return rows.select(
        text.stable_id(*ORDER).alias("id"), *KEY, *blank,
        moment.alias("created_at"), F.lit(ACTIVE).cast("byte").alias("status"))


def without_known(source: DataFrame, target: DataFrame) -> DataFrame:
    """Messages without a key whose row (by its id, made from the message) is in the target already are dropped."""
    known = target.select(F.col("id").alias("_known")).distinct()
    marked = source.withColumn("_id", F.when(~_keyed(), text.stable_id(*ORDER)))
    return marked.join(known, marked["_id"] == known["_known"], "left_anti").drop("_id")


def apply_updates(target: DataFrame, updates: DataFrame, key: str = "id", values: tuple[str, ...] = VALUES) -> DataFrame:
    """Target rows with the listed values replaced where an update exists for their key."""
    renamed = updates.select(key, F.struct(*values).alias("_new"))
    joined = target.join(renamed, key, "left")
    new = {v: F.when(F.col("_new").isNotNull(), F.col("_new")[v]).otherwise(F.col(v)) for v in values}
    return joined.withColumns(new).select(*target.columns)


def upsert(source: DataFrame, target: DataFrame, now: Column | None = None) -> DataFrame:
    """The target after every message of the source was applied.

    One outer join by key with the active target rows, numbered per key: the first takes
    the new values, a key found in the source only becomes a row. Inactive rows and rows
    without key pass by; messages without key become rows each.
    """
    moment = now if now is not None else F.current_timestamp()
    per_key, alone = _reduced(source)
    live = F.coalesce((F.col("status") == ACTIVE) & _keyed(), F.lit(False))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("id"))
    kept = target.filter(live).withColumn("_place", place)
    joined = kept.join(per_key, list(KEY), "full")
    new = {v: F.when((F.col("_place") == 1) & F.col("last").isNotNull(), F.col("last")[v]).otherwise(F.col(v)) for v in VALUES}
    made = {"id": text.stable_id(*[F.col("first")[o] for o in ORDER]), "created_at": moment, "status": F.lit(ACTIVE).cast("byte"),
            **{c: F.coalesce(F.col("first")[c], F.lit("")) for c in IDENTITY}, **{c: F.coalesce(F.col("last")[c], F.lit("")) for c in VALUES}}
    out = [F.when(F.col("_place").isNull(), made.get(c, F.col(c))).otherwise(new.get(c, F.col(c))).cast(target.schema[c].dataType).alias(c)
           for c in target.columns]
    return joined.select(*out).unionByName(target.filter(~live)).unionByName(insert_rows(alone, moment).select(*target.columns))


def edit_settings(settings: DataFrame, edits: DataFrame, key: tuple[str, ...], values: tuple[str, ...],
                  order: tuple[str, ...] = ()) -> DataFrame:
    """Settings rows updated by key; edits with an unknown key are appended.

    Of several edits of one key the last by ``order`` counts, and of equal ones, or without
    an order, that with the largest values.
    """
    on = list(key)
    rest = [c for c in edits.columns if c not in on]
    last = F.max_by(F.struct(*rest), F.struct(*order, *values))
    edits = edits.groupBy(*on).agg(last.alias("_last")).select(*on, "_last.*").select(*edits.columns)
    slot = edits.select(*on, F.struct(*values).alias("_new"))
    joined = settings.join(slot, on, "left")
    new = {v: F.when(F.col("_new").isNotNull(), F.col("_new")[v]).otherwise(F.col(v)) for v in values}
    changed = joined.withColumns(new).select(*settings.columns)
    added = edits.join(settings.select(*on).distinct(), on, "left_anti")
    return changed.unionByName(added, allowMissingColumns=True)
