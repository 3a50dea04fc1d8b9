"""Lookups against the portal catalog and the nesting of its settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlane.operators import ordered

PAGE_SIZE = 1000
MASK = "***"


def first_per_name(catalog: DataFrame) -> DataFrame:
    """One catalog row per insurer name: the oldest, then the lowest id."""
    whole = F.struct(*catalog.columns)
    best = catalog.groupBy("name").agg(F.min_by(whole, F.struct("created_at", "id")).alias("c"))
    return best.select("c.*")


def enrich(messages: DataFrame, catalog: DataFrame, name: str = "insurer_name", how: str = "inner") -> DataFrame:
    """Messages that have a catalog row, with that row as the struct ``catalog``.

    With ``how="left"`` the others stay too, with a null struct.

    Spark broadcasts the catalog when its measured size allows and otherwise joins by
    shuffle, where adaptive execution splits a name that dominates the messages.
    """
    single = first_per_name(catalog)
    boxed = single.select(F.col("name").alias(name), F.struct(*single.columns).alias("catalog"))
    return messages.join(boxed, name, how)


def unmatched(messages: DataFrame, catalog: DataFrame, name: str = "insurer_name") -> DataFrame:
    return messages.join(catalog.select(F.col("name").alias(name)), name, "left_anti")


def only_known(rows: DataFrame, keys: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows whose key is listed: used for the active sessions and the registry."""
    return rows.join(keys, on, "left_semi")


def active(fields: DataFrame) -> DataFrame:
    return fields.filter(F.col("active"))


def pages(children: DataFrame, key: str, order: tuple[str, ...], items: Column, cut: Column,
          page_size: int = PAGE_SIZE, hot_rows: int | None = None) -> DataFrame:
    """Ordered child lists, in pages: ``key, page, items``.

    A list of settings fits on page 0. A longer one goes on in further pages, so no
    task ever builds a list above ``page_size`` and no child is lost.
    """
    by = ordered.Ordering((key,), order, cut, hot_rows)
    placed = ordered.row_position(ordered.cut_hot(children, by), "_pos").df
    page = F.floor((F.col("_pos") - 1) / page_size).alias("page")
    grouped = placed.groupBy(key, page).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_pos"), items.alias("item")))).alias("boxed"))
    return grouped.select(key, "page", F.transform("boxed", lambda x: x["item"]).alias("items"))


def nested(catalog: DataFrame, lists: dict[str, DataFrame], key: str = "url_id") -> DataFrame:
    """Catalog rows with one list column per kind of child; an absent list is empty.

    There is one row per entry and page, and page 0 is always there.
    """
    entries = catalog.withColumnRenamed("id", key)
    out = entries.select(key, F.lit(0).cast("long").alias("page"))
    for name, child in lists.items():
        out = out.join(child.withColumnRenamed("items", name), [key, "page"], "full_outer")
    filled = {n: F.coalesce(F.col(n), F.array().cast(c.schema["items"].dataType)) for n, c in lists.items()}
    return entries.join(out.withColumns(filled), key)


def login_field_pages(fields: DataFrame, cut: Column, **options) -> DataFrame:
    """Login fields by selector. Their values are secrets and leave masked."""
    item = F.struct("selector", F.when(F.col("value").isNotNull(), MASK).alias("value"))
    return pages(fields, "url_id", ("selector",), item, cut, **options)


def action_pages(actions: DataFrame, cut: Column, **options) -> DataFrame:
    item = F.struct("action_type", "selector", F.when(F.col("value").isNotNull(), MASK).alias("value"))
    return pages(actions, "url_id", ("action_type", "selector"), item, cut, **options)


def capture_field_pages(fields: DataFrame, cut: Column, **options) -> DataFrame:
    item = F.struct("field_name", "field_type", "selector", "ord", "required", "submit_selector")
    return pages(active(fields), "url_id", ("ord", "field_name"), item, cut, **options)


def first_input(fields: DataFrame) -> DataFrame:
    """The one field a portal search uses: the first active input by order."""
    inputs = active(fields).filter(F.lower("field_type") == "input")
    whole = F.struct(*fields.columns)
    return inputs.groupBy("url_id").agg(F.min_by(whole, F.struct("ord", "field_name")).alias("f")).select("f.*")


def sort_by_ord(items: Column) -> Column:
    """Stable sort of a list of structs by ``ord``, where a missing one counts as 0."""
    tagged = F.transform(items, lambda x, i: F.struct(F.coalesce(x["ord"], F.lit(0)).alias("o"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda t: t["x"])


def action_kind(action_type: Column) -> Column:
    kind = F.lower(action_type)
    return F.when(kind.isin("click", "submit", "send_keys"), kind).otherwise("unknown")


def selector_kind(selector: Column) -> Column:
    return (F.when(selector.startswith("#"), "id").when(selector.startswith("."), "class")
            .when(selector.startswith("//"), "xpath").otherwise("css"))
