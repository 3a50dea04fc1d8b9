"""Row-to-row logic along a key, safe for keys that hold a large share of all rows.

A plain window over ``key`` puts one key into one task. Here a key with more than
``hot_rows`` rows is first cut into slices that follow the order of its rows (for
example one slice per minute). Windows run per ``(key, slice)``; one summary row
per slice then carries the state over the slice borders. Keys below the mark stay
in a single slice; the plan is the same for all sizes, and nothing runs before the query
does. Null keys are a key, and rows whose slice can't be told (a null order value) are the
first slice. The mark can be set for a session as ``coverlane.hotRows``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000
SLICE = "_slice"


@dataclass(frozen=True)
class Ordering:
    """Key columns, order columns and the expression that cuts a hot key.

    ``cut`` must never decrease along the order columns.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    cut: Column
    hot_rows: int | None = None


@dataclass(frozen=True)
class Sliced:
    df: DataFrame
    by: Ordering

    def with_df(self, df: DataFrame) -> "Sliced":
        return Sliced(df, self.by)


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join by columns of the same names where null equals null; the right side's copies go."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on])
    return left.join(renamed, same, how).drop(*[f"_right_{c}" for c in on])


def hot_mark(df: DataFrame, hot_rows: int | None) -> int:
    """Rows above which a key is cut: as given, as set for the session, or the default."""
    return hot_rows if hot_rows is not None else int(df.sparkSession.conf.get("coverlane.hotRows", str(HOT_ROWS)))


def hot_keys(df: DataFrame, keys: tuple[str, ...], hot_rows: int | None = None) -> DataFrame:
    """The keys with more rows than the mark."""
    return df.groupBy(*keys).count().filter(F.col("count") > hot_mark(df, hot_rows)).select(*keys)


def cut_hot(df: DataFrame, by: Ordering) -> Sliced:
    """Add the slice column: null for ordinary keys, a struct of the value of ``cut`` for hot ones."""
    hot = hot_keys(df, by.keys, by.hot_rows).withColumn("_hot", F.lit(True))
    joined = _join(df, hot, list(by.keys), "left")
    return Sliced(joined.withColumn(SLICE, F.when(F.col("_hot"), F.struct(by.cut.alias("cut")))).drop("_hot"), by)


def _columns(sliced: Sliced) -> list[str]:
    return [*sliced.by.keys, SLICE]


def _window(sliced: Sliced, backwards: bool = False) -> Window:
    order = [F.desc(c) if backwards else F.asc(c) for c in sliced.by.order]
    return Window.partitionBy(*_columns(sliced)).orderBy(*order)


def _attach(sliced: Sliced, df: DataFrame, summary: DataFrame, name: str) -> DataFrame:
    """Bring one carried value per slice back to the rows of that slice."""
    on = [*sliced.by.keys, SLICE]
    return _join(df, summary.select(*on, name), on, "left")


def _between_slices(sliced: Sliced, backwards: bool = False) -> Window:
    order = F.desc(SLICE) if backwards else F.asc(SLICE)
    return Window.partitionBy(*sliced.by.keys).orderBy(order)


def _hot_slices(sliced: Sliced, value: Column) -> DataFrame:
    hot = sliced.df.filter(F.col(SLICE).isNotNull())
    return hot.groupBy(*sliced.by.keys, SLICE).agg(value.alias("_carry"))


def previous(sliced: Sliced, value: Column, name: str) -> Sliced:
    """The value on the row before this one, null on the first row of the key."""
    boxed = F.struct(value.alias("v"))
    out = sliced.df.withColumn(name, F.lag(boxed).over(_window(sliced)))
    last = _hot_slices(sliced, F.max_by(boxed, F.struct(*sliced.by.order)))
    carried = last.withColumn("_carry", F.lag("_carry").over(_between_slices(sliced)))
    out = _attach(sliced, out, carried, "_carry")
    return sliced.with_df(out.withColumn(name, F.coalesce(F.col(name), F.col("_carry"))["v"]).drop("_carry"))


def running_total(sliced: Sliced, amount: Column, name: str) -> Sliced:
    """Sum of ``amount`` over the rows of the key up to and including this one."""
    window = _window(sliced).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sliced.df.withColumn(name, F.sum(amount).over(window))
    earlier = _between_slices(sliced).rowsBetween(Window.unboundedPreceding, -1)
    carried = _hot_slices(sliced, F.sum(amount)).withColumn("_carry", F.sum("_carry").over(earlier))
    out = _attach(sliced, out, carried, "_carry")
    return sliced.with_df(out.withColumn(name, F.col(name) + F.coalesce(F.col("_carry"), F.lit(0))).drop("_carry"))


def row_position(sliced: Sliced, name: str) -> Sliced:
    """Position within the key, counted from 1."""
    return running_total(sliced, F.lit(1).cast("long"), name)


def _nearest(sliced: Sliced, value: Column, when: Column, name: str, backwards: bool, own: bool) -> Sliced:
    boxed = F.when(when, F.struct(value.alias("v")))
    frame = _window(sliced, backwards).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    out = sliced.df.withColumn(name, F.last(boxed, ignorenulls=True).over(frame))
    pick = F.min_by if backwards else F.max_by
    edge = _hot_slices(sliced, pick(boxed, F.when(when, F.struct(*sliced.by.order))))
    frame = _between_slices(sliced, backwards).rowsBetween(Window.unboundedPreceding, -1)
    carried = edge.withColumn("_carry", F.last("_carry", ignorenulls=True).over(frame))
    out = _attach(sliced, out, carried, "_carry")
    return sliced.with_df(out.withColumn(name, F.coalesce(F.col(name), F.col("_carry"))["v"]).drop("_carry"))


def last_seen(sliced: Sliced, value: Column, when: Column, name: str) -> Sliced:
    """The value on the latest row, this one included, for which ``when`` holds."""
    return _nearest(sliced, value, when, name, backwards=False, own=True)


def next_seen(sliced: Sliced, value: Column, when: Column, name: str) -> Sliced:
    """The value on the first later row for which ``when`` holds."""
    return _nearest(sliced, value, when, name, backwards=True, own=False)


def of_key(sliced: Sliced, value: Column, name: str) -> Sliced:
    """An aggregate over the whole key, on each of its rows.

    The value travels by key and slice, so the rows of a hot key stay spread out.
    """
    keys = list(sliced.by.keys)
    values = sliced.df.groupBy(*keys).agg(value.alias(name))
    part = F.coalesce(F.hash(SLICE), F.lit(0)).alias("_part")
    parts = _join(sliced.df.select(*keys, part).distinct(), values, keys, "inner")
    return sliced.with_df(_join(sliced.df.withColumn("_part", part), parts, [*keys, "_part"], "inner").drop("_part"))


def longest_runs(sliced: Sliced, hit: Column) -> DataFrame:
    """Per key, the longest unbroken run of rows for which ``hit`` holds."""
    miss = F.when(hit, 0).otherwise(1).cast("long")
    islands = running_total(sliced, miss, "_island").df
    keys = list(sliced.by.keys)
    runs = islands.groupBy(*keys, "_island").agg(F.sum(F.when(hit, 1).otherwise(0)).alias("_run"))
    return runs.groupBy(*keys).agg(F.max("_run").alias("longest_run"))
