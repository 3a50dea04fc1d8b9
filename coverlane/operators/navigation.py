"""Analysis of navigation logs: states, changes, retries, stay timers, final state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlane.operators import ordered, sessions


def state(url: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The first rule whose fragment occurs in the address names the state."""
    out = None
    for fragment, name in rules:
        test = F.contains(url, F.lit(fragment))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(other)


def changes(log: DataFrame, by: ordered.Ordering, value: Column) -> DataFrame:
    """Rows where the value differs from the row before; ``prev_value`` holds that one."""
    seen = ordered.previous(ordered.cut_hot(log, by), value, "prev_value").df
    return seen.filter(F.col("prev_value").isNotNull() & ~value.eqNullSafe(F.col("prev_value"))).drop(ordered.SLICE)


def first_change(log: DataFrame, by: ordered.Ordering, tests: list[tuple[str, str]],
                 flags: list[tuple[Column, str]]) -> DataFrame:
    """The first row after the opening one that ends the wait, and why.

    ``tests`` are (column, reason): the column differs from the opening row.
    ``flags`` are (condition, reason) on the row itself. Earlier entries win.
    """
    at = F.struct(*by.order)
    opening = F.min_by(F.struct(at.alias("at"), *[c for c, _ in tests]), at)
    joined = ordered.of_key(ordered.cut_hot(log, by), opening, "_first").df.filter(at > F.col("_first.at"))
    reason = F.lit(None).cast("string")
    for condition, name in reversed(flags):
        reason = F.when(condition, name).otherwise(reason)
    for column, name in reversed(tests):
        reason = F.when(~F.col(column).eqNullSafe(F.col("_first")[column]), name).otherwise(reason)
    hits = joined.withColumn("reason", reason).filter("reason is not null")
    found = hits.groupBy(*by.keys).agg(F.min_by(F.struct(*by.order, "reason"), at).alias("_hit"))
    return found.select(*by.keys, "_hit.*")


def stays(log: DataFrame, key: str, limit: float, **options) -> DataFrame:
    """Stay timer of one state: rows of the state only, clicks as resets.

    The timer runs from the first sighting; a sighting later than ``limit`` fires and
    clears it. Leaving the state does not.
    """
    steps = log.select(key, "t", "seq", (~F.col("reset")).alias("opens"), (~F.col("reset")).alias("closes"), "reset")
    return sessions.phases(steps, key, limit, **options)


def attempts(log: DataFrame, keys: list[str], order: list[str], cap: int, is_retry: Column, max_retries: int) -> DataFrame:
    """The first ``cap`` attempts of each session with the number of retries so far.

    The cap is applied on the map side (window group limit), so the windows only ever
    see ``cap`` rows per session.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = log.withColumn("attempt", F.row_number().over(window)).filter(F.col("attempt") <= cap)
    asked = F.sum(is_retry.cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("retries", F.least(asked, F.lit(max_retries)))


def final_state(log: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    return log.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("final_state"))
