"""Counts, alerts, outcomes and run reports."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlane.functions import text
from coverlane.operators import ordered, sessions

# Alert limits.
MIN_SUCCESS_RATE = 0.95
MAX_LOGIN_SECONDS = 30.0
MAX_FAILURES_IN_A_ROW = 5


def daily_stats(results: DataFrame, ts: str, seconds: str) -> DataFrame:
    return results.groupBy(F.to_date(ts).alias("day")).agg(
        F.count("*").alias("n"), F.round(F.avg(seconds), 6).alias("avg_seconds"))


def latest(results: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    return results.orderBy(*order).limit(n)


def error_rows(results: DataFrame, as_documented: bool = False) -> DataFrame:
    """Rows with an error. No error is stored as '', so the documented test keeps every row."""
    message = F.col("error_message")
    return results.filter(message.isNotNull() if as_documented else F.nullif(message, F.lit("")).isNotNull())


def name_list(names: DataFrame, name: str) -> DataFrame:
    """The distinct names, a row each, with their number ``n`` (nulls don't count)."""
    distinct = names.select(name).where(F.col(name).isNotNull()).distinct()
    return distinct.crossJoin(F.broadcast(distinct.agg(F.count("*").alias("n"))))  # one row


def queue_status(inbox: DataFrame, done: Column) -> DataFrame:
    return inbox.agg(F.count_if(done).alias("processed"), F.count_if(~done).alias("pending"))


def worker_status(outcomes: DataFrame, ts_micros: Column, handled: Column) -> DataFrame:
    return outcomes.agg(
        F.count_if(handled).alias("processed"), F.count_if(~handled).alias("unprocessed"),
        F.round(text.seconds_between(F.min(ts_micros), F.max(ts_micros)), 3).alias("uptime_seconds"))


def alerts(runs: DataFrame, by: ordered.Ordering, ok: Column, seconds: Column,
           min_rate: float = MIN_SUCCESS_RATE, max_seconds: float = MAX_LOGIN_SECONDS,
           max_failures: int = MAX_FAILURES_IN_A_ROW) -> DataFrame:
    """Per key: success rate, longest duration, longest run of failures, and the alerts."""
    keys = list(by.keys)
    rates = runs.groupBy(*keys).agg(
        F.avg(ok.cast("int")).alias("_rate"), F.max(seconds).alias("max_seconds"))
    runs_of_failures = ordered.longest_runs(ordered.cut_hot(runs, by), ~ok)
    other = runs_of_failures.select(*[F.col(k).alias(f"_{k}") for k in keys], "longest_run")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rates.join(other, same).select(
        *keys, F.round("_rate", 6).alias("success_rate"), "max_seconds", "longest_run",
        (F.col("_rate") < min_rate).alias("rate_alert"),
        (F.col("max_seconds") > max_seconds).alias("duration_alert"),
        (F.col("longest_run") > max_failures).alias("failure_alert"))


def can_capture(n_fields: Column, doc_id: Column) -> Column:
    """A capture fails without a document number, unless no field is configured at all."""
    return F.when(F.coalesce(n_fields, F.lit(0)) == 0, True).otherwise(text.has_value(doc_id))


def outcome(name: Column, has_url: Column, needs_session: Column, phase: Column, capture_ok: Column) -> Column:
    """What became of one client.

    A failed capture fails the client on a running session but not right after a login,
    so the outcome needs the session phase. The session insurer looks up its address
    before the session is touched.
    """
    on_session = phase.isin(sessions.LIVE, sessions.LATE)
    logged_in = phase == sessions.LOGIN
    return (F.when(~text.has_value(name), "no_name").when(~has_url, "no_url").when(~needs_session, "ok")
            .when(logged_in, "ok").when(on_session & ~capture_ok, "capture_failed")
            .when(on_session, "ok").otherwise("login_failed"))


def run_metrics(runs: DataFrame, keys: list[str], ts: Column, micros: Column, ok: Column) -> DataFrame:
    return runs.groupBy(*keys).agg(
        F.count("*").alias("total"), F.min(ts).alias("started"), F.max(ts).alias("ended"),
        F.round(text.seconds_between(F.min(micros), F.max(micros)), 3).alias("seconds"),
        F.bool_and(ok).alias("ok"))


def run_report(metrics: DataFrame, settings: Column) -> DataFrame:
    """One JSON report per run."""
    report = F.struct(
        text.stamp("ended").alias("date"), text.verdict(F.col("ok")).alias("result"),
        F.struct("total", text.iso("started").alias("started"), text.iso("ended").alias("ended"), "seconds").alias("metrics"),
        settings.alias("settings"))
    return metrics.withColumn("report", F.to_json(report))
