"""Statistics, top lists, error rows and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlane.functions import text
from coverlane.operators import reports
from coverlane.plans.registry import query, table


@query("daily_stats", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 6) AS avg_seconds FROM events GROUP BY 1")
def daily_stats(spark, sf_dir):
    return reports.daily_stats(table(spark, sf_dir, "events"), "ts", "value")


@query("latest10", "SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id LIMIT 10")
def latest10(spark, sf_dir):
    top = reports.latest(table(spark, sf_dir, "events"), [F.desc("ts"), F.asc("event_id")])
    return top.select("event_id", "user_id", "event_type", "value")


@query("top5_names", "SELECT c_name FROM customer ORDER BY c_name LIMIT 5")
def top5_names(spark, sf_dir):
    return reports.latest(table(spark, sf_dir, "customer").select("c_name"), [F.asc("c_name")], 5)


ERRORS_SQL = "SELECT event_id, CASE WHEN event_type = 'error' THEN props WHEN event_type = 'view' THEN NULL ELSE '' END AS error_message FROM events"


def _with_errors(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(kind == "error", F.col("props")).when(kind != "view", "").alias("error_message"))


@query("errors_asis", f"SELECT * FROM ({ERRORS_SQL}) WHERE error_message IS NOT NULL")
def errors_asis(spark, sf_dir):
    return reports.error_rows(_with_errors(spark, sf_dir), as_documented=True)


@query("errors_fixed", f"SELECT * FROM ({ERRORS_SQL}) WHERE error_message <> ''")
def errors_fixed(spark, sf_dir):
    return reports.error_rows(_with_errors(spark, sf_dir))


@query("report", """
WITH m AS (SELECT user_id, count(*) AS total, min(ts) AS started, max(ts) AS ended,
  round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0, 3) AS seconds, bool_and(event_type <> 'error' OR value < 200) AS ok FROM events GROUP BY 1)
SELECT user_id, total, seconds, CASE WHEN ok THEN 'EXITOSO' ELSE 'FALLIDO' END AS result, strftime(ended, '%Y-%m-%d %H:%M:%S') AS date,
  strftime(started, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(started) % 1000000 = 0 THEN ''
    ELSE '.' || lpad(CAST(microsecond(started) % 1000000 AS VARCHAR), 6, '0') END AS started, 2 AS n_fields FROM m""")
def report(spark, sf_dir):
    """One report per user, written as JSON and read back."""
    events = table(spark, sf_dir, "events")
    ok = (F.col("event_type") != "error") | (F.col("value") < 200)
    metrics = reports.run_metrics(events, ["user_id"], F.col("ts"), text.micros(events, "ts"), ok)
    settings = F.struct(F.lit("https://portal/login").alias("login_url"), F.size(F.array(F.lit("a"), F.lit("b"))).alias("n_fields"))
    made = reports.run_report(metrics, settings)
    schema = ("date string, result string, metrics struct<total:bigint,started:string,ended:string,seconds:double>, "
              "settings struct<login_url:string,n_fields:int>")
    read = made.select("user_id", F.from_json("report", schema).alias("r"))
    return read.select("user_id", "r.metrics.total", "r.metrics.seconds", "r.result", "r.date", "r.metrics.started", "r.settings.n_fields")
