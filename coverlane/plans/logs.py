"""Sessions and navigation logs, on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlane.functions import text
from coverlane.operators import navigation, ordered, reports, sessions
from coverlane.plans.registry import query, table

HOUR, DAY = 3600, 86400


def by_user(events) -> ordered.Ordering:
    """Events of a user in time order; a user with very many events is cut by minute."""
    minute = F.floor(text.micros(events, "ts") / 60_000_000)
    return ordered.Ordering(("user_id",), ("ts", "event_id"), minute)


def walk_sql(steps: str, tail: str) -> str:
    """The session rules walked row by row for each ``(user_id, ttl)``."""
    return f"""
WITH RECURSIVE steps AS ({steps}),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, ttl ORDER BY t, seq) AS rn FROM steps),
walk AS (
  SELECT user_id, ttl, rn, t, seq,
    CASE WHEN reset THEN 'reset' WHEN opens THEN 'login' ELSE 'none' END AS phase,
    CASE WHEN opens AND NOT reset THEN t END AS used_t, CASE WHEN opens AND NOT reset THEN seq END AS used_seq,
    CASE WHEN opens AND NOT reset THEN t END AS live_t, CASE WHEN opens AND NOT reset THEN seq END AS live_seq
  FROM n WHERE rn = 1
  UNION ALL
  SELECT n.user_id, n.ttl, n.rn, n.t, n.seq,
    CASE WHEN n.reset THEN 'reset' WHEN w.live_t IS NULL THEN CASE WHEN n.opens THEN 'login' ELSE 'none' END
      WHEN n.closes AND n.t - w.live_t > n.ttl * 1000000::BIGINT THEN 'late' ELSE 'live' END,
    CASE WHEN n.reset THEN NULL WHEN w.live_t IS NULL THEN CASE WHEN n.opens THEN n.t END ELSE w.live_t END,
    CASE WHEN n.reset THEN NULL WHEN w.live_t IS NULL THEN CASE WHEN n.opens THEN n.seq END ELSE w.live_seq END,
    CASE WHEN n.reset THEN NULL WHEN w.live_t IS NULL THEN CASE WHEN n.opens THEN n.t END
      WHEN n.closes AND n.t - w.live_t > n.ttl * 1000000::BIGINT THEN NULL ELSE w.live_t END,
    CASE WHEN n.reset THEN NULL WHEN w.live_t IS NULL THEN CASE WHEN n.opens THEN n.seq END
      WHEN n.closes AND n.t - w.live_t > n.ttl * 1000000::BIGINT THEN NULL ELSE w.live_seq END
  FROM walk w JOIN n ON n.user_id = w.user_id AND n.ttl = w.ttl AND n.rn = w.rn + 1)
{tail}"""


STEPS_SQL = """SELECT user_id, ttl, epoch_us(ts) AS t, event_id AS seq, value >= 2 AS opens, event_type <> 'error' AS closes,
 event_type = 'signup' AS reset FROM events, (VALUES (3600), (86400)) v(ttl)"""
SUMMARY_SQL = """SELECT ttl, user_id, used_t AS login_t, used_seq AS login_seq, count(*) AS n_rows,
 max(CASE WHEN phase = 'late' THEN seq END) AS late_seq, max(t) AS last_t FROM walk WHERE used_seq IS NOT NULL GROUP BY 1, 2, 3, 4"""


def _steps(events):
    return events.select(
        "user_id", text.micros(events, "ts").alias("t"), F.col("event_id").alias("seq"), (F.col("value") >= 2).alias("opens"),
        (F.col("event_type") != "error").alias("closes"), (F.col("event_type") == "signup").alias("reset"))


@query("session_ttl", walk_sql(STEPS_SQL, SUMMARY_SQL))
def session_ttl(spark, sf_dir):
    """Sessions of each user for two lifetimes; sign-ups drop the session."""
    steps = _steps(table(spark, sf_dir, "events"))
    runs = [sessions.summary(sessions.phases(steps, "user_id", ttl), "user_id").withColumn("ttl", F.lit(ttl)) for ttl in (HOUR, DAY)]
    return runs[0].unionByName(runs[1]).select("ttl", "user_id", "login_t", "login_seq", "n_rows", "late_seq", "last_t")


@query("active_sessions", walk_sql(STEPS_SQL, """
SELECT user_id, live_t AS login_t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS back FROM walk WHERE ttl = 86400)
WHERE back = 1 AND live_t IS NOT NULL"""))
def active_sessions(spark, sf_dir):
    steps = _steps(table(spark, sf_dir, "events"))
    return sessions.active_at_end(sessions.phases(steps, "user_id", DAY), "user_id")


@query("nav_dwell", walk_sql("""SELECT user_id, ttl, epoch_us(ts) AS t, event_id AS seq, event_type = 'error' AS opens,
 event_type = 'error' AS closes, event_type = 'click' AS reset FROM events, (VALUES (30), (86400)) v(ttl) WHERE event_type IN ('error', 'click')""",
    """SELECT ttl, user_id, count(*) FILTER (WHERE phase = 'login') AS n_started, count(*) FILTER (WHERE phase = 'late') AS n_fired,
 max(CASE WHEN phase = 'late' THEN seq END) AS last_fired FROM walk GROUP BY 1, 2"""))
def nav_dwell(spark, sf_dir):
    """Stay timer of the error state, with clicks as resets."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "click"))
    log = events.select("user_id", text.micros(events, "ts").alias("t"), F.col("event_id").alias("seq"),
                        (F.col("event_type") == "click").alias("reset"))
    out = None
    for limit in (30, DAY):
        fired = F.col("phase") == sessions.LATE
        part = navigation.stays(log, "user_id", limit).groupBy("user_id").agg(
            F.count_if(F.col("phase") == sessions.LOGIN).alias("n_started"), F.count_if(fired).alias("n_fired"),
            F.max(F.when(fired, F.col("seq"))).alias("last_fired")).withColumn("ttl", F.lit(limit))
        out = part if out is None else out.unionByName(part)
    return out


NAME_SQL = "CASE WHEN event_type = 'view' THEN '' ELSE event_type END"


@query("outcomes", walk_sql("""SELECT user_id, 86400 AS ttl, epoch_us(ts) AS t, event_id AS seq, value >= 20 AS opens,
 event_type = 'click' OR (event_type <> 'error' AND value <= 300) AS closes, false AS reset FROM events WHERE event_type NOT IN ('view', 'purchase') AND value >= 1""", f"""
SELECT e.event_id, CASE WHEN {NAME_SQL} = '' THEN 'no_name' WHEN e.value < 1 THEN 'no_url' WHEN e.event_type = 'purchase' THEN 'ok'
  WHEN w.phase = 'login' THEN 'ok' WHEN w.phase = 'none' THEN 'login_failed'
  WHEN e.event_type <> 'click' AND (e.event_type = 'error' OR e.value > 300) THEN 'capture_failed' ELSE 'ok' END AS outcome
FROM events e LEFT JOIN walk w ON w.user_id = e.user_id AND w.seq = e.event_id"""))
def outcomes(spark, sf_dir):
    """One outcome per message. Purchases need no session, clicks have no fields to capture;
    a failed capture only counts on a session that was already running."""
    return _outcomes(table(spark, sf_dir, "events")).select("event_id", "outcome")


def _outcomes(events):
    kind = F.col("event_type")
    n_fields = F.when(kind == "click", 0).otherwise(2)
    doc_id = F.when((kind == "error") | (F.col("value") > 300), "").otherwise(F.concat(F.lit("D"), F.col("user_id")))
    rows = events.select(
        "event_id", "user_id", text.micros(events, "ts").alias("t"), F.col("event_id").alias("seq"),
        F.when(kind == "view", "").otherwise(kind).alias("name"), (F.col("value") >= 1).alias("has_url"),
        (kind != "purchase").alias("needs_session"), (F.col("value") >= 20).alias("opens"),
        reports.can_capture(n_fields, doc_id).alias("closes"), F.lit(False).alias("reset"))
    in_session = text.has_value("name") & F.col("has_url") & F.col("needs_session")
    kept = ("event_id", "name", "has_url", "needs_session")
    held = sessions.phases(rows.filter(in_session), "user_id", DAY, keep=kept)
    rest = rows.filter(~in_session).withColumn("phase", F.lit(sessions.NONE))
    every = held.unionByName(rest, allowMissingColumns=True)
    result = reports.outcome(F.col("name"), F.col("has_url"), F.col("needs_session"), F.col("phase"), F.col("closes"))
    return every.withColumn("outcome", result)


@query("worker_status", """
SELECT count(*) FILTER (WHERE event_type <> 'view') AS processed, count(*) FILTER (WHERE event_type = 'view') AS unprocessed,
  round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0, 3) AS uptime_seconds FROM events""")
def worker_status(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    handled = F.col("event_type") != "view"
    return reports.worker_status(events, text.micros(events, "ts"), handled)


@query("queue_status", """
WITH m AS (SELECT max(CAST(ts AS DATE)) AS last_day FROM events)
SELECT count(*) FILTER (WHERE CAST(ts AS DATE) < last_day) AS processed, count(*) FILTER (WHERE CAST(ts AS DATE) >= last_day) AS pending FROM events, m""")
def queue_status(spark, sf_dir):
    """Everything before the last day counts as done, the last day as still queued."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    last = events.agg(F.max("day")).scalar()
    return reports.queue_status(events, F.col("day") < last)


@query("active_set", """
WITH a AS (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events))
SELECT user_id, count(*) AS n_events, max(event_id) AS last_event FROM events WHERE user_id IN (SELECT user_id FROM a) GROUP BY 1""")
def active_set(spark, sf_dir):
    """Users seen on the last day, and all their events."""
    from coverlane.operators import catalog

    events = table(spark, sf_dir, "events")
    last = events.agg(F.max(F.to_date("ts"))).scalar()
    seen = events.filter(F.to_date("ts") == last).select("user_id").distinct()
    # Counted before the join, so that a heavy user is one row by then.
    totals = events.groupBy("user_id").agg(F.count("*").alias("n_events"), F.max("event_id").alias("last_event"))
    return catalog.only_known(totals, seen, "user_id")


@query("cache_contents", """
SELECT DISTINCT event_type, (SELECT count(DISTINCT event_type) FROM events) AS n FROM events WHERE event_type IS NOT NULL""")
def cache_contents(spark, sf_dir):
    return reports.name_list(table(spark, sf_dir, "events"), "event_type")


@query("nav_changes", """
SELECT user_id, event_id, prev_value, event_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value FROM events)
WHERE prev_value IS NOT NULL AND prev_value <> event_type""")
def nav_changes(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = navigation.changes(events.select("user_id", "ts", "event_id", "event_type"), by_user(events), F.col("event_type"))
    return found.select("user_id", "event_id", "prev_value", "event_type")


@query("nav_first_change", """
WITH f AS (SELECT user_id, min_by(event_type, event_id) AS e0, min_by(props, event_id) AS p0, min(event_id) AS id0 FROM events GROUP BY 1),
r AS (SELECT e.user_id, e.event_id, CASE WHEN e.event_type <> e0 THEN 'url' WHEN e.props <> p0 THEN 'title' WHEN e.event_type = 'error' THEN 'error'
  WHEN e.value > 100 THEN 'inputs' END AS reason FROM events e JOIN f ON f.user_id = e.user_id AND e.event_id > f.id0)
SELECT user_id, min(event_id) AS event_id, min_by(reason, event_id) AS reason FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def nav_first_change(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return navigation.first_change(
        events.select("user_id", "ts", "event_id", "event_type", "props", "value"), by_user(events), [("event_type", "url"), ("props", "title")],
        [(F.col("event_type") == "error", "error"), (F.col("value") > 100, "inputs")]).select("user_id", "event_id", "reason")


@query("nav_final", """
SELECT user_id, max_by(CASE WHEN event_type LIKE '%sign%' THEN 'login' WHEN event_type LIKE '%view%' THEN 'portal'
  WHEN event_type LIKE '%purchase%' THEN 'search' ELSE 'other' END, event_id) AS final_state FROM events GROUP BY 1""")
def nav_final(spark, sf_dir):
    rules = [("sign", "login"), ("view", "portal"), ("purchase", "search")]
    return navigation.final_state(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], navigation.state(F.col("event_type"), rules))


@query("attempts", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events)
SELECT user_id, event_id, CAST(attempt AS INTEGER) AS attempt, CAST(least(2, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY attempt)) AS BIGINT) AS retries FROM n WHERE attempt <= 40""")
def attempts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kept = navigation.attempts(events, ["user_id"], ["ts", "event_id"], 40, F.col("event_type") == "error", 2)
    return kept.select("user_id", "event_id", "attempt", "retries")


@query("alerts", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (
  PARTITION BY user_id, event_type IN ('error', 'signup') ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT user_id, max(n) AS longest_run FROM (SELECT user_id, g, count(*) AS n FROM n WHERE event_type IN ('error', 'signup') GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT user_id, avg(CASE WHEN event_type IN ('error', 'signup') THEN 0.0 ELSE 1.0 END) AS rate, max(value) AS max_seconds FROM events GROUP BY 1)
SELECT a.user_id, round(rate, 6) AS success_rate, max_seconds, coalesce(longest_run, 0) AS longest_run, rate < 0.95 AS rate_alert,
  max_seconds > 30 AS duration_alert, coalesce(longest_run, 0) > 5 AS failure_alert FROM a LEFT JOIN r ON r.user_id = a.user_id""")
def alerts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return reports.alerts(events, by_user(events), ~F.col("event_type").isin("error", "signup"), F.col("value"))
