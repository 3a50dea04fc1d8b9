"""Message routing, flattening, defaults, names, tasks and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlane.functions import text
from coverlane.operators import messages, rules
from coverlane.plans.registry import query, table

# The bodies are made by one expression that both engines read, so that each side parses
# the same text in its own way.
BODY = """CASE event_id % 9
 WHEN 0 THEN concat('{"NombreCompleto":"', event_type, '","IdFactura":', event_id, '}')
 WHEN 1 THEN concat(' {"Clientes":[{"NombreCompleto":"', event_type, '"},', props, '],"Version":"1"}')
 WHEN 2 THEN concat(props, ' junk')
 WHEN 3 THEN concat('[', event_id, ',', props, ']')
 WHEN 4 THEN CAST(event_id AS VARCHAR(20))
 WHEN 5 THEN props
 WHEN 6 THEN '{"NombreCompleto":null}'
 WHEN 7 THEN concat('{"Clientes":', props, '}')
 ELSE concat('"', event_type, '"') END"""


@query("msg_route", f"""
WITH b AS (SELECT event_id, {BODY} AS body FROM events),
k AS (SELECT event_id, body, CASE WHEN json_valid(body) THEN json_type(body) END AS kind FROM b),
r AS (SELECT event_id, CASE
  WHEN kind IS NULL THEN 'bad_json'
  WHEN kind = 'OBJECT' AND list_contains(json_keys(body), 'NombreCompleto') THEN 'single'
  WHEN kind = 'OBJECT' AND json_type(body, '$.Clientes') = 'ARRAY' THEN 'batch'
  WHEN kind IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN 'unrecognized'
  ELSE 'rejected' END AS route FROM k)
SELECT route, CASE WHEN route = 'rejected' THEN 'dead_letter' ELSE 'ack' END AS disposition,
  count(*) AS n, max(event_id) AS last_tag
FROM r GROUP BY 1, 2""")
def msg_route(spark, sf_dir):
    inbox = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("delivery_tag"), F.encode(F.expr(BODY), "UTF-8").alias("body"))
    parsed = messages.parse(inbox)
    return parsed.groupBy("route", "disposition").agg(
        F.count("*").alias("n"), F.max("delivery_tag").alias("last_tag"))


BATCH = 50


@query("msg_flatten", f"""
SELECT event_id // {BATCH} AS delivery_tag, count(*) AS n_clients,
  count(*) FILTER (WHERE event_type <> 'view') AS n_ok,
  min_by(concat('U', user_id), event_id) AS first_doc, max_by(concat('U', user_id), event_id) AS last_doc
FROM events GROUP BY 1""")
def msg_flatten(spark, sf_dir):
    """Batches of 50 clients as JSON, taken apart again."""
    events = table(spark, sf_dir, "events")
    client = F.struct(
        "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("NombreCompleto"),
        F.concat(F.lit("U"), F.col("user_id")).alias("NumDocIdentidad"))
    bodies = events.groupBy(F.floor(F.col("event_id") / BATCH).alias("delivery_tag")).agg(
        F.to_json(F.struct(F.array_sort(F.collect_list(client)).alias("Clientes"))).alias("body"))
    clients = messages.typed(messages.flatten(messages.parse(bodies)))
    counts = messages.batch_counts(clients, text.has_value("insurer_name"))
    ends = clients.groupBy("delivery_tag").agg(
        F.min_by("doc_id", "pos").alias("first_doc"), F.max_by("doc_id", "pos").alias("last_doc"))
    return counts.join(ends, "delivery_tag")


K_BODY = """CASE event_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{"k":null}' WHEN 2 THEN '{"k":""}' ELSE props END"""


@query("default_fields", f"""
WITH b AS (SELECT event_id, event_type, {K_BODY} AS body FROM events)
SELECT event_id, CASE WHEN json_exists(body, '$.k') THEN body ->> '$.k' ELSE 'none' END AS kept,
  coalesce(nullif(body ->> '$.k', ''), 'N/A') AS shown,
  coalesce(nullif(body ->> '$.k', ''), nullif(event_type, ''), '') AS filled
FROM b""")
def default_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("body", F.expr(K_BODY))
    fields = rows.withColumn("m", F.from_json("body", messages.MAP_TYPE))
    value = F.col("m")["k"]
    return fields.select("event_id", text.field("m", "k", "none").alias("kept"), text.shown(value, "N/A").alias("shown"),
                         text.first_filled(value, F.col("event_type")).alias("filled"))


PARTS = {
    "p1": "concat(' ', substr(c_name, 1, 4), '\u00a0')",
    "p2": "CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE lower(c_mktsegment) END",
    "p3": "concat('\t', 'ñandú', '  ', substr(c_name, 5, 5))",
    "p4": "CASE WHEN c_acctbal < 0 THEN NULL ELSE concat('\u00a0', CAST(c_nationkey AS VARCHAR(9)), ' ') END",
}
BLANK_RE2 = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def _strip_sql(value: str) -> str:
    return f"regexp_replace({value}, '^{BLANK_RE2}|{BLANK_RE2}$', '', 'g')"


@query("full_name", f"""
WITH p AS (SELECT c_custkey, {", ".join(f"{e} AS {n}" for n, e in PARTS.items())} FROM customer),
f AS (SELECT c_custkey, nullif({_strip_sql(" || ' ' || ".join(_strip_sql(f"p{i}") for i in range(1, 5)))}, '') AS full_name FROM p)
SELECT c_custkey, full_name, upper(trim(regexp_replace(full_name, '{BLANK_RE2}', ' ', 'g'))) AS norm_name FROM f""")
def full_name(spark, sf_dir):
    parts = table(spark, sf_dir, "customer").select("c_custkey", *[F.expr(e).alias(n) for n, e in PARTS.items()])
    named = parts.withColumn("full_name", text.full_name(*PARTS))
    return named.select("c_custkey", "full_name", text.fold_name("full_name").alias("norm_name"))


@query("tasks", """
WITH t AS (SELECT page_id, CASE WHEN lang = 'en' THEN '' ELSE url END AS url FROM
  (SELECT page_id, url, regexp_extract(html, 'html lang="([a-z]+)"', 1) AS lang FROM pages)),
d AS (SELECT *, CASE WHEN url <> '' THEN 'ack' WHEN page_id % 3 = 2 THEN 'dead_letter' ELSE 'retry' END AS disposition FROM t)
SELECT disposition, count(*) AS n, count(*) FILTER (WHERE url <> '') AS n_urls, CAST(sum(length(url)) AS BIGINT) AS url_chars,
  count(*) FILTER (WHERE url <> '') AS n_selectors
FROM d GROUP BY 1""")
def tasks(spark, sf_dir):
    """Scrape tasks made from page addresses (some blank), read back, with a cap of 3 attempts."""
    pages = table(spark, sf_dir, "pages")
    lang = F.regexp_extract("html", 'html lang="([a-z]+)"', 1)
    urls = pages.select("page_id", F.when(lang == "en", "").otherwise(F.col("url")).alias("url"))
    selectors = F.when(F.col("url") != "", F.create_map(F.lit("head"), F.lit("h1")))
    made = messages.make_tasks(urls, selectors=selectors, created=F.lit(0.0)).select("page_id", "body")
    read = messages.read_tasks(made, attempt=F.col("page_id") % 3, max_attempts=3)
    return read.groupBy("disposition").agg(
        F.count("*").alias("n"), F.count_if(text.has_value("url")).alias("n_urls"),
        F.sum(F.length("url")).alias("url_chars"), F.count_if(F.size("selectors") > 0).alias("n_selectors"))


@query("envelopes", """
SELECT e.event_id, n.n_name AS insurer, strftime(e.ts, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN microsecond(e.ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(microsecond(e.ts) % 1000000 AS VARCHAR), 6, '0') END AS done_at,
  e.event_type <> 'error' AS session_active
FROM events e JOIN nation n ON n.n_name = concat('NATION_', e.user_id % 40)""")
def envelopes(spark, sf_dir):
    """The combined result kept for each message whose insurer is in the catalog."""
    from coverlane.operators import catalog
    from coverlane.plans.catalog import portal_catalog

    events = table(spark, sf_dir, "events").withColumn("insurer_name", F.concat(F.lit("NATION_"), F.col("user_id") % 40))
    known = catalog.enrich(events, portal_catalog(spark, sf_dir))
    message = F.struct("event_id", "insurer_name")
    done = messages.envelope(known, message, F.col("catalog"), F.col("ts"), F.col("event_type") != "error")
    return done.select("event_id", F.col("result.catalog.name").alias("insurer"),
                       F.col("result.done_at").alias("done_at"), F.col("result.session_active").alias("session_active"))


@query("scalars", """
SELECT event_id,
  len(CASE WHEN event_type = 'view' THEN CAST([] AS VARCHAR[]) ELSE string_split(replace(event_type || '-x', 'c', ','), ',') END) AS n_parts,
  lower(CASE WHEN event_type = 'error' THEN 'false' WHEN event_type = 'click' THEN 'TRUE' ELSE 'true' END) = 'true' AS is_on,
  coalesce(TRY_CAST(nullif(CASE WHEN event_type = 'view' THEN '' ELSE regexp_extract(props, '[0-9]+') END, '') AS INTEGER),
    CASE WHEN event_type = 'view' THEN 7 END) AS k,
  left(event_type, 3) AS short,
  array_to_string(list_sort(json_keys(concat('{"z":1,', substr(props, 2)))), ',') AS keys,
  concat('{"user":', user_id, ',"kind":"', event_type, '"}') AS as_json,
  event_type || ':' || user_id AS label
FROM events""")
def scalars(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    parts = text.comma_list(F.when(kind == "view", "").otherwise(F.replace(F.concat(kind, F.lit("-x")), F.lit("c"), F.lit(","))))
    switch = F.when(kind == "error", "false").when(kind == "click", "TRUE")
    digits = F.when(kind == "view", "").otherwise(F.regexp_extract("props", "[0-9]+", 0))
    keys = F.map_keys(F.from_json(F.concat(F.lit('{"z":1,'), F.substr("props", F.lit(2))), messages.MAP_TYPE))
    return events.select(
        "event_id", F.size(parts).cast("long").alias("n_parts"), text.flag(switch, "true", "true").alias("is_on"),
        text.number(digits, "int", 7).alias("k"), text.prefix(kind, 3).alias("short"),
        F.array_join(F.array_sort(keys), ",").alias("keys"),
        F.to_json(F.struct(F.col("user_id").alias("user"), kind.alias("kind"))).alias("as_json"),
        F.concat(kind, F.lit(":"), F.col("user_id")).alias("label"))


@query("rules", """
WITH s AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS host, CASE WHEN c_nationkey < 5 THEN '' ELSE c_name END AS database,
  CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 1000 THEN 0 ELSE c_acctbal END AS delay FROM customer)
SELECT c_custkey, concat_ws(';', CASE WHEN host IS NULL THEN 'host is not set' END,
  CASE WHEN database = '' THEN 'database is not set' END, CASE WHEN delay IS NULL THEN 'delay is not set' END) AS errors,
  host IS NOT NULL AND database <> '' AND delay IS NOT NULL AS valid FROM s""")
def rules_required(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    balance = F.col("c_acctbal")
    settings = customer.select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("host"),
        F.when(F.col("c_nationkey") < 5, "").otherwise(F.col("c_name")).alias("database"),
        F.when(balance >= 1000, balance).when(balance >= 0, 0.0).alias("delay"))
    found = rules.missing_settings(["host", "database"], ["delay"])
    return settings.withColumn("e", found).select("c_custkey", F.array_join("e", ";").alias("errors"), rules.is_valid(F.col("e")).alias("valid"))


@query("rules_insurer", """
SELECT s_suppkey, concat_ws(';', CASE WHEN s_acctbal < 0 THEN 'name is not set' END, CASE WHEN s_nationkey = 3 THEN 'target_url is not set' END,
  CASE WHEN s_nationkey < 8 THEN 'login field without selector' END,
  CASE WHEN s_acctbal < 500 THEN 'login field without value' END, CASE WHEN s_nationkey = 0 THEN 'page_load is not set' END) AS errors
FROM supplier""")
def rules_insurer(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    low = F.col("s_acctbal") < 500
    one = F.struct(F.when(F.col("s_nationkey") >= 8, "#user").alias("selector"), F.lit("x").alias("value"), F.lit(True).alias("required"))
    two = F.struct(F.lit("#pass").alias("selector"), F.when(low, "").otherwise("x").alias("value"), F.lit(True).alias("required"))
    three = F.struct(F.lit("#note").alias("selector"), F.lit("").alias("value"), F.lit(False).alias("required"))
    settings = supplier.select(
        "s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("name"), F.lit("https://a").alias("login_url"),
        F.when(F.col("s_nationkey") != 3, "https://b").alias("target_url"), F.array(one, two, three).alias("fields"),
        F.col("s_nationkey").alias("page_load"))
    return settings.select("s_suppkey", F.array_join(rules.insurer_errors(F.col("fields"), ["page_load"]), ";").alias("errors"))


@query("rules_limits", """
SELECT p_partkey, concat_ws(';', CASE WHEN length(p_name) > 10 THEN 'p_name is longer than 10' END,
  CASE WHEN length(p_type) > 6 THEN 'p_type is longer than 6' END) AS errors
FROM part WHERE length(p_name) > 10 OR length(p_type) > 6""")
def rules_limits(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    _, rejected = rules.split_rejects(part, rules.limit_errors(part, {"p_name": 10, "p_type": 6}))
    return rejected.select("p_partkey", F.array_join("errors", ";").alias("errors"))
