"""The whole path: message -> route -> catalog -> result page -> match -> upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlane.functions import text
from coverlane.operators import catalog, matching, messages, ordered, pages, reports, sessions, upsert
from coverlane.plans.catalog import portal_catalog
from coverlane.plans.logs import walk_sql
from coverlane.plans.pages import AD_SQL, FOOTER_SQL, H1_SQL, HREFS_SQL, NAV_SQL, TITLE_SQL, result_pages
from coverlane.plans.registry import query, spread_table, table
from coverlane.session import settle

# One message per order; urgent orders name a stored invoice, high ones carry no ids,
# medium ones come inside a batch with a second client who is not in the catalog, the
# unspecified lack a document number, and the low ones are no valid JSON.
CLIENT = """concat('{"NombreCompleto":"NATION_', o_custkey % 30, '","IdFactura":', CASE o_orderpriority WHEN '1-URGENT' THEN CAST(o_custkey AS VARCHAR(20))
   WHEN '2-HIGH' THEN 'null' ELSE CAST(1000000000 + o_custkey AS VARCHAR(20)) END,
 ',"IdAseguradora":7,"FechaProcesamiento":"', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), '","NumDocIdentidad":"',
 CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE CAST(o_custkey AS VARCHAR(20)) END, '","PersonaPrimerNombre":" CUSTOMER#', lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0'), '"}')"""
BODY = f"""CASE WHEN o_orderpriority = '3-MEDIUM' THEN concat('{{"Clientes":[', {CLIENT}, ',{{"NombreCompleto":"NOBODY"}}],"Origen":"x"}}')
 WHEN o_orderpriority = '5-LOW' THEN concat({CLIENT}, ' junk') ELSE {CLIENT} END"""


def inbox(spark, sf_dir):
    return spread_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("delivery_tag"), F.expr(BODY).alias("body"))


def invoice_table(spark, sf_dir):
    blank = {c: F.lit("") for c in ("first_name", "second_name", "first_surname", "second_surname")}
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("id"), F.col("c_custkey").alias("invoice_id"),
        F.lit(7).cast("long").alias("insurer_id"), F.col("c_custkey").cast("string").alias("doc_id"), F.lit("old").alias("policy_no"),
        F.lit("").alias("dependent_no"), F.lit(None).cast("timestamp").alias("created_at"),
        F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1).cast("byte").alias("status")).withColumns(blank)


def matched_clients(spark, sf_dir):
    clients = messages.named(messages.typed(messages.flatten(messages.parse(inbox(spark, sf_dir)))))
    known = catalog.enrich(clients, portal_catalog(spark, sf_dir))
    rows = pages.result_rows(pages.with_elements(result_pages(spark, sf_dir)), "Grid")
    found = matching.named_rows(rows.select(F.col("page_id").cast("string").alias("page_key"), "row_idx", "cells"))
    hits = matching.match(known.withColumn("page_key", F.col("doc_id")), found, strict=True)
    return hits.select("delivery_tag", "pos", "invoice_id", "insurer_id", "doc_id", "first_name", "second_name", "first_surname",
                       "second_surname", "hit.policy_no", "hit.dependent_no")


@query("membership_check", """
WITH m AS (SELECT o_orderkey AS tag, o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN o_custkey WHEN '2-HIGH' THEN NULL
    ELSE 1000000000 + o_custkey END AS invoice_id, c_nationkey
  FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW') AND o_custkey % 30 < 25 AND c_acctbal > 5000),
s AS (SELECT tag, invoice_id, 7 AS insurer_id, CAST(o_custkey AS VARCHAR) AS doc_id, concat(' CUSTOMER#', lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AS first_name,
  CAST(o_custkey AS VARCHAR) AS policy_no, concat('C', c_nationkey) AS dependent_no FROM m),
keyed AS (SELECT invoice_id, min(tag) AS tag, any_value(doc_id) AS doc_id, any_value(first_name) AS first_name,
  max_by(policy_no, tag) AS policy_no, max_by(dependent_no, tag) AS dependent_no FROM s WHERE invoice_id <> 0 GROUP BY 1),
t AS (SELECT concat('C', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS id, c_custkey AS invoice_id, CAST(c_custkey AS VARCHAR) AS doc_id,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS status FROM customer)
SELECT t.id, t.invoice_id, t.doc_id, '' AS first_name, coalesce(k.policy_no, 'old') AS policy_no, coalesce(k.dependent_no, '') AS dependent_no, t.status
FROM t LEFT JOIN keyed k ON k.invoice_id = t.invoice_id AND t.status = 1
UNION ALL SELECT md5(concat(tag, '-0')), invoice_id, doc_id, first_name, policy_no, dependent_no, 1 FROM keyed
  WHERE invoice_id NOT IN (SELECT invoice_id FROM t WHERE status = 1)
UNION ALL SELECT md5(concat(tag, '-0')), invoice_id, doc_id, first_name, policy_no, dependent_no, 1 FROM s WHERE coalesce(invoice_id, 0) = 0""")
def membership_check(spark, sf_dir):
    after = upsert.upsert(matched_clients(spark, sf_dir), invoice_table(spark, sf_dir), F.lit(None).cast("timestamp"))
    return after.select("id", "invoice_id", "doc_id", "first_name", "policy_no", "dependent_no", F.col("status").cast("int").alias("status"))


WEEK = 7 * 86400


@query("membership_outcomes", walk_sql(f"""
SELECT o_custkey % 30 AS user_id, {WEEK} AS ttl, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400000000 AS t,
  o_orderkey * 1000 AS seq, true AS opens, o_orderpriority <> '4-NOT SPECIFIED' AS closes, false AS reset
FROM orders JOIN nation ON n_name = concat('NATION_', o_custkey % 30) WHERE n_regionkey < 2 AND o_orderpriority <> '5-LOW'""", """
SELECT o_orderkey AS delivery_tag, 0 AS pos, CASE WHEN n_name IS NULL THEN 'no_url' WHEN n_regionkey >= 2 THEN 'ok' WHEN w.phase = 'login' THEN 'ok'
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'capture_failed' ELSE 'ok' END AS outcome
FROM orders LEFT JOIN nation ON n_name = concat('NATION_', o_custkey % 30) LEFT JOIN walk w ON w.user_id = o_custkey % 30 AND w.seq = o_orderkey * 1000
WHERE o_orderpriority <> '5-LOW'
UNION ALL SELECT o_orderkey, 1, 'no_url' FROM orders WHERE o_orderpriority = '3-MEDIUM'"""))
def membership_outcomes(spark, sf_dir):
    """What became of each client of the inbox: insurers of two regions keep a portal
    session for a week, and a client without document number cannot be captured."""
    clients = messages.typed(messages.flatten(messages.parse(inbox(spark, sf_dir))))
    known = catalog.enrich(clients, portal_catalog(spark, sf_dir), how="left")
    rows = known.select(
        "delivery_tag", "pos", "insurer_name", F.col("catalog").isNotNull().alias("has_url"),
        F.coalesce(F.col("catalog.description").cast("int") < 2, F.lit(False)).alias("needs_session"),
        (F.unix_date(F.to_date("processed_on")).cast("long") * 86_400_000_000).alias("t"), F.lit(True).alias("opens"),
        reports.can_capture(F.lit(1), F.col("doc_id")).alias("closes"), F.lit(False).alias("reset"))
    # Read three times below (heavy keys, the fold, the rest), parsed once.
    rows = settle(rows, "clients")
    in_session = text.has_value("insurer_name") & F.col("has_url") & F.col("needs_session")
    # Clients of one insurer are numbered in handling order, however many a message has.
    by = ordered.Ordering(("insurer_name",), ("t", "delivery_tag", "pos"), F.struct("t", F.floor(F.col("delivery_tag") / 100_000)))
    numbered = ordered.row_position(ordered.cut_hot(rows.filter(in_session), by), "seq").df.drop(ordered.SLICE)
    held = sessions.phases(numbered, "insurer_name", WEEK, keep=("delivery_tag", "pos", "has_url", "needs_session"))
    rest = rows.filter(~in_session).withColumn("phase", F.lit(sessions.NONE))
    every = held.unionByName(rest, allowMissingColumns=True)
    result = reports.outcome(F.col("insurer_name"), F.col("has_url"), F.col("needs_session"), F.col("phase"), F.col("closes"))
    return every.select("delivery_tag", "pos", result.alias("outcome"))


@query("scrape_flow", f"""
WITH t AS (SELECT page_id, page_id % 4 AS kind, url, html FROM pages UNION ALL SELECT page_id, page_id % 4, url, html FROM pages WHERE page_id % 10 = 0
  UNION ALL SELECT page_id, 1, 'https://none/' || page_id, NULL FROM pages WHERE page_id % 7 = 0),
p AS (SELECT t.page_id, kind, t.url, n.html FROM t LEFT JOIN (SELECT url, max_by(html, page_id) AS html FROM pages GROUP BY 1) n ON n.url = t.url)
SELECT page_id, url, coalesce({TITLE_SQL}, '') AS title, CASE WHEN html IS NULL THEN 'page was not captured' ELSE '' END AS error_message,
  CAST(CASE WHEN html IS NOT NULL THEN 200 END AS INTEGER) AS status_code,
  CASE WHEN html IS NULL THEN NULL WHEN kind = 1 THEN {H1_SQL} WHEN kind = 2 THEN {AD_SQL} WHEN kind = 3 THEN '' END AS one,
  CASE WHEN html IS NULL THEN NULL WHEN kind = 2 THEN {NAV_SQL} WHEN kind = 3 THEN {FOOTER_SQL} END AS two,
  CASE WHEN html IS NOT NULL AND kind = 0 THEN len(list_slice({HREFS_SQL}, 1, 10)) END AS n_links FROM p""")
def scrape_flow(spark, sf_dir):
    """Scrape tasks with selectors of their own, end to end: task, page, selection or links, record."""
    source = table(spark, sf_dir, "pages")
    maps = {1: {"one": "h1"}, 2: {"one": "div.ad", "two": "nav ul > li a"}, 3: {"one": "#none", "two": "footer"}}
    selectors = F.create_map().cast(messages.MAP_TYPE)
    for kind, chosen in maps.items():
        pairs = F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair])
        selectors = F.when(F.col("kind") == kind, pairs).otherwise(selectors)
    kind = (F.col("page_id") % 4).alias("kind")
    asked = (source.select("page_id", "url", kind).unionAll(source.where("page_id % 10 = 0").select("page_id", "url", kind))
             .unionAll(source.where("page_id % 7 = 0").select("page_id", F.concat(F.lit("https://none/"), "page_id").alias("url"), F.lit(1).cast("long"))))
    inbox = messages.make_tasks(asked, selectors=selectors, created=F.lit(0.0)).select(F.col("page_id").alias("delivery_tag"), "body")
    tasks = messages.read_tasks(inbox).filter(F.col("disposition") == messages.ACK)
    scraped = pages.scrape(tasks.select("delivery_tag", "url", "rendered", "selectors"), source)
    records = messages.scrape_records(scraped, F.lit(0).cast("long"), F.lit(1_500_000).cast("long"), keep=("delivery_tag",))
    made = F.from_json("extracted", "extracted map<string,string>, links array<string>")
    return records.select(F.col("delivery_tag").alias("page_id"), "url", "title", "error_message", "status_code",
                          made["extracted"]["one"].alias("one"), made["extracted"]["two"].alias("two"),
                          F.when(made["links"].isNotNull(), F.size(made["links"])).cast("long").alias("n_links"))
