"""Catalog lookups, nested settings, name matching and the upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlane.operators import catalog, matching, plugins, upsert
from coverlane.plans.registry import query, spread_table, table

PAGE = 40


def portal_catalog(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"),
        F.concat(F.lit("https://"), F.lower("n_name"), F.lit("/login")).alias("login_url"),
        F.concat(F.lit("https://"), F.lower("n_name"), F.lit("/home")).alias("target_url"),
        F.col("n_regionkey").cast("string").alias("description"), F.lit(None).cast("timestamp").alias("created_at"))


@query("catalog_nested", f"""
WITH f AS (SELECT CAST(s_nationkey AS VARCHAR) AS url_id, s_name AS item,
    (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) - 1) // {PAGE} AS page, s_name AS o FROM supplier),
a AS (SELECT CAST(c_nationkey AS VARCHAR) AS url_id, c_mktsegment || '|' || c_name AS item,
    (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_name) - 1) // {PAGE} AS page FROM customer),
c AS (SELECT CAST(s_nationkey AS VARCHAR) AS url_id, s_name AS item,
    (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // {PAGE} AS page, s_suppkey AS o FROM supplier WHERE s_acctbal > 0),
spine AS (SELECT url_id, page FROM f UNION SELECT url_id, page FROM a UNION SELECT url_id, page FROM c
    UNION SELECT CAST(n_nationkey AS VARCHAR), 0 FROM nation)
SELECT s.url_id, n.n_name AS name, s.page,
  coalesce((SELECT string_agg(item || '=***', ',' ORDER BY o) FROM f WHERE f.url_id = s.url_id AND f.page = s.page), '') AS fields,
  coalesce((SELECT string_agg(item, ',' ORDER BY item) FROM a WHERE a.url_id = s.url_id AND a.page = s.page), '') AS actions,
  coalesce((SELECT string_agg(item, ',' ORDER BY o) FROM c WHERE c.url_id = s.url_id AND c.page = s.page), '') AS captures,
  (SELECT count(*) FROM a WHERE a.url_id = s.url_id AND a.page = s.page) AS n_actions
FROM spine s JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = s.url_id""")
def catalog_nested(spark, sf_dir):
    """Suppliers as login fields and capture fields, customers as actions of each nation."""
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    fields = supplier.select(F.col("s_nationkey").cast("string").alias("url_id"), F.col("s_name").alias("selector"),
                             F.col("s_acctbal").cast("string").alias("value"))
    captures = supplier.select(
        F.col("s_nationkey").cast("string").alias("url_id"), F.col("s_name").alias("field_name"), F.lit("input").alias("field_type"),
        F.lit("#q").alias("selector"), F.col("s_suppkey").alias("ord"), F.lit(True).alias("required"),
        (F.col("s_acctbal") > 0).alias("active"), F.lit("#go").alias("submit_selector"))
    actions = customer.select(F.col("c_nationkey").cast("string").alias("url_id"), F.col("c_mktsegment").alias("action_type"),
                              F.col("c_name").alias("selector"), F.lit(None).cast("string").alias("value"))
    # Cuts for a nation that holds very many rows: leading characters, or ranges of the number.
    nested = catalog.nested(portal_catalog(spark, sf_dir), {
        "fields": catalog.login_field_pages(fields, F.substring("selector", 1, 15), page_size=PAGE),
        "actions": catalog.action_pages(actions, F.struct("action_type", F.substring("selector", 1, 15)), page_size=PAGE),
        "captures": catalog.capture_field_pages(captures, F.floor(F.col("ord") / 100_000), page_size=PAGE)})
    return nested.select(
        "url_id", "name", "page",
        F.array_join(F.transform("fields", lambda f: F.concat(f["selector"], F.lit("="), f["value"])), ",").alias("fields"),
        F.array_join(F.transform("actions", lambda a: F.concat(a["action_type"], F.lit("|"), a["selector"])), ",").alias("actions"),
        F.array_join(F.transform("captures", lambda c: c["field_name"]), ",").alias("captures"),
        F.size("actions").cast("long").alias("n_actions"))


@query("catalog_missing", """
SELECT c_custkey, concat('NATION_', c_nationkey) AS insurer_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey < 3 AND n.n_name = concat('NATION_', c.c_nationkey))""")
def catalog_missing(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey")).alias("insurer_name"))
    known = portal_catalog(spark, sf_dir).filter(F.col("description").cast("int") < 3)
    return catalog.unmatched(asked, known).select("c_custkey", "insurer_name")


@query("first_input", """
SELECT CAST(s_nationkey AS VARCHAR) AS url_id, min_by(s_name, s_suppkey) AS field_name, min(s_suppkey) AS ord
FROM supplier WHERE s_acctbal > 0 AND s_nationkey <> 4 GROUP BY 1""")
def first_input(spark, sf_dir):
    fields = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("string").alias("url_id"), F.col("s_name").alias("field_name"),
        F.when(F.col("s_nationkey") == 4, "text").otherwise("INPUT").alias("field_type"),
        F.col("s_suppkey").alias("ord"), (F.col("s_acctbal") > 0).alias("active"))
    return catalog.first_input(fields).select("url_id", "field_name", "ord")


def _order_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    low = F.col("o_totalprice") < 200000
    status = F.when(F.col("o_orderstatus") == "F", "Activo VER").when(F.col("o_orderstatus") == "O", " Inactivo").otherwise("")
    return orders.select(
        F.col("o_custkey").alias("page_key"), F.col("o_orderkey").alias("row_idx"),
        F.concat(F.when(low, " customer #").otherwise("Customer# "), key).alias("patient"), status.alias("status"),
        F.concat(F.lit("P"), F.col("o_orderkey")).alias("policy_no"), F.col("o_orderpriority").alias("dependent_no"))


def _matches(spark, sf_dir, strict):
    clients = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("page_key"), F.replace("c_name", F.lit("#"), F.lit(" #")).alias("full_name"))
    found = matching.match(clients, _order_rows(spark, sf_dir), strict)
    return found.select(F.col("page_key").alias("c_custkey"), F.col("hit.row_idx").alias("row_idx"),
                        F.col("hit.policy_no").alias("policy_no"), F.col("hit.dependent_no").alias("dependent_no"))


def _match_sql(statuses: str) -> str:
    return f"""
SELECT c_custkey, o_orderkey AS row_idx, concat('P', o_orderkey) AS policy_no, o_orderpriority AS dependent_no FROM (
  SELECT c.c_custkey, o.*, row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_orderkey) AS rn
  FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
    AND c.c_name = concat('Customer#', lpad(CAST(o.o_custkey AS VARCHAR), 9, '0'))
  WHERE o.o_totalprice < 200000 AND o.o_orderstatus IN ({statuses})) WHERE rn = 1"""


@query("first_match", _match_sql("'F', 'O'"))
def first_match(spark, sf_dir):
    return _matches(spark, sf_dir, strict=False)


@query("first_match_strict", _match_sql("'F'"))
def first_match_strict(spark, sf_dir):
    return _matches(spark, sf_dir, strict=True)


@query("upsert", """
WITH target AS (SELECT concat('T', lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS id, o_custkey AS invoice_id, o_orderkey % 5 AS insurer_id,
    o_orderpriority AS doc_id, 'old' AS policy_no, '0' AS dependent_no, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS status FROM orders),
src AS (SELECT l_orderkey AS tag, CAST(l_linenumber AS BIGINT) * 1000000000000000000 + l_partkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS pos, l_partkey AS invoice_id,
    l_suppkey % 7 AS insurer_id, concat('D', l_suppkey) AS doc_id, concat(l_returnflag, l_partkey) AS policy_no, l_linestatus AS dependent_no FROM lineitem),
ranked AS (SELECT *, row_number() OVER (PARTITION BY invoice_id, insurer_id ORDER BY tag, pos) AS rf,
    row_number() OVER (PARTITION BY invoice_id, insurer_id ORDER BY tag DESC, pos DESC) AS rl FROM src WHERE invoice_id <> 0 AND insurer_id <> 0),
k AS (SELECT f.invoice_id, f.insurer_id, f.tag, f.pos, f.doc_id, l.policy_no, l.dependent_no FROM ranked f
    JOIN ranked l ON f.invoice_id = l.invoice_id AND f.insurer_id = l.insurer_id AND f.rf = 1 AND l.rl = 1),
e AS (SELECT invoice_id, insurer_id, min(id) AS id FROM target WHERE status = 1 AND invoice_id <> 0 AND insurer_id <> 0 GROUP BY 1, 2)
SELECT t.id, t.invoice_id, t.insurer_id, t.doc_id, coalesce(u.policy_no, t.policy_no) AS policy_no,
  coalesce(u.dependent_no, t.dependent_no) AS dependent_no, t.status
FROM target t LEFT JOIN (SELECT e.id, k.policy_no, k.dependent_no FROM e JOIN k USING (invoice_id, insurer_id)) u ON u.id = t.id
UNION ALL
SELECT md5(concat(tag, '-', pos)), invoice_id, insurer_id, doc_id, policy_no, dependent_no, 1 FROM k
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.invoice_id = k.invoice_id AND e.insurer_id = k.insurer_id)
UNION ALL
SELECT md5(concat(tag, '-', pos)), invoice_id, insurer_id, doc_id, policy_no, dependent_no, 1 FROM src
WHERE invoice_id = 0 OR insurer_id = 0""")
def upsert_orders(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), spread_table(spark, sf_dir, "lineitem")
    blank = {c: F.lit("") for c in ("first_name", "second_name", "first_surname", "second_surname")}
    target = orders.select(
        F.concat(F.lit("T"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("id"),
        F.col("o_custkey").alias("invoice_id"), (F.col("o_orderkey") % 5).alias("insurer_id"), F.col("o_orderpriority").alias("doc_id"),
        F.lit("old").alias("policy_no"), F.lit("0").alias("dependent_no"), F.lit(None).cast("timestamp").alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).cast("byte").alias("status")).withColumns(blank)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    pos = F.col("l_linenumber").cast("long") * 10**18 + F.col("l_partkey") * 10**8 + cents
    source = lines.select(
        F.col("l_orderkey").alias("delivery_tag"), pos.alias("pos"), F.col("l_partkey").alias("invoice_id"),
        (F.col("l_suppkey") % 7).alias("insurer_id"), F.concat(F.lit("D"), F.col("l_suppkey")).alias("doc_id"),
        F.concat(F.col("l_returnflag"), F.col("l_partkey")).alias("policy_no"), F.col("l_linestatus").alias("dependent_no")).withColumns(blank)
    after = upsert.upsert(source, target, F.lit(None).cast("timestamp"))
    return after.select("id", "invoice_id", "insurer_id", "doc_id", "policy_no", "dependent_no", F.col("status").cast("int").alias("status"))


@query("settings_edit", """
WITH e AS (SELECT concat('P', l_partkey) AS url_id, l_returnflag AS field_name, max(l_quantity) AS ord, 'edited' AS field_value FROM lineitem GROUP BY 1, 2),
s AS (SELECT concat('P', p_partkey) AS url_id, CASE WHEN p_size < 25 THEN 'A' ELSE 'Z' END AS field_name, CAST(p_size AS DOUBLE) AS ord, p_name AS field_value FROM part)
SELECT s.url_id, s.field_name, coalesce(e.ord, s.ord) AS ord, coalesce(e.field_value, s.field_value) AS field_value
FROM s LEFT JOIN e ON e.url_id = s.url_id AND e.field_name = s.field_name
UNION ALL SELECT url_id, field_name, ord, field_value FROM e
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.url_id = e.url_id AND s.field_name = e.field_name)""")
def settings_edit(spark, sf_dir):
    settings = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey")).alias("url_id"), F.when(F.col("p_size") < 25, "A").otherwise("Z").alias("field_name"),
        F.col("p_size").cast("double").alias("ord"), F.col("p_name").alias("field_value"))
    edits = table(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("url_id"), F.col("l_returnflag").alias("field_name")).agg(
        F.max("l_quantity").alias("ord")).withColumn("field_value", F.lit("edited"))
    return upsert.edit_settings(settings, edits, ("url_id", "field_name"), ("ord", "field_value"))


@query("registry", """
SELECT c.c_custkey, r.r_name IS NOT NULL AS known, r.r_name AS processor
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey AND r.r_name <> 'ASIA'""")
def registry(spark, sf_dir):
    """Regions as the registry, nations as codes; unknown codes stay, without an entry."""
    listed = plugins.listing(table(spark, sf_dir, "region").filter(F.col("r_name") != "ASIA").select(
        F.col("r_regionkey").alias("code"), F.col("r_name").alias("name"), F.lit("").alias("country"), F.lit(None).cast("boolean").alias("active")))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("code"))
    rows = table(spark, sf_dir, "customer").join(nation, "c_nationkey")
    out = plugins.lookup(rows, listed)
    return out.select("c_custkey", F.col("entry").isNotNull().alias("known"), F.col("entry.name").alias("processor"))


@query("plugins", """
SELECT c_custkey, 'building' AS processor, round(c_acctbal * 2, 2) AS amount FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT c_custkey, 'machinery', round(c_acctbal + 1, 2) FROM customer WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""")
def two_processors(spark, sf_dir):
    def building(rows):
        return rows.select("c_custkey", F.lit("building").alias("processor"), F.round(F.col("c_acctbal") * 2, 2).alias("amount"))

    def machinery(rows):
        return rows.select("c_custkey", F.lit("machinery").alias("processor"), F.round(F.col("c_acctbal") + 1, 2).alias("amount"))

    return plugins.apply(table(spark, sf_dir, "customer"), "c_mktsegment", {"BUILDING": building, "MACHINERY": machinery})
