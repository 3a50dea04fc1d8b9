"""Captured pages: titles, links, selectors, tables, forms and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlane.functions import html, text
from coverlane.operators import catalog, messages, navigation, pages
from coverlane.plans.registry import query, spread_table, table

NOISE_SQL = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g')"


def _plain_sql(value: str) -> str:
    """Entities resolved; the pages also cut some short at the end of a text ("&amp")."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        value = f"regexp_replace({value}, '&{name}(;|$)', '{char}', 'g')"
    return value


TITLE_SQL = _plain_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")
HREFS_SQL = f"regexp_extract_all({NOISE_SQL}, '<a href=\"([^\"]*)\"', 1)"
H1_SQL = _plain_sql("trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1))")
FOOTER_SQL = _plain_sql("trim(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1))")
AD_SQL = _plain_sql("trim(regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1))")
NAV_SQL = "regexp_extract(html, '(?s)<nav><ul><li><a href=\"[^\"]*\">(.*?)</a>', 1)"


BODY_SQL = "regexp_replace(substr(html, instr(html, '<body>')), '<[^>]*>', ' ', 'g')"
# The pages leave <b> open, so it ends with its paragraph.
BOLD_SQL = _plain_sql("trim(regexp_replace(regexp_extract(html, '(?s)<b>(.*?)(?:</?p>|</article>)', 1), '<[^>]*>', ' ', 'g'))")


@query("page_title", f"SELECT page_id, {TITLE_SQL} AS title FROM pages")
def page_title(spark, sf_dir):
    return spread_table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("page_links10", f"SELECT page_id, array_to_string({HREFS_SQL}[1:10], ' ') AS links, array_to_string({HREFS_SQL}[1:3], ' ') AS top3 FROM pages")
def page_links10(spark, sf_dir):
    found = spread_table(spark, sf_dir, "pages").select("page_id", html.links(F.col("html"), 10).alias("l"))
    return found.select("page_id", F.array_join("l", " ").alias("links"), F.array_join(F.slice("l", 1, 3), " ").alias("top3"))


@query("page_links_all", f"SELECT page_id, unnest({HREFS_SQL}) AS href FROM pages")
def page_links_all(spark, sf_dir):
    return pages.page_links(spread_table(spark, sf_dir, "pages")).select("page_id", "href")


@query("link_relevance", f"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all({NOISE_SQL}, '(?s)<a href=".*?</a>')) AS a FROM pages),
l AS (SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_replace(a, '<[^>]*>', '', 'g') AS label FROM a)
SELECT page_id, href, label FROM l WHERE (href LIKE '%an%' OR href LIKE '%th%') AND (lower(label) LIKE '%on%' OR lower(label) LIKE '%the%' OR lower(label) LIKE '%é%')""")
def link_relevance(spark, sf_dir):
    return pages.relevant_links(spread_table(spark, sf_dir, "pages"), ["an", "th"], ["on", "the", "é"])


@query("select_map", f"""
SELECT page_id, {H1_SQL} AS head, {AD_SQL} AS ad, {NAV_SQL} AS first_nav, '' AS missing, {FOOTER_SQL} AS footer FROM pages""")
def select_map(spark, sf_dir):
    parsed = pages.with_elements(spread_table(spark, sf_dir, "pages"))
    found = pages.selected(parsed, {"head": "article h1", "ad": "div.ad, div.banner", "first_nav": 'nav a[href*="/"]', "missing": "#none", "footer": "footer"})
    return found.select("page_id", *[F.col("extracted")[n].alias(n) for n in ("head", "ad", "first_nav", "missing", "footer")])


@query("scrape_results", f"""
SELECT url, {TITLE_SQL} AS title, '' AS content, CAST(200 AS INTEGER) AS status_code, CASE WHEN html LIKE '%lang="es"%' THEN 'timeout' ELSE '' END AS error_message,
  page_id % 2 = 0 AS rendered, 1.5::DOUBLE AS processing_time, {H1_SQL} AS head FROM pages""")
def scrape_results(spark, sf_dir):
    """The generic worker's result rows, with the whole record as JSON."""
    parsed = pages.with_elements(spread_table(spark, sf_dir, "pages"))
    scraped = pages.selected(parsed, {"head": "h1"}).select(
        "url", html.title(F.col("html")).alias("title"), F.lit(200).alias("status_code"),
        F.when(F.contains("html", F.lit('lang="es"')), "timeout").alias("error"), (F.col("page_id") % 2 == 0).alias("rendered"), "extracted")
    rows = messages.scrape_records(scraped, F.lit(0).cast("long"), F.lit(1_500_000).cast("long"))
    head = F.get_json_object("extracted", "$.extracted.head")
    return rows.select("url", "title", "content", "status_code", "error_message", "rendered", "processing_time", head.alias("head"))


@query("element_inventory", f"""
SELECT page_id, len(regexp_extract_all({NOISE_SQL}, '<a[ >]')) AS links, len(regexp_extract_all({NOISE_SQL}, '<p[ >]')) AS paragraphs,
  len(regexp_extract_all({NOISE_SQL}, '<li[ >]')) AS items, 0::BIGINT AS inputs, len(regexp_extract_all({NOISE_SQL}, '<p[ >]')) AS fast_paragraphs FROM pages""")
def element_inventory(spark, sf_dir):
    """Element counts from the tree, and the same count by the JVM-only path."""
    source = spread_table(spark, sf_dir, "pages").withColumn("fast", html.tag_count(F.col("html"), "p"))
    parsed = pages.with_elements(source)
    counted = {"links": "a", "paragraphs": "p", "items": "li", "inputs": "input"}
    return parsed.select("page_id", *[F.size(html.select(F.col("els"), s)).cast("long").alias(n) for n, s in counted.items()],
                         F.col("fast").cast("long").alias("fast_paragraphs"))


@query("element_list", f"""
WITH a AS (SELECT page_id, regexp_extract_all({NOISE_SQL}, '(?s)<a href=".*?</a>') AS found FROM pages),
n AS (SELECT page_id, found, unnest(generate_series(1, least(5, len(found)))) AS i FROM a)
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, regexp_extract(found[i], 'href="([^"]*)"', 1) AS href, regexp_replace(found[i], '<[^>]*>', '', 'g') AS label FROM n""")
def element_list(spark, sf_dir):
    """The first five links of each page."""
    found = pages.first_elements(pages.with_elements(spread_table(spark, sf_dir, "pages")), "a")
    return found.select("page_id", "pos", F.col("attrs")["href"].alias("href"), "label")


@query("error_banner", f"""
SELECT page_id, {AD_SQL} AS banner, lower({AD_SQL}) LIKE '%the%' OR lower({AD_SQL}) LIKE '%der%' AS auth_error FROM pages""")
def error_banner(spark, sf_dir):
    parsed = pages.with_elements(spread_table(spark, sf_dir, "pages"))
    found = pages.error_banner(parsed, 'div.ad, [class*="alert"]', ["the", "der"])
    return found.select("page_id", F.array_join("banners", "|").alias("banner"), "auth_error")


@query("login_outcome", f"""
SELECT page_id, CASE WHEN url LIKE '%blog%' THEN true WHEN {TITLE_SQL} LIKE '%De%' THEN true
  WHEN lower({BODY_SQL}) LIKE '%schkeit%' OR lower({BODY_SQL}) LIKE '%eauxou%' THEN false ELSE true END AS logged_in,
  CASE WHEN html LIKE '%<br>%' THEN '' ELSE 'br' END || CASE WHEN html LIKE '%<b>%' THEN '' ELSE 'article b' END || 'form' AS warnings FROM pages""")
def login_outcome(spark, sf_dir):
    """Forbidden text anywhere on the page, and a list of expected elements that are not there."""
    parsed = pages.missing_elements(pages.with_elements(spread_table(spark, sf_dir, "pages")), ["br", "article b", "form"])
    body = html.text_of(F.col("els"), html.select_one(F.col("els"), "body"), " ")
    view = parsed.select("page_id", "url", "warnings", html.title(F.col("html")).alias("title"), F.lower(body).alias("body_text"))
    out = pages.login_outcome(view, "blog", "De", ["schkeit", "eauxou"])
    return out.select("page_id", "logged_in", F.array_join("warnings", "").alias("warnings"))


@query("url_state", """
SELECT CASE WHEN url LIKE '%#top%' THEN 'ping' WHEN url LIKE '%?page=%' THEN 'login' WHEN url LIKE '%/en/%' THEN 'portal'
  WHEN url LIKE '%.html%' THEN 'search' ELSE 'other' END AS state, count(*) AS n FROM pages GROUP BY 1""")
def url_state(spark, sf_dir):
    rules = [("#top", "ping"), ("?page=", "login"), ("/en/", "portal"), (".html", "search")]
    states = table(spark, sf_dir, "pages").select(navigation.state(F.col("url"), rules).alias("state"))
    return states.groupBy("state").agg(F.count("*").alias("n"))


@query("selector_kind", f"""
WITH s AS (SELECT page_id, unnest({HREFS_SQL}) AS href FROM pages),
k AS (SELECT page_id, CASE length(href) % 4 WHEN 0 THEN '#' WHEN 1 THEN '.' WHEN 2 THEN '/' ELSE '' END || href AS selector,
  CASE length(href) % 3 WHEN 0 THEN 'CLICK' WHEN 1 THEN 'Submit' ELSE 'wait' END AS action FROM s)
SELECT CASE WHEN selector LIKE '#%' THEN 'id' WHEN selector LIKE '.%' THEN 'class' WHEN selector LIKE '//%' THEN 'xpath' ELSE 'css' END AS selector_kind,
  CASE WHEN action = 'wait' THEN 'unknown' ELSE lower(action) END AS action_kind, count(*) AS n FROM k GROUP BY 1, 2""")
def selector_kind(spark, sf_dir):
    hrefs = spread_table(spark, sf_dir, "pages").select(F.explode(html.links(F.col("html"))).alias("href"))
    size = F.length("href")
    mark = F.when(size % 4 == 0, "#").when(size % 4 == 1, ".").when(size % 4 == 2, "/").otherwise("")
    action = F.when(size % 3 == 0, "CLICK").when(size % 3 == 1, "Submit").otherwise("wait")
    rows = hrefs.select(catalog.selector_kind(F.concat(mark, "href")).alias("selector_kind"), catalog.action_kind(action).alias("action_kind"))
    return rows.groupBy("selector_kind", "action_kind").agg(F.count("*").alias("n"))


@query("capture_gate", f"""
WITH b AS (SELECT page_id, html LIKE '%<b>%' AS has_b, html LIKE '%<br>%' AS has_br FROM pages)
SELECT page_id, 5::BIGINT AS n_fields, 2 + has_b::BIGINT + has_br::BIGINT AS n_captured, 3 - has_b::BIGINT - has_br::BIGINT AS n_failed, NOT has_b OR NOT has_br AS stopped,
  CASE WHEN NOT has_br THEN 2 WHEN NOT has_b THEN 4 END AS stop_ord FROM b""")
def capture_gate(spark, sf_dir):
    """Five configured fields per page: two always there, two that some pages lack, one missing."""
    return pages.capture_gate(pages.capture(pages.with_elements(spread_table(spark, sf_dir, "pages")), FIELDS)).select(
        "page_id", "n_fields", "n_captured", "n_failed", "stopped", "stop_ord")


FIELDS = [
    {"field_name": "head", "field_type": "text", "selector": "h1", "ord": 1, "required": True},
    {"field_name": "break", "field_type": "other", "selector": "br", "ord": 2, "required": True},
    {"field_name": "query", "field_type": "input", "selector": "input#q", "ord": 3, "required": False},
    {"field_name": "bold", "field_type": "text", "selector": "b", "ord": 4, "required": True},
    {"field_name": "note", "field_type": "text", "selector": "div.ad", "ord": 5, "required": False},
]


@query("capture_values", f"""
SELECT page_id, 'head' AS field_name, {H1_SQL} AS value FROM pages UNION ALL SELECT page_id, 'note', {AD_SQL} FROM pages
UNION ALL SELECT page_id, 'query', NULL FROM pages UNION ALL SELECT page_id, 'break', CASE WHEN html LIKE '%<br>%' THEN '' END FROM pages
UNION ALL SELECT page_id, 'bold', CASE WHEN html LIKE '%<b>%' THEN {BOLD_SQL} END FROM pages""")
def capture_values(spark, sf_dir):
    found = pages.capture(pages.with_elements(spread_table(spark, sf_dir, "pages")), FIELDS)
    return found.select("page_id", "field_name", "value")


#: Capture settings of two portals with different fields; the second has a selector that can't be read.
PORTAL_FIELDS = [("secure", f["field_name"], f["field_type"], f["selector"], f["ord"], f["required"]) for f in FIELDS] + [
    ("plain", "head", "text", "h1", 1, True), ("plain", "bold", "text", "b", 2, True), ("plain", "broken", "text", "h1:first-child", 3, False)]


@query("capture_portals", f"""
WITH p AS (SELECT page_id, html, CASE WHEN url LIKE 'https:%' THEN 'secure' ELSE 'plain' END AS portal FROM pages)
SELECT page_id, portal, 'head' AS field_name, true AS found, {H1_SQL} AS value FROM p
UNION ALL SELECT page_id, portal, 'bold', html LIKE '%<b>%', CASE WHEN html LIKE '%<b>%' THEN {BOLD_SQL} END FROM p
UNION ALL SELECT page_id, portal, 'note', true, {AD_SQL} FROM p WHERE portal = 'secure'
UNION ALL SELECT page_id, portal, 'query', false, NULL FROM p WHERE portal = 'secure'
UNION ALL SELECT page_id, portal, 'break', html LIKE '%<br>%', CASE WHEN html LIKE '%<br>%' THEN '' END FROM p WHERE portal = 'secure'
UNION ALL SELECT page_id, portal, 'broken', false, NULL FROM p WHERE portal = 'plain'""")
def capture_portals(spark, sf_dir):
    """Fields by a settings table of two portals, pages dealt to portals by their scheme, all in one plan."""
    settings = spark.createDataFrame(PORTAL_FIELDS, "portal string, field_name string, field_type string, selector string, ord int, required boolean")
    parsed = pages.with_elements(spread_table(spark, sf_dir, "pages"))
    parsed = parsed.withColumn("portal", F.when(F.col("url").startswith("https:"), "secure").otherwise("plain"))
    return pages.capture_by_settings(parsed, settings).select("page_id", "portal", "field_name", "found", "value")


# A result page per customer, written out in SQL that both engines read.
RESULT_PAGE = """concat('<html><body><table class="Menu"><tr><td>x</td></tr></table><table class="Grid wide">',
 '<tr><th>Póliza</th><th>No. Dependiente</th><th>Nombre del Paciente</th><th> </th><th>Status</th><th class="hide">Ref</th></tr>',
 '<tr><td>', c_custkey, '</td><td>0</td><td>', c_name, ' &amp; ', c_mktsegment, '</td><td>Inactivo</td><td>', c_nationkey, '</td><td class="hide">1</td></tr>',
 CASE WHEN c_acctbal > 5000 THEN concat('<tr><td>', c_custkey, '</td><td>C', c_nationkey, '</td><td>&nbsp;<b>', lower(c_name), '</b> </td><td><div>Activo</div>',
   '<span>VER</span></td></tr>') ELSE '' END,
 '</table></body></html>')"""


def result_pages(spark, sf_dir):
    return spread_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.expr(RESULT_PAGE).alias("html"))


@query("html_table", """
SELECT c_custkey AS page_id, 1 AS row_idx, CAST(c_custkey AS VARCHAR) AS policy, '0' AS dependent, concat(c_name, ' & ', c_mktsegment) AS patient,
  'Inactivo' AS status FROM customer
UNION ALL SELECT c_custkey, 2, CAST(c_custkey AS VARCHAR), concat('C', c_nationkey), lower(c_name), 'Activo VER' FROM customer WHERE c_acctbal > 5000""")
def html_table(spark, sf_dir):
    """Rows read back from the result pages: the blank header is dropped before pairing, so
    the cell of the fourth column lands under "Status"."""
    rows = pages.result_rows(pages.with_elements(result_pages(spark, sf_dir)), "Grid")
    cell = F.col("cells")
    return rows.select("page_id", "row_idx", cell["Póliza"].alias("policy"), cell["No. Dependiente"].alias("dependent"),
                       cell["Nombre del Paciente"].alias("patient"), cell["Status"].alias("status"))


@query("html_table_inventory", """
SELECT css_class, n_rows, count(*) AS n FROM (SELECT 'Menu' AS css_class, 1 AS n_rows FROM customer
  UNION ALL SELECT 'Grid wide', CASE WHEN c_acctbal > 5000 THEN 3 ELSE 2 END FROM customer) GROUP BY 1, 2""")
def html_table_inventory(spark, sf_dir):
    found = pages.tables(pages.with_elements(result_pages(spark, sf_dir)))
    return found.groupBy("css_class", "n_rows").agg(F.count("*").alias("n"))


@query("html_table_size", """
SELECT c_custkey AS page_id, CAST(CASE WHEN c_acctbal > 5000 THEN 2 ELSE 1 END AS BIGINT) AS n_rows, 4 AS n_columns FROM customer""")
def html_table_size(spark, sf_dir):
    rows = pages.result_rows(pages.with_elements(result_pages(spark, sf_dir)), "Grid")
    return pages.result_sizes(rows)
