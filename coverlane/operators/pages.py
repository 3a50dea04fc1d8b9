"""Operators over tables of captured pages (``page_id, url, html``)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlane.functions import html, text

# What counts as an error banner, and words of a sign-in error.
BANNER = '.error, .alert, .message, [class*="error"], [class*="alert"]'
AUTH_WORDS = ["invalid", "incorrect", "failed", "error", "incorrecto", "invalido", "fallido"]

# Address fragments and words that mark a link worth following.
LINK_FRAGMENTS = ["MisPolizas", "InfoAsegurado", "Contenido", "Inicio"]
LINK_WORDS = ["póliza", "poliza", "asegurado", "beneficios", "información"]

# Element kinds counted on a page.
KINDS = {
    "inputs": "input",
    "links": "a",
    "hidden_inputs": 'input[type="hidden"]',
    "captcha_frames": 'iframe[src*="captcha"]',
    "required_inputs": "input[required]",
}


def with_elements(pages: DataFrame) -> DataFrame:
    """Parse each page once; every operator below works on the resulting column."""
    return pages.withColumn("els", html.elements("html"))


def _unfold(exploded: DataFrame, marker: str) -> DataFrame:
    """Drop the null row of an outer explode. A plain explode would make the optimizer add
    a filter that works out the whole list a second time."""
    return exploded.filter(F.col(marker).isNotNull())


def failed(parsed: DataFrame) -> DataFrame:
    """Pages that could not be parsed, as error rows; the others go on."""
    return parsed.filter(F.col("els").isNull()).select("page_id", "url", F.lit("page could not be parsed").alias("error"))


def selected(parsed: DataFrame, selectors: dict[str, str]) -> DataFrame:
    return parsed.withColumn("extracted", html.select_map(F.col("els"), selectors))


def fixed_and_extracted(url: Column, title: Column, extracted: Column) -> Column:
    """Fixed keys plus one per selector; a selector of the same name wins."""
    fixed = F.create_map(F.lit("url"), url, F.lit("title"), title)
    kept = F.map_filter(fixed, lambda k, _: ~F.map_contains_key(extracted, k))
    return F.map_concat(kept, extracted)


def all_links(parsed: DataFrame, selector: str = "a[href]") -> DataFrame:
    """Every non-empty ``href`` of the selected elements, one row each."""
    hits = F.transform(html.select(F.col("els"), selector), lambda e: e["attrs"]["href"])
    full = F.filter(hits, lambda h: text.has_value(h))
    return _unfold(parsed.select("page_id", F.posexplode_outer(full).alias("pos", "href")), "pos")


def page_links(pages: DataFrame) -> DataFrame:
    """Every non-empty ``href`` of the page's links, one row each, without the element tree."""
    full = F.filter(html.links(F.col("html")), lambda h: text.has_value(h))
    return _unfold(pages.select("page_id", F.posexplode_outer(full).alias("pos", "href")), "pos")


def missing_elements(parsed: DataFrame, expected: list[str]) -> DataFrame:
    """``warnings``: the selectors of which a page has no element, in the order given."""
    absent = [F.when(F.size(html.select(F.col("els"), s)) == 0, s) for s in expected]
    return parsed.withColumn("warnings", F.filter(F.array(*absent), lambda s: s.isNotNull()))


def scrape(tasks: DataFrame, pages: DataFrame, max_links: int = 10) -> DataFrame:
    """Each task with what its page holds: ``title``, ``extracted`` (map), ``links``, ``status_code``, ``error``.

    A task's own selectors are applied to its page; a task without any takes the first
    links. A url that was never captured, or a page that cannot be parsed, is an error row.
    Of several captures of one url the one with the largest ``page_id`` is read.
    """
    newest = pages.groupBy("url").agg(F.max_by(F.struct("html"), "page_id").alias("_page"))
    rows = tasks.join(newest, "url", "left").withColumn("_html", F.col("_page.html"))
    asked = F.coalesce(F.size("selectors") > 0, F.lit(False))
    rows = rows.withColumn("_found", F.when(asked, html.select_texts(F.col("_html"), F.col("selectors"))))
    failed = F.col("_html").isNull() | (asked & F.col("_found").isNull())
    return rows.select(
        *tasks.columns, html.title(F.col("_html")).alias("title"),
        F.coalesce("_found", F.create_map().cast("map<string,string>")).alias("extracted"),
        F.when(~asked & ~failed, html.links(F.col("_html"), max_links)).alias("links"),
        F.when(failed, F.lit(None)).otherwise(F.lit(200)).cast("int").alias("status_code"),
        F.when(F.col("_page").isNull(), "page was not captured").when(failed, "page could not be parsed").alias("error"))


def result_rows(parsed: DataFrame, css_class: str, hidden_class: str = html.HIDDEN_CLASS, align: bool = False) -> DataFrame:
    """Rows of the page's first table of a class: ``page_id, row_idx, cells`` (map).

    Blank headers are dropped before pairing, so later cells move left; ``align=True``
    keeps positions. A table of one row has no rows. Each step is a column of its own, so
    a page's header is worked out once and the element list ends before the explode.
    """
    els = F.col("els")
    step = parsed.select("page_id", "els", html.select_one(els, f"table.{css_class}").alias("box"))
    step = step.withColumn("trs", html.rows_of(els, F.col("box")))
    trs = F.col("trs")
    heads = html.cells_of(els, F.get(trs, 0), ["th", "td"], hidden_class)
    body = F.slice(trs, 2, F.greatest(F.size(trs) - 1, F.lit(0)))
    step = step.select(
        "page_id", (heads if align else F.filter(heads, lambda h: h != "")).alias("heads"),
        F.transform(body, lambda r: html.cells_of(els, r, ["td"], hidden_class)).alias("body"))
    # Paired inside the generator: filters on the cells then do not pair them again.
    paired = F.transform("body", lambda texts: html.pair_cells(F.col("heads"), texts))
    rows = step.select("page_id", F.posexplode_outer(paired).alias("at", "cells")).filter(F.size("cells") > 0)
    return rows.select("page_id", (F.col("at") + 1).alias("row_idx"), "cells")


def result_sizes(rows: DataFrame) -> DataFrame:
    """Per page, the number of result rows and of columns seen in them."""
    return rows.groupBy("page_id").agg(F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("n_columns"))


def tables(parsed: DataFrame, placeholder: str = "no-class") -> DataFrame:
    return _unfold(parsed.select("page_id", F.inline_outer(html.table_inventory(F.col("els"), placeholder))), "table_idx")


def inventory(parsed: DataFrame, kinds: dict[str, str] = KINDS) -> DataFrame:
    els = F.col("els")
    return parsed.select("page_id", *[F.size(html.select(els, s)).alias(n) for n, s in kinds.items()])


def first_elements(parsed: DataFrame, selector: str, n: int = 5) -> DataFrame:
    """The first few elements of a kind on each page, with their attributes and text."""
    els = F.col("els")
    shown = F.transform(F.slice(html.select(els, selector), 1, n), lambda e: F.struct(
        e["tag"].alias("tag"), e["attrs"].alias("attrs"), html.text_of(els, e, " ").alias("label")))
    return _unfold(parsed.select("page_id", F.posexplode_outer(shown).alias("pos", "element")), "pos").select("page_id", "pos", "element.*")


def error_banner(parsed: DataFrame, selector: str = BANNER, words: list[str] = AUTH_WORDS) -> DataFrame:
    """Texts of the first two banner elements, and whether they speak of sign-in errors."""
    els = F.col("els")
    texts = F.transform(F.slice(html.select(els, selector), 1, 2), lambda e: html.text_of(els, e, " "))
    out = parsed.withColumn("banners", F.filter(texts, lambda t: t != ""))
    joined = F.lower(F.array_join("banners", " "))
    return out.withColumn("auth_error", text.contains_any(joined, words))


def relevant_links(pages: DataFrame, fragments: list[str] = LINK_FRAGMENTS, words: list[str] = LINK_WORDS) -> DataFrame:
    """Links whose address holds a fragment and whose text holds a word."""
    rows = pages.select("page_id", F.inline_outer(html.anchors(F.col("html"))))
    return rows.filter(text.contains_any("href", fragments) & text.contains_any(F.lower("label"), words))


def capture(parsed: DataFrame, fields: list[dict]) -> DataFrame:
    """Configured fields read from each page: one row per page and field.

    ``fields`` are settings of one portal: ``field_name, field_type, selector, ord,
    required``. A field that is not on the page has a null value and ``found`` false.
    """
    els = F.col("els")
    found = parsed.select("page_id", "els", *[html.select_one(els, f["selector"]).alias(f"_{i}") for i, f in enumerate(fields)])
    boxes = [F.struct(
        F.lit(f["field_name"]).alias("field_name"), F.lit(f["ord"]).alias("ord"), F.lit(f["required"]).alias("required"),
        F.col(f"_{i}").isNotNull().alias("found"), html.form_value(els, F.col(f"_{i}"), f["field_type"]).alias("value"))
        for i, f in enumerate(fields)]
    return found.select("page_id", F.inline_outer(F.array(*boxes)))


def capture_by_settings(parsed: DataFrame, settings: DataFrame, portal: str = "portal") -> DataFrame:
    """Configured fields of each page's own portal: one row per page and field of that portal.

    ``settings`` is a table of ``portal, field_name, field_type, selector, ord, required``
    rows, any number of portals. Every distinct (selector, field type) is compiled once; a
    page evaluates only those its portal names (the others are branches it does not take).
    A selector that can't be compiled fails alone: its fields are not found, the other
    fields of the page are read. Pages of a portal without settings give no rows; a null
    portal has no settings.
    """
    pairs = settings.select("selector", F.lower("field_type").alias("field_type")).distinct().orderBy("selector", "field_type").collect()
    index = {(r.selector, r.field_type): i for i, r in enumerate(pairs)}  # the configuration's own size
    if not index:
        return parsed.sparkSession.createDataFrame(
            [], "page_id long, portal string, field_name string, ord int, required boolean, found boolean, value string")
    kinds = parsed.sparkSession.createDataFrame([(sel, ft, i) for (sel, ft), i in index.items()], "_sel string, _ft string, _kind int")
    cfg = settings.withColumn("_type", F.lower("field_type"))
    numbered = cfg.join(kinds, cfg["selector"].eqNullSafe(kinds["_sel"]) & cfg["_type"].eqNullSafe(kinds["_ft"])).drop("_sel", "_ft", "_type")
    wanted = numbered.groupBy("portal").agg(F.collect_set("_kind").alias("_wanted"))
    els = F.col("els")
    boxes = []
    for (sel, ft), i in sorted(index.items(), key=lambda x: x[1]):
        try:
            if sel is None:
                raise ValueError("no selector")
            item = html.select_one(els, sel)
            box = F.struct(item.isNotNull().alias("found"), html.form_value(els, item, ft or "").alias("value"))
        except (ValueError, KeyError, IndexError, re.error):
            box = F.struct(F.lit(False).alias("found"), F.lit(None).cast("string").alias("value"))
        boxes.append(F.when(F.array_contains(F.col("_wanted"), F.lit(i)), box))
    pages = parsed.withColumnRenamed(portal, "portal").join(wanted, "portal")
    read = pages.select("page_id", "portal", F.array(*boxes).alias("_boxes"))
    fields = numbered.select("portal", "field_name", F.col("ord").cast("int").alias("ord"), F.col("required").cast("boolean").alias("required"), "_kind")
    rows = read.join(fields, "portal")
    box = F.get(F.col("_boxes"), F.col("_kind"))
    return rows.select("page_id", "portal", "field_name", "ord", "required", F.coalesce(box["found"], F.lit(False)).alias("found"),
                       box["value"].alias("value"))


def capture_gate(captured: DataFrame) -> DataFrame:
    """Per page: counts, and the first required field that is missing (where it stops)."""
    failing = F.col("required") & ~F.col("found")
    return captured.groupBy("page_id").agg(
        F.count("*").alias("n_fields"), F.count_if("found").alias("n_captured"),
        F.count_if(~F.col("found")).alias("n_failed"),
        F.bool_or(failing).alias("stopped"), F.min(F.when(failing, F.col("ord"))).alias("stop_ord"))


def login_outcome(pages: DataFrame, url_part: str, title_part: str, forbidden: list[str]) -> DataFrame:
    """Rules in order: success in the address, in the title, forbidden text, else success."""
    bad = text.contains_any("body_text", forbidden)
    ok = (F.when(F.contains("url", F.lit(url_part)), True).when(F.contains("title", F.lit(title_part)), True)
          .when(bad, False).otherwise(True))
    return pages.withColumn("logged_in", ok)
