import pytest
from pyspark.sql import functions as F

from coverlane.functions import html
from coverlane.operators import matching, pages

GRID = """<html><head><title>A &amp; B</title><script>var x="<a href='no'>";</script></head><body><!-- <a href="no"> -->
<table class="ResultGrid wide"><tr><th>Póliza</th><th>Certificado</th><th>No. Dependiente</th><th>Nombre del Paciente</th><th>Status</th>
<th>&nbsp;</th><th class="hide">Ref</th></tr>
<tr><td>90001</td><td>0000000001</td><td>0</td><td>ANA&nbsp; PRUEBA <b>EJEMPLO</b></td><td><div>Activo</div><span>VER</span></td><td></td><td class="hide">1</td></tr>
<tr><td>90001</td><td>0000000001</td><td>C2</td><td>LUIS MUESTRA</td><td>Inactivo</td></tr><tr></tr></table>
<table><tr><td>1</td></tr></table></body></html>"""
SHIFT = '<table class="G"><tr><td>A</td><td> </td><td>B</td><td>A</td></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr><tr><td>5</td></tr></table>'
FORM = """<form><input id="q" name="d" value=" v "><input type="hidden" value="h"><input id="p" placeholder="hint" required>
<select id="s"><option>one</option><option selected>two</option></select><select id="t"><option>first</option></select>
<div class="box error-box">Login FAILED</div><p class="alert"></p><p class="message">third</p>
<a HREF='/x?a=1&amp;b=2'>Mis Pólizas</a><a name="n">none</a><a href=/bare>b</a><iframe src="/captcha/1"></iframe><br/><b id="u">un<i>it</i> </b></form>"""


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(1, "u1", GRID), (2, "u2", SHIFT), (3, "u3", FORM), (4, "u4", None), (5, "u5", '<table class="G"><tr><th>A</th></tr></table>')]
    return pages.with_elements(spark.createDataFrame(rows, "page_id long, url string, html string")).cache()


def test_result_rows(parsed):
    got = {(r["page_id"], r["row_idx"]): r["cells"] for r in pages.result_rows(parsed, "ResultGrid").collect()}
    assert set(got) == {(1, 1), (1, 2)}
    assert got[(1, 1)]["Status"] == "Activo VER" and got[(1, 1)]["Certificado"] == "0000000001"
    assert got[(1, 2)] == {"Póliza": "90001", "Certificado": "0000000001", "No. Dependiente": "C2", "Nombre del Paciente": "LUIS MUESTRA", "Status": "Inactivo"}


def test_blank_header_shifts_cells_unless_aligned(parsed):
    shifted = [r["cells"] for r in pages.result_rows(parsed, "G").orderBy("row_idx").collect()]
    assert shifted == [{"A": "3", "B": "2"}, {"A": "5"}]
    aligned = [r["cells"] for r in pages.result_rows(parsed, "G", align=True).orderBy("row_idx").collect()]
    assert aligned == [{"A": "4", "B": "3"}, {"A": "5"}]


def test_match_strict_and_not(spark, parsed):
    rows = matching.named_rows(pages.result_rows(parsed, "ResultGrid").withColumnRenamed("page_id", "page_key"))
    clients = spark.createDataFrame([(1, "ana prueba ejemplo"), (1, " Luis\xa0muestra"), (1, None), (1, ""), (2, "ANA PRUEBA EJEMPLO")], "page_key long, full_name string")
    loose = sorted(r["hit"]["row_idx"] for r in matching.match(clients, rows).collect())
    strict = sorted(r["hit"]["row_idx"] for r in matching.match(clients, rows, strict=True).collect())
    assert loose == [1, 2] and strict == [1]


def test_first_active_row_wins(spark):
    rows = spark.createDataFrame([(1, 1, "A", "Baja"), (1, 2, "a ", "ACTIVO"), (1, 3, "A", "activo"), (1, 4, "", "activo")], "page_key long, row_idx int, patient string, status string")
    rows = rows.withColumns({"policy_no": F.lit("p"), "dependent_no": F.lit("")})
    assert [r["hit"]["row_idx"] for r in matching.first_active(rows).collect()] == [2]


def test_selectors(parsed):
    def texts(selector, page=3):
        els = F.col("els")
        hits = F.transform(html.select(els, selector), lambda e: html.text_of(els, e))
        return parsed.filter(F.col("page_id") == page).select(hits).first()[0]

    assert texts("b#u") == ["unit"] and texts("form i") == ["it"] and texts("#none") == []
    assert texts('[class*="error"], .message') == ["Login FAILED", "third"]
    assert texts('select[id="s"] option') == ["one", "two"]
    assert texts("table tr td", 2) == ["A", "", "B", "A", "1", "2", "3", "4", "5"]
    with pytest.raises(ValueError):
        texts("a:hover")


def test_select_map_overwrites_fixed_keys(parsed):
    got = pages.selected(parsed, {"title": "title", "none": ".x"}).filter("page_id = 1")
    row = got.select(pages.fixed_and_extracted(F.col("url"), F.lit("fixed"), F.col("extracted")).alias("m")).first()["m"]
    assert row == {"url": "u1", "title": "A & B", "none": ""}


def test_form_capture_and_gate(parsed):
    fields = [("v", "input", "#q", 1, True), ("h", "Input", "#p", 2, True), ("s", "select", "#s", 3, False), ("t", "select", "#t", 4, False),
              ("x", "text", "#u", 5, False), ("o", "other", "#q", 6, False), ("m", "text", "#zz", 7, True), ("k", "text", "#yy", 8, False)]
    fields = [dict(zip(("field_name", "field_type", "selector", "ord", "required"), f)) for f in fields]
    captured = pages.capture(parsed.filter("page_id = 3"), fields)
    got = {r["field_name"]: r["value"] for r in captured.collect()}
    assert got == {"v": "v", "h": "hint", "s": "two", "t": "first", "x": "un it", "o": "v", "m": None, "k": None}
    assert tuple(pages.capture_gate(captured).first())[1:] == (8, 6, 2, True, 7)


def test_inventory_banner_tables_failures(parsed):
    found = pages.inventory(parsed).filter("page_id = 3").first()
    assert tuple(found)[1:] == (3, 3, 1, 1, 1)
    banner = pages.error_banner(parsed).filter("page_id = 3").first()
    assert banner["banners"] == ["Login FAILED"] and banner["auth_error"]
    assert [tuple(r)[1:] for r in pages.tables(parsed, "none").filter("page_id = 1").collect()] == [(0, "ResultGrid wide", 4), (1, "none", 1)]
    assert [r["page_id"] for r in pages.failed(parsed).collect()] == [4]


def test_native_paths(parsed):
    got = parsed.filter("page_id in (1, 3)").orderBy("page_id").select(html.title(F.col("html")), html.links(F.col("html")), html.tag_count(F.col("html"), "td")).collect()
    assert tuple(got[0]) == ("A & B", [], 13) and got[1][1] == ["/x?a=1&b=2", "/bare"]
    links = pages.relevant_links(parsed, ["/x"], ["pólizas"]).collect()
    assert [(r["href"], r["label"]) for r in links] == [("/x?a=1&b=2", "Mis Pólizas")]
    assert [r["href"] for r in pages.all_links(parsed).collect()] == ["/x?a=1&b=2", "/bare"]


def test_omitted_end_tags_children_and_entities(spark):
    page = ('<!-- <title>Old</title> --><title>P&oacute;liza &#243;&#xF3;&ntilde &amp;lt; &bogus; &</title>'
            '<table class=g><tr><th>A<th>B<tr><td>1<td>2</table><ul><li>x<li>y</ul><div title="a > b"><b>in</b><p>one<p>two <b>deep</b></div>')
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    parsed = pages.with_elements(df)
    rows = pages.result_rows(parsed, "g").collect()
    assert [r["cells"] for r in rows] == [{"A": "1", "B": "2"}]
    assert df.select(html.title(F.col("html"))).first()[0] == "Póliza óóñ &lt; &bogus; &"
    texts = lambda s: [r[0] for r in parsed.select(F.explode(html.select(F.col("els"), s)).alias("e"), "els").select(html.text_of(F.col("els"), F.col("e"))).collect()]
    assert texts("li") == ["x", "y"] and texts("div > b") == ["in"] and texts('div[title="a > b"] b') == ["in", "deep"] and texts("div>p") == ["one", "twodeep"]


def test_capture_by_settings_of_several_portals(spark):
    rows = [(1, "a", '<html><h1>Title</h1><input id="q" value=" v "><b>x</b></html>'), (2, "b", "<html><h1>Other</h1></html>"),
            (3, None, "<html><h1>N</h1></html>"), (4, "c", "<html><h1>C</h1></html>"), (5, "b", "<html><p>no head</p></html>")]
    parsed = pages.with_elements(spark.createDataFrame(rows, "page_id long, portal string, html string"))
    settings = spark.createDataFrame([
        ("a", "head", "text", "h1", 1, True), ("a", "query", "input", "input#q", 2, False), ("a", "bold", "text", "b", 3, True),
        ("b", "head", "text", "h1", 1, True), ("b", "odd", "text", "h1:first-child >", 2, False), ("b", "none", "text", None, 3, False)],
        "portal string, field_name string, field_type string, selector string, ord int, required boolean")
    got = sorted(tuple(r) for r in pages.capture_by_settings(parsed, settings).select("page_id", "field_name", "found", "value").collect())
    assert got == [(1, "bold", True, "x"), (1, "head", True, "Title"), (1, "query", True, "v"),
                   (2, "head", True, "Other"), (2, "none", False, None), (2, "odd", False, None),
                   (5, "head", False, None), (5, "none", False, None), (5, "odd", False, None)]
    empty = spark.createDataFrame([], settings.schema)
    assert pages.capture_by_settings(parsed, empty).count() == 0
