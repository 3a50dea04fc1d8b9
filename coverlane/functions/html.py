"""Rows out of captured pages.

Two ways in. Titles, links and tag counts use JVM string functions only. Everything
that needs the element tree (selectors, tables, form fields) goes through
``elements``: a small Arrow-batched parser that turns a page into a flat list of
elements. Selecting, pairing and counting over that list are plain expressions on the
same row, so no parsed page is ever shuffled.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from html.entities import html5
from html.parser import HTMLParser
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlane.functions import text

# Elements that never have content, and elements whose text is not shown.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}

# A start tag ends these open elements, up to the nearest of the walls.
ENDED_BY = {
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "li": ({"li"}, {"ul", "ol"}),
    "option": ({"option"}, {"select"}),
    "p": ({"p"}, {"td", "th", "li", "div", "table", "button"}),
}
for _block in ("div", "table", "ul", "ol", "form", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "hr"):
    ENDED_BY[_block] = ENDED_BY["p"]

NOISE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
TEXT = "#text"
HIDDEN_CLASS = "hide"
PAGES_AT_ONCE = 64

ELEMENT_TYPE = T.ArrayType(T.StructType([
    T.StructField("idx", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("up", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType())]))
_ARROW_ITEM = pa.struct([
    ("idx", pa.int32()), ("last", pa.int32()), ("up", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])


_PART = re.compile(
    r"""(?P<tag>^[a-zA-Z][\w-]*|^\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"""
    r"""|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)["']?(?P<value>[^"'\]]*)["']?)?\]""")
# Compound selectors (a bracket may hold blanks and ">") and child combinators.
_CHAIN = re.compile(r"(?:\[[^\]]*\]|[^\s\[\]>])+|>")


class _Flattener(HTMLParser):
    """Elements in document order, each with the index of its last descendant.

    Pages of one batch are appended to the same columns, ready for Arrow.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.idx, self.last, self.up, self.tags, self.texts = [], [], [], [], []
        self.attr_ends, self.names, self.values = [0], [], []
        self.start, self.open, self.silent = 0, [], 0

    def page(self, html: str) -> bool:
        """Append one page; on failure leave the columns as they were."""
        self.reset()
        self.start, self.open, self.silent = len(self.tags), [], 0
        try:
            self.feed(html)
            self.close()
            self._end(0)
            return True
        except Exception:  # one page that cannot be parsed must not fail the batch
            for column in (self.idx, self.last, self.up, self.tags, self.texts):
                del column[self.start:]
            del self.attr_ends[self.start + 1:], self.names[self.attr_ends[-1]:], self.values[self.attr_ends[-1]:]
            return False

    def _add(self, tag: str, attrs: list, content: str | None = None) -> None:
        at = len(self.tags) - self.start
        self.idx.append(at)
        self.last.append(at)
        self.up.append(self.open[-1] if self.open else -1)
        self.tags.append(tag)
        self.texts.append(content)
        for name, value in dict(attrs).items():
            self.names.append(name)
            self.values.append(value or "")
        self.attr_ends.append(len(self.names))

    def _end(self, depth: int) -> None:
        """Close open elements down to a depth."""
        newest = len(self.tags) - self.start - 1
        for at in self.open[depth:]:
            self.last[self.start + at] = newest
            self.silent -= self.tags[self.start + at] in SILENT
        del self.open[depth:]

    def _imply_ends(self, tag: str) -> None:
        """End tags that authors may leave out, as a browser puts them in."""
        ended, walls = ENDED_BY.get(tag, ((), ()))
        cut = None
        for depth in range(len(self.open) - 1, -1, -1) if ended else ():
            name = self.tags[self.start + self.open[depth]]
            if name in ended:
                cut = depth
            elif name in walls:
                break
        if cut is not None:
            self._end(cut)

    def handle_starttag(self, tag, attrs):
        self._imply_ends(tag)
        self._add(tag, attrs)
        if tag not in VOID:
            self.open.append(self.idx[-1])
            self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.tags[self.start + self.open[depth]] == tag:
                self._end(depth)
                break

    def handle_data(self, data):
        piece = data.strip()
        if piece and not self.silent:
            self._add(TEXT, [], piece)

    def arrow(self, ends: list) -> pa.Array:
        attrs = pa.MapArray.from_arrays(self.attr_ends, pa.array(self.names, pa.string()), pa.array(self.values, pa.string()))
        items = pa.StructArray.from_arrays(
            [pa.array(self.idx, pa.int32()), pa.array(self.last, pa.int32()), pa.array(self.up, pa.int32()), pa.array(self.tags, pa.string()), attrs,
             pa.array(self.texts, pa.string())], fields=list(_ARROW_ITEM))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


def _parsed(pages: pa.Array) -> pa.Array:
    flat, ends = _Flattener(), []
    for page in pages.to_pylist():
        start = len(flat.tags)
        ends.append(start if page is not None and flat.page(page) else None)
    return flat.arrow([*ends, len(flat.tags)])


@F.arrow_udf(ELEMENT_TYPE)
def _elements(pages: pa.Array) -> pa.Array:
    """Few pages at a time: their elements as Python objects take many times what Arrow needs."""
    return pa.concat_arrays([_parsed(pages.slice(at, PAGES_AT_ONCE)) for at in range(0, max(1, len(pages)), PAGES_AT_ONCE)])


def _test(compound: str):
    """A Python predicate for one compound selector, on (tag, attributes)."""
    tests, at = [], 0
    for part in _PART.finditer(compound):
        if part.start() != at:
            break
        at = part.end()
        if part["tag"] and part["tag"] != "*":
            tests.append(lambda tag, attrs, v=part["tag"].lower(): tag == v)
        elif part["id"]:
            tests.append(lambda tag, attrs, v=part["id"]: attrs.get("id") == v)
        elif part["cls"]:
            tests.append(lambda tag, attrs, v=part["cls"]: v in attrs.get("class", "").split())
        elif part["attr"]:
            name, op, value = part["attr"].lower(), part["op"], part["value"]
            tests.append(lambda tag, attrs, n=name, o=op, v=value: n in attrs and (not o or (v in attrs[n] if o == "*=" else attrs[n] == v)))
    if at != len(compound):
        raise ValueError(f"selector part not supported: {compound!r}")
    return lambda tag, attrs: tag != TEXT and all(t(tag, attrs) for t in tests)


def _first_text(page: _Flattener, selector: str) -> str:
    """Text of the first match in the page just parsed, '' where nothing matches."""
    n = len(page.tags)
    attrs = [dict(zip(page.names[a:b], page.values[a:b])) for a, b in zip(page.attr_ends, page.attr_ends[1:])]
    hits = []
    for chain in re.split(r",(?![^\[]*\])", selector):
        places, direct, started = None, False, False
        for part in _CHAIN.findall(chain):
            if part == ">":
                direct = True
                continue
            test = _test(part)
            if not started:
                places, started = [i for i in range(n) if test(page.tags[i], attrs[i])], True
            else:
                inside = {j for i in places for j in range(i + 1, page.last[i] + 1) if not direct or page.up[j] == i}
                places = sorted(j for j in inside if test(page.tags[j], attrs[j]))
            direct = False
        hits += places or []
    if not hits:
        return ""
    first = min(hits)
    return "".join(page.texts[i] for i in range(first + 1, page.last[first] + 1) if page.tags[i] == TEXT)


@F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
def _select_texts(pages: pa.Array, selectors: pa.Array) -> pa.Array:
    out = []
    for page, wanted in zip(pages.to_pylist(), selectors.to_pylist()):
        flat = _Flattener()
        if page is None or wanted is None or not flat.page(page):
            out.append(None)
            continue
        try:
            out.append([(name, _first_text(flat, s)) for name, s in wanted])
        except ValueError:  # a selector of a message that is not understood fails its own row only
            out.append(None)
    return pa.array(out, pa.map_(pa.string(), pa.string()))


def select_texts(page: Column, selectors: Column) -> Column:
    """Output name to text of the first match, by the selector map of the same row; null if that fails."""
    return _select_texts.asNondeterministic()(page, selectors)


# Marked this way so that no filter is moved below the parser, which would run it twice.
elements = _elements.asNondeterministic()


# Element expressions --------------------------------------------------------------


def below(els: Column, item: Column) -> Column:
    """All descendants of an element: a slice, since the list is in document order."""
    return F.slice(els, item["idx"] + 2, item["last"] - item["idx"])


def has_class(item: Column, name: str) -> Column:
    value = item["attrs"]["class"]
    # The plain search comes first: it settles almost every element without a split.
    return F.coalesce(F.contains(value, F.lit(name)) & F.array_contains(F.split(value, f"[{text.BLANKS}]+"), name), F.lit(False))


def _matches(item: Column, compound: str) -> Column:
    """One compound selector: tag, ``#id``, ``.class``, ``[a]``, ``[a="v"]``, ``[a*="v"]``."""
    test, at = item["tag"] != TEXT, 0
    for part in _PART.finditer(compound):
        if part.start() != at:
            break
        at = part.end()
        if part["tag"] and part["tag"] != "*":
            test = test & (item["tag"] == part["tag"].lower())
        elif part["id"]:
            test = test & (item["attrs"]["id"] == part["id"])
        elif part["cls"]:
            test = test & has_class(item, part["cls"])
        elif part["attr"]:
            value = item["attrs"][part["attr"].lower()]
            if part["op"] == "*=":
                test = test & F.contains(value, F.lit(part["value"]))
            else:
                test = test & (value == part["value"] if part["op"] else value.isNotNull())
    if at != len(compound):
        raise ValueError(f"selector part not supported: {compound!r}")
    return F.coalesce(test, F.lit(False))


def select(els: Column, selector: str) -> Column:
    """All elements matching a comma list of selectors, in document order; ``>`` asks for a child, a blank for any descendant."""
    chains = [_CHAIN.findall(chain) for chain in re.split(r",(?![^\[]*\])", selector)]
    if all(len(chain) == 1 for chain in chains):
        return F.filter(els, lambda e: reduce(or_, [_matches(e, chain[0]) for chain in chains]))
    places = F.concat(*[_places(els, chain) for chain in chains])
    return F.transform(F.array_sort(F.array_distinct(places)), lambda i: F.get(els, i))


def _places(els: Column, chain: list[str]) -> Column:
    """Indexes matched by one chain, walked down from its first part."""
    def found(area: Column, part: str) -> Column:
        return F.transform(F.filter(area, lambda e: _matches(e, part)), lambda e: e["idx"])

    def step(places: Column, part: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(places, lambda i: found(below(els, F.get(els, i)), part))))

    def child(places: Column, part: str) -> Column:
        inside = lambda i: F.filter(below(els, F.get(els, i)), lambda e: e["up"] == i)
        return F.array_distinct(F.flatten(F.transform(places, lambda i: found(inside(i), part))))

    if chain[0] == ">" or chain[-1] == ">" or any(a == b == ">" for a, b in zip(chain, chain[1:])):
        raise ValueError(f"selector part not supported: {' '.join(chain)!r}")
    places, direct = found(els, chain[0]), False
    for part in chain[1:]:
        if part != ">":
            places = (child if direct else step)(places, part)
        direct = part == ">"
    return places


def select_one(els: Column, selector: str) -> Column:
    return F.get(select(els, selector), 0)


def _texts(area: Column) -> Column:
    return F.transform(F.filter(area, lambda t: t["tag"] == TEXT), lambda t: t["text"])


def text_of(els: Column, item: Column, joiner: str = "") -> Column:
    """Stripped text pieces under an element; null only for a null element."""
    return F.array_join(_texts(below(els, item)), joiner)


def visible_text(els: Column, item: Column, hidden_class: str) -> Column:
    """Text a browser would show: what sits under the hiding class is left out."""
    area = below(els, item)
    hidden = F.filter(area, lambda e: has_class(e, hidden_class))
    shown = F.filter(area, lambda t: ~F.exists(hidden, lambda h: (t["idx"] > h["idx"]) & (t["idx"] <= h["last"])))
    return F.when(has_class(item, hidden_class), "").otherwise(text.strip(F.array_join(_texts(shown), " ")))


def select_map(els: Column, selectors: dict[str, str]) -> Column:
    """Output name to text of the first match, '' where nothing matches."""
    pairs: list[Column] = []
    for name, selector in selectors.items():
        found = text_of(els, select_one(els, selector))
        pairs += [F.lit(name), F.coalesce(found, F.lit(""))]
    return F.create_map(*pairs)


def rows_of(els: Column, table: Column) -> Column:
    return F.filter(below(els, table), lambda e: e["tag"] == "tr")


def cells_of(els: Column, row: Column, tags: list[str], hidden_class: str = HIDDEN_CLASS) -> Column:
    """Visible texts of the cells of one row."""
    found = F.filter(below(els, row), lambda e: e["tag"].isin(tags))
    return F.transform(found, lambda c: F.when(has_class(row, hidden_class), "").otherwise(visible_text(els, c, hidden_class)))


def pair_cells(headers: Column, values: Column) -> Column:
    """Map from header to cell; of equal headers the last that has a cell wins."""
    used = F.slice(headers, 1, F.least(F.size(headers), F.size(values)))
    names = F.filter(F.array_distinct(used), lambda h: h != "")
    return F.map_from_entries(F.transform(names, lambda h: F.struct(
        h, F.get(values, F.array_max(F.transform(used, lambda u, i: F.when(u == h, i)))))))


def table_inventory(els: Column, placeholder: str) -> Column:
    """Every table of the page with its class and number of rows."""
    tables = F.filter(els, lambda e: e["tag"] == "table")
    return F.transform(tables, lambda t, i: F.struct(
        i.alias("table_idx"), text.shown(t["attrs"]["class"], placeholder).alias("css_class"),
        F.size(rows_of(els, t)).alias("n_rows")))


def form_value(els: Column, item: Column, field_type: str) -> Column:
    """Value of a form element by the configured field type, stripped."""
    value, hint = item["attrs"]["value"], item["attrs"]["placeholder"]
    if field_type.lower() == "input":
        raw = text.first_filled(value, hint)
    elif field_type.lower() == "text":
        raw = text_of(els, item, " ")
    elif field_type.lower() == "select":
        options = F.filter(below(els, item), lambda o: o["tag"] == "option")
        chosen = F.filter(options, lambda o: F.map_contains_key(o["attrs"], "selected"))
        option = F.coalesce(F.get(chosen, F.size(chosen) - 1), F.get(options, 0))
        raw = F.coalesce(text_of(els, option, " "), F.lit(""))
    else:
        raw = text.first_filled(text_of(els, item, " "), value)
    return F.when(item.isNotNull(), text.strip(raw))


# JVM-only expressions --------------------------------------------------------------


def without_noise(page: Column) -> Column:
    """The page without comments, scripts and styles (their text may look like tags)."""
    return F.regexp_replace(page, NOISE, "")


def unescape(value: Column) -> Column:
    """Named and numeric entities; as in a browser, old names may lack the semicolon at the end of a word."""
    def read(piece: Column) -> Column:
        decimal = F.regexp_extract(piece, r"^&#(\d{1,7});?$", 1)
        hexed = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]{1,6});?$", 1)
        code = F.when(decimal != "", F.hex(decimal.cast("long"))).when(hexed != "", F.upper(hexed))
        number = F.conv(code, 16, 10).cast("long")
        fine = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        return F.when(fine, char).when(F.startswith(piece, F.lit("&")), F.coalesce(F.element_at(named, F.substr(piece, F.lit(2))), piece)).otherwise(piece)

    named = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    pieces = F.regexp_extract_all(value, F.lit(r"&#?[a-zA-Z0-9]+;?|[^&]+|&"), F.lit(0))
    return F.when(F.contains(value, F.lit("&")), F.array_join(F.transform(pieces, read), "")).otherwise(value)


def title(page: Column) -> Column:
    return unescape(F.regexp_extract(without_noise(page), r"(?is)<title[^>]*>(.*?)</title\s*>", 1))


def links(page: Column, first: int | None = None) -> Column:
    """``href`` values in document order; ``first`` keeps the leading ones."""
    raw = F.regexp_extract_all(without_noise(page), F.lit(HREF), F.lit(1))
    found = F.transform(raw, lambda v: unescape(F.regexp_replace(v, "^[\"']|[\"']$", "")))
    return found if first is None else F.slice(found, 1, first)


def anchors(page: Column) -> Column:
    """Links with their text, for rules that look at both."""
    whole = F.regexp_extract_all(without_noise(page), F.lit(r"(?is)<a\s[^>]*>.*?</a\s*>"), F.lit(0))
    return F.transform(whole, lambda a: F.struct(
        F.get(links(a), 0).alias("href"),
        text.strip(unescape(F.regexp_replace(a, "<[^>]*>", ""))).alias("label")))


def tag_count(page: Column, tag: str) -> Column:
    return F.regexp_count(without_noise(page), F.lit(rf"(?i)<{tag}[\s/>]"))
