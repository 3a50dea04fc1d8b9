"""URL filters with redirect equivalence.

Rules judge a url by host and path. Urls that redirect to each other or name each other as
canonical are one document under several names: connected components over these links carry
a block from one name to all others, unless a name of the component is allowed explicitly.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlane.llm.components import components
from coverlane.llm.registry import query, table


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str  # starts with /

    @property
    def name(self) -> str:
        return self.host + self.path


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _after_scheme(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    raw = F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def name(url: Column) -> Column:
    """The node a url stands for: host, path and query, without scheme and fragment."""
    return F.concat(host(url), F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1))


def best_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    return let(F.struct(host.alias("host"), path.alias("path")), lambda at: _best_rule(rules, at["host"], at["path"]))


def _best_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _absolute(link: Column, url: Column) -> Column:
    return let(F.struct(link.alias("link"), url.alias("url")), lambda at: _resolve(at["link"], at["url"]))


def _resolve(link: Column, url: Column) -> Column:
    scheme = F.regexp_extract(url, r"^([^:/?#]*)://", 1)
    site = F.concat(scheme, F.lit("://"), host(url))
    folder = F.regexp_extract(path(url), r"^.*/", 0)
    return (F.when(link.contains("://"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(site, link))
            .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link)))


CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"


def page_links(pages: DataFrame) -> DataFrame:
    """``source, target``: the canonical and refresh links in the pages, as absolute urls.

    Tags inside comments don't count. Pages without url or html have none.
    """
    text = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    tags = (pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|refresh"))
            .select("url", F.concat(
                F.transform(F.regexp_extract_all(text, F.lit(CANONICAL), 0),
                            lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)),
                F.transform(F.regexp_extract_all(text, F.lit(REFRESH), 0),
                            lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)),
            ).alias("links")))
    links = tags.select("url", F.explode("links").alias("link")).where("link <> ''")
    return links.select(F.col("url").alias("source"), _absolute(F.replace("link", F.lit("&amp;"), F.lit("&")), F.col("url")).alias("target"))


def judge(pages: DataFrame, links: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` added (columns of these names are replaced).

    ``links`` has ``source`` and ``target`` urls: redirects and canonical links. A page takes
    the verdict of its own longest rule. Without one it takes ``allow`` if a name in its
    component is allowed by rule, else ``block`` if one is blocked, else ``allow``. A null url
    or one without ``://`` has an empty host and path, fits no rule and has no aliases.
    Repeated rows stay; empty tables give no rows.
    """
    of = lambda url: F.when(F.col(url).contains("://"), name(F.col(url)))
    nodes = components(links.select(of("source").alias("_one"), of("target").alias("_other")), "_one", "_other")
    again = F.concat(F.lit("x://"), F.col("node"))
    ruled = nodes.withColumn("_own", best_rule(rules, host(again), path(again))["verdict"])
    spread = ruled.groupBy("component").agg(
        F.coalesce(F.bool_or(F.col("_own") == "allow"), F.lit(False)).alias("_allowed"),
        F.coalesce(F.bool_or(F.col("_own") == "block"), F.lit(False)).alias("_blocked"))
    blocked = (nodes.join(spread, "component").where("_blocked AND NOT _allowed")
               .select(F.col("node").alias("_urls_node"), F.lit("block").alias("_urls_spread")))
    judged = pages.withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "_urls_node": of("url")})
    judged = judged.withColumn("_urls_best", best_rule(rules, F.col("host"), F.col("path")))
    verdict = F.coalesce(F.col("_urls_best.verdict"), F.col("_urls_spread"), F.lit("allow"))
    return (judged.join(blocked, "_urls_node", "left")
            .withColumns({"rule": F.col("_urls_best.rule"), "verdict": verdict})
            .drop("_urls_node", "_urls_best", "_urls_spread"))


RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]

CHECK = r"""
WITH RECURSIVE p AS (
    SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages
), h AS (
    SELECT page_id, url, html, tail,
        translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
    FROM p
), j AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
    FROM h
), tags AS (
    SELECT url, unnest(list_concat(
        list_transform(regexp_extract_all(body, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)),
        list_transform(regexp_extract_all(body, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1))
    )) AS link
    FROM (SELECT url, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS body FROM pages WHERE instr(url, '://') > 0 AND html IS NOT NULL)
), ends AS (
    SELECT substr(url, instr(url, '://') + 3) AS one, CASE
        WHEN instr(link, '://') > 0 THEN substr(link, instr(link, '://') + 3)
        WHEN link LIKE '//%' THEN substr(link, 3)
        WHEN link LIKE '/%' THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') || link
        ELSE regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') || coalesce(nullif(regexp_extract(
            regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1), '^.*/'), ''), '/') || link END AS other
    FROM (SELECT url, replace(link, '&amp;', '&') AS link FROM tags WHERE link <> '')
), named AS (
    SELECT lower(regexp_extract(one, '^[^/?#]*')) || regexp_extract(one, '^[^/?#]*([^#]*)', 1) AS one,
        lower(regexp_extract(other, '^[^/?#]*')) || regexp_extract(other, '^[^/?#]*([^#]*)', 1) AS other FROM ends
), edges AS (SELECT one, other FROM named UNION SELECT other, one FROM named
), reach AS (SELECT one AS node, one AS also FROM edges UNION SELECT r.node, e.other FROM reach r JOIN edges e ON r.also = e.one
), own AS (
    SELECT node, regexp_extract(also, '^[^/?#]*') AS host, regexp_extract(also, '^[^/?#]*([^?#]*)', 1) AS path FROM reach
), spread AS (
    SELECT node, CASE WHEN bool_or(CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN true
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN true ELSE false END) THEN 'allow'
        WHEN bool_or(CASE
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN true
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN true ELSE false END) THEN 'block' END AS verdict
    FROM own GROUP BY node
)
SELECT page_id, j.host, j.path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    ELSE coalesce(s.verdict, 'allow') END AS verdict
FROM j LEFT JOIN spread s ON instr(j.url, '://') > 0 AND s.node = j.host || regexp_extract(j.tail, '^[^/?#]*([^#]*)', 1)
"""


@query("op10_url_filters", CHECK)
def op10_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return judge(pages, page_links(pages), RULES).select("page_id", "host", "path", "rule", "verdict")
