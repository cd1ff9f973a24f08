"""URL block and allow rules whose decisions reach aliases.

A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the
rule's; the longest fitting rule wins (among equals the longer host, then allow). Urls that redirect
to or name each other as canonical are one component; a url without a rule of its own takes the
component's decision: allow if an alias has an explicit allow, else block if one is blocked, else
allow. Components are computed on the edges alone; urls without edges never enter the graph.
Expressions are built-in ones, but for the character references in declared targets.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and is
allowed; null html has no edges; a page's targets are resolved against its url, and those that then
aren't absolute (another scheme without ``//``) are ignored; repeated rows give
repeated results; further input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import string
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from likeness.sources.scratch import Scratch
from likeness.operators.components import components

ALLOW, BLOCK = "allow", "block"
#: Longer lists of rules are joined by host instead of tried one by one.
RULES_IN_EXPRESSION = 64
#: Rules are broadcast up to this many and joined by a shuffle beyond.
BROADCAST_RULES = 100_000


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _ordered(rules):
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != ALLOW, r[1:]))


def with_rule(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``urls`` (with host and path) plus rule (host and path of the winning rule) and ruled."""
    rules = _ordered(rules)
    if len(rules) > RULES_IN_EXPRESSION:
        return _with_rule_by_join(urls, rules)
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in rules]
    choose = lambda value: F.coalesce(*[F.when(fit, F.lit(value(r))) for fit, r in zip(fits, rules)], F.lit(None).cast("string"))
    return urls.withColumns({"rule": choose(lambda r: r[1] + r[2]), "ruled": choose(lambda r: r[0])})


def _with_rule_by_join(urls: DataFrame, rules) -> DataFrame:
    table = urls.sparkSession.createDataFrame([(h, p, v, i) for i, (v, h, p) in enumerate(rules)], "rule_host string, rule_path string, v string, n int")
    table = F.broadcast(table) if len(rules) <= BROADCAST_RULES else table
    keys = urls.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = keys.withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    best = fitting.groupBy("host", "path").agg(F.min_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("v").alias("ruled")), "n").alias("best"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.ruled").alias("ruled"))


def url_node(url: Column) -> Column:
    """The graph's node of an absolute url: scheme and fragment don't matter; null if not absolute."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, "://") > 0, F.xxhash64(F.concat(host_of(url), F.lit("\n"), path_of(url), F.lit("\n"), query)))


#: An attribute: name, then its value in double, in single or without quotes.
_ATTRIBUTE = r"""([^\s"'=<>/][^\s=>/]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?+"""


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name; null without it."""
    names, *values = [F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(i)) for i in range(1, 5)]
    at = F.array_position(F.transform(names, F.lower), name) - 1
    return F.concat(*[F.get(v, F.when(at >= 0, at.cast("int"))) for v in values])


_references = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9;])))").sub


def _character(found: re.Match) -> str:
    return unescape(found[0]) if found[1][0] == "#" or found[1] in html5 else found[0]


@F.pandas_udf(StringType())
def _decoded(values: pd.Series) -> pd.Series:
    """Attribute values with their character references decoded, as html has it for attributes."""
    return values.map(lambda v: v and _references(_character, v))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments taken out."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.concat(done, F.array(part))),
    )
    folder = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(F.when(folder, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def resolved(target: Column, page: Column) -> Column:
    """The url that a page's reference means (RFC 3986)."""
    scheme = F.regexp_extract(page, r"^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(page), r"^[^/?#]*", 0))
    own, tail = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    query = F.regexp_extract(_rest(page), r"^[^?#]*(\?[^#]*)?", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(page), r"^/(.*/)?", 1))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, _without_dots(own), tail))
        .when(own != "", F.concat(site, _without_dots(F.concat(folder, own)), tail))
        .when(tail.startswith("?"), F.concat(site, path_of(page), tail))
        .otherwise(F.concat(site, path_of(page), query, tail))
    )


#: What a page holds but doesn't declare: comments, also open ones, and the contents of scripts and styles.
_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*+>.*?</\1\s*+>"


def page_edges(pages: DataFrame) -> DataFrame:
    """source, target (urls): all canonical links and redirects that the pages' html declares."""
    html = F.regexp_replace("html", _UNSEEN, " ")
    tags = F.regexp_extract_all(html, F.lit(r"""(?i)<((?:link|meta)\b(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>"""), F.lit(1))
    named = pages.filter(F.col("html").rlike(r"(?i)canonical|http-equiv")).filter("instr(url, '://') > 0").select(F.col("url").alias("source"), F.explode(tags).alias("tag"))
    inside = F.expr("substring(tag, 5)")
    link = F.lower(F.substring("tag", 1, 4)) == "link"
    canonical = link & F.array_contains(F.split(F.lower(_attribute(inside, "rel")), r"\s+"), "canonical")
    refresh = ~link & (F.lower(F.trim(_attribute(inside, "http-equiv"))) == "refresh")
    found = named.select("source", link.alias("link"), F.when(canonical, _attribute(inside, "href")).when(refresh, _attribute(inside, "content")).alias("value")).filter("value <> ''")
    found = found.select("source", "link", _decoded("value").alias("value"))
    content = F.regexp_extract("value", r"(?is)^\s*(?:[\d.]*[;,\s]*url\s*=|[\d.]+\s*[;,\s])\s*(.*)$", 1)
    unquoted = F.coalesce(*[F.when(content.startswith(q), F.regexp_extract(content, f"^{q}([^{q}]*)", 1)) for q in "\"'"], content)
    target = F.regexp_replace(F.when(F.col("link"), F.col("value")).otherwise(unquoted), r"^\s+|\s+$", "")
    found = found.select("source", target.alias("target")).filter("target <> ''")
    return found.select("source", resolved(F.col("target"), F.col("source")).alias("target")).filter("instr(target, '://') > 0")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every page (page_id, url and, without ``edges``, html)."""
    scratch = Scratch(pages.sparkSession, "url-filters")
    edges = scratch.keep((page_edges(pages) if edges is None else edges).select("source", "target"))
    url = F.col("url")
    judged = with_rule(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path")), rules)
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(ALLOW)).alias("verdict"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("url")).distinct()
    ends = with_rule(ends.select(url_node(url).alias("node"), host_of(url).alias("host"), path_of(url).alias("path")), rules)
    groups = components(edges.select(url_node(F.col("source")).alias("a"), url_node(F.col("target")).alias("b")), scratch)
    # Explicit allow precedence: "allow" is the smaller string.
    decided = ends.join(groups, "node").filter("ruled is not null").groupBy("label").agg(F.min("ruled").alias("alias_verdict"))
    reach = groups.join(decided, "label").select("node", "alias_verdict")
    out = judged.withColumn("node", url_node(url)).join(reach, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "alias_verdict", F.lit(ALLOW)).alias("verdict"))
