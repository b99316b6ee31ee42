"""URL rules that hold for all aliases of a page.

A page names its aliases by canonical links, refresh tags or entries of a redirect table. Every tag
outside comments counts, and canonical may be any word of its rel. Links are resolved as RFC 3986
says (section 5.2), against the page's first base href if it has one. Pages and aliases are the
nodes of a graph; its components are found by Spark joins. A page that no rule fits takes the
decision of its component: allowed if a rule allows one of its members, else blocked if a rule blocks
one, else allowed. A page's own rule always stands.

A node is a url without its fragment and the port its scheme has anyway, its scheme and host in small
letters, its path without dot segments and at least a slash. A null url, and one without ``://``,
has no host, fits no rule, has no alias and is allowed.

Tags are cut out first, each from its ``<`` to the next ``<`` or ``>``, and attributes are read within a
tag, so the work is linear in the page, whatever it holds: a megabyte of open tags takes no longer
than other text. A quoted ``<`` or ``>`` ends a tag early. Repeated rows get equal results. Only page_id,
url and html are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placebook.functions.once import with_once
from placebook.llm.components import components
from placebook.llm.shared import kept
from placebook.llm.winnowing import CAPITALS, SMALL

SPLIT = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
TAG = r"(?i)<(?:link|meta|base)\b[^<>]*+(?:>|\z)"
#: Name and value; a quoted value is passed as a whole, so what it holds is not taken for an attribute.
ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""
REFRESH = r"""(?is)^\s*[\d.]+\s*[;,]\s*url\s*=\s*["']?([^"'>\s]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


# The rules of the contract.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit("")), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 3), F.lit(""))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is spelled out, and computed, once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments (RFC 3986, section 5.2.4)."""
    nothing = F.array().cast("array<string>")

    def cleaned(segments: Column) -> Column:
        stack = F.aggregate(
            segments,
            nothing,
            lambda kept, one: F.when(one == "..", F.when(F.size(kept) > 0, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept))
            .when(one == ".", kept)
            .otherwise(F.concat(kept, F.array(one))),
        )
        folder = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(nothing)
        return F.concat(F.lit("/"), F.array_join(F.concat(stack, folder), "/"))

    clean = bound(F.split(F.substring(path, F.lit(2), F.length(path)), "/"), cleaned)
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), clean).otherwise(path)


def node_of(url: Column) -> Column:
    def assembled(p: Column) -> Column:
        usual = F.when(p["scheme"] == "http", ":80").when(p["scheme"] == "https", ":443").otherwise(":")
        host = F.when(p["host"].endswith(usual), F.substring(p["host"], F.lit(1), F.length(p["host"]) - F.length(usual))).otherwise(p["host"])
        return F.concat(p["scheme"], F.lit("://"), host, without_dots(p["path"]), p["rest"])

    path = bound(path_of(url), lambda given: F.when(given == "", "/").otherwise(given))
    scheme = F.translate(F.regexp_extract(url, SPLIT, 1), CAPITALS, SMALL)
    parts = F.struct(scheme.alias("scheme"), host_of(url).alias("host"), path.alias("path"), F.regexp_extract(url, SPLIT, 4).alias("rest"))
    return F.when(url.contains("://"), bound(parts, assembled))


def resolved(link: Column, base: Column) -> Column:
    """A link as an absolute url, seen from ``base``; dot segments stay, ``node_of`` removes them."""

    def seen(p: Column) -> Column:
        scheme, path = F.regexp_extract(p["base"], SPLIT, 1), path_of(p["base"])
        site = F.concat(scheme, F.lit("://"), F.regexp_extract(p["base"], SPLIT, 2))
        folder = bound(F.regexp_extract(path, r"(?s)^(.*/)", 1), lambda given: F.when(given == "", "/").otherwise(given))
        return (
            F.when(p["link"].rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), p["link"])
            .when(p["link"].startswith("//"), F.concat(scheme, F.lit(":"), p["link"]))
            .when(p["link"].startswith("/"), F.concat(site, p["link"]))
            .when(p["link"].startswith("?"), F.concat(site, path, p["link"]))
            .when(p["link"].startswith("#"), p["base"])
            .otherwise(F.concat(site, folder, p["link"]))
        )

    return bound(F.struct(link.alias("link"), base.alias("base")), seen)


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's first attribute of that name, without its quotes; null if there is none."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    values = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2))
    return F.btrim(F.get(values, F.array_position(names, F.lit(name)).cast("int") - 1), F.lit("\"'"))


def link_of(tag: Column) -> Column:
    """The alias that a tag names, as it is written; null if it names none."""
    is_canonical = F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"[\s/]+"), "canonical")
    refresh = F.regexp_extract(attribute(tag, "content"), REFRESH, 1)
    is_refresh = F.lower(attribute(tag, "http-equiv")) == "refresh"
    link = F.when(tag.rlike("(?i)^<link") & is_canonical, F.btrim(attribute(tag, "href"))).when(
        tag.rlike("(?i)^<meta") & is_refresh, refresh
    )
    return F.replace(F.nullif(link, F.lit("")), F.lit("&amp;"), F.lit("&"))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct; null if none does. Equally long ones: first by text."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path))
    fitting = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in ordered
    ]
    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*fitting, nothing)


def alias_edges(pages: DataFrame) -> DataFrame:
    """Canonical and refresh links of pages as edges between nodes."""
    tagged = pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)<(?:link|meta)\b"))
    tags = F.regexp_extract_all(F.regexp_replace("html", COMMENT, ""), F.lit(TAG), F.lit(0))
    found = with_once(tagged.select("url", "html"), tags=tags).drop("html")
    bases = F.transform(F.filter("tags", lambda t: t.rlike("(?i)^<base")), lambda t: F.btrim(attribute(t, "href")))
    base = F.get(F.filter(bases, lambda b: b.isNotNull()), 0)
    found = found.select("url", base.alias("base"), F.explode("tags").alias("tag"))
    links = with_once(found, link=link_of(F.col("tag"))).where("link is not null")
    seen_from = F.when(F.col("base").isNull(), F.col("url")).otherwise(resolved(F.col("base"), F.col("url")))
    links = with_once(links.select("url", "base", "link"), near=seen_from)
    links = with_once(links, target=resolved(F.col("link"), F.when(F.col("near").contains("://"), F.col("near")).otherwise(F.col("url"))))
    edges = with_once(links, a=node_of(F.col("url")), b=node_of(F.col("target")))
    return edges.select("a", "b").where("a is not null and b is not null")


def judged(pages: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Rule and verdict of every row of ``pages``; ``redirects`` (a, b) adds edges between urls."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = alias_edges(pages)
    if redirects is not None:
        more = redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))
        edges = edges.unionAll(more.where("a is not null and b is not null"))
    labels = components(edges, folder)
    own = best_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    decided = labels.withColumn("own", own["verdict"]).groupBy("component").agg(
        F.max(F.col("own") == "allow").alias("allows"), F.max(F.col("own") == "block").alias("blocks")
    )
    taken = F.when(F.coalesce("allows", F.lit(False)), "allow").when(F.coalesce("blocks", F.lit(False)), "block").otherwise("allow")
    aliases = kept(
        labels.join(decided, "component").select("node", F.col("component").alias("alias_group"), taken.alias("taken")), f"{folder}/aliases"
    )
    url = F.col("url")
    seen = pages.select(
        "page_id",
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        node_of(url).alias("node"),
    ).withColumn("fit", best_rule(F.col("host"), F.col("path"), rules))
    return seen.join(aliases, "node", "left").select(
        F.col("page_id").cast("long").alias("page_id"),
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "taken", F.lit("allow")).alias("verdict"),
        "alias_group",
    )
