"""URL filters that follow redirects.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z in lower case; path: then up to "?", "#" or the end; of a null
URL or one without "://" both are empty. A rule (host, path) fits its host and all subdomains where the URL's path begins
with the rule's; of the rules that fit, the longest wins.

Pages are tied to the addresses that they name as canonical (link rel=canonical) or redirect to (meta refresh); further
redirects may be given as (from_url, to_url). Connected components over these edges are equivalent addresses. A page with a rule
follows its rule, so an explicit allow stands; a page without one is blocked if any address of its component is blocked by
a rule, pages or not, and allowed else. An address is its host, path and query; scheme and fragment don't count.
"""

from __future__ import annotations

from html import unescape
from urllib.parse import urljoin

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from curatorium.llm.components import components
from curatorium.llm.store import keep

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(df: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """Add host, path and address of a URL: host, path and query, what it stands for among edges; null without a host."""
    names = {n: prefix + n for n in ("host", "path", "_rest")}
    rest = F.when(F.instr(F.col(url), "://") > 0, F.substr(F.col(url), F.instr(F.col(url), "://") + 3)).otherwise("")
    df = df.withColumn(names["_rest"], F.coalesce(rest, F.lit("")))
    cut = F.col(names["_rest"])
    df = df.withColumns({
        names["host"]: F.translate(F.regexp_extract(cut, r"^[^/?#]*", 0), _UPPER, _LOWER),
        names["path"]: F.regexp_extract(cut, r"^[^/?#]*([^?#]*)", 1),
    })
    query = F.regexp_extract(cut, r"^[^?#]*(\?[^#]*)", 1)
    full = F.concat(names["host"], F.when(F.col(names["path"]) == "", "/").otherwise(F.col(names["path"])), query)
    return df.withColumn(prefix + "address", F.when(F.col(names["host"]) != "", full)).drop(names["_rest"])


def rule(of_host: Column, of_path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. The list is part of the plan: meant for tens of rules."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, begin, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((of_host == name) | F.endswith(of_host, F.lit("." + name))) & F.startswith(of_path, F.lit(begin))
        chosen = F.when(fits, F.struct(F.lit(name + begin).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


_TAG = regex.compile(r"<(?:link|meta)\s[^>]*>", regex.I)
_ATTRIBUTE = regex.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", regex.I)
_REFRESH = regex.compile(r"""\burl\s*=\s*["']?([^"'\s]+)""", regex.I)


def links(url: str, page: str) -> list[str]:
    """Absolute addresses that a page names as canonical or refreshes to."""
    found = []
    for tag in _TAG.findall(page):
        values = {name.lower(): unescape(a or b or c) for name, a, b, c in _ATTRIBUTE.findall(tag)}
        link = None
        if "canonical" in values.get("rel", "").lower().split():
            link = values.get("href")
        elif values.get("http-equiv", "").lower() == "refresh" and (aim := _REFRESH.search(values.get("content", ""))):
            link = aim[1]
        if link:
            try:
                found.append(urljoin(url, link.strip()))
            except ValueError:  # not an address
                continue
    return found


def page_edges(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of every canonical link and meta refresh."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(urls: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([links(u, t) for u, t in zip(urls, texts)], dtype=object)

    # pages that name neither are not sent to Python
    some = pages.where("url is not null").where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    return some.select(F.col("url").alias("from_url"), F.explode(run("url", "html")).alias("to_url"))


def judged(pages: DataFrame, rules: tuple = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) for every row of pages; repeated rows stay."""
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("from_url", "to_url"))
    edges = keep(edges, "links")
    for name, url in (("x_", "from_url"), ("y_", "to_url")):
        edges = with_parts(edges, url, name).withColumn(
            name + "verdict", rule(F.col(name + "host"), F.col(name + "path"), rules)["verdict"])
    edges = keep(edges.where("x_address <> y_address").select(
        F.struct(F.col("x_address").alias("address"), F.col("x_verdict").alias("verdict")).alias("x"),
        F.struct(F.col("y_address").alias("address"), F.col("y_verdict").alias("verdict")).alias("y")).distinct(), "edges")
    found = components(edges.select(F.md5("x.address").alias("a"), F.md5("y.address").alias("b")))
    ends = edges.select("x.*").union(edges.select("y.*")).distinct().select(F.md5("address").alias("node"), "verdict")
    sites = found.join(ends, "node")
    blocked = sites.where("verdict = 'block'").select("component").distinct()
    aliases = found.join(blocked, "component", "left_semi").select(F.col("node").alias("_blocked"))
    own = with_parts(pages.select("page_id", "url"), "url").withColumn("_rule", rule(F.col("host"), F.col("path"), rules))
    joined = own.withColumn("_node", F.md5("address")).join(aliases, F.col("_node") == F.col("_blocked"), "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_blocked").isNotNull(), "block").otherwise("allow"))
    return joined.select("page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))
