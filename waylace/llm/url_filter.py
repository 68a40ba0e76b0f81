"""URL rules with decisions carried along redirects and canonical links.

A rule is (verdict, host, path): it fits its host and all subdomains where the
url's path starts with the rule's path, and the longest fitting rule decides.
Urls that no rule fits take the decision of their aliases: connected components
over redirects (``meta refresh`` and, if given, a table of redirects) and
``rel=canonical`` links.  In a component an explicit allow of any member goes
before a block of any other, and with neither the default holds.

Defined results: a null url, or one without ``://``, has empty host and path
and takes the default; null html has no links; repeated rows each get their
row; no rows give no rows; further columns are ignored.  Where rules of one
length fit, allow goes first.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylace.plans.components import connected_components
from waylace.plans.scratch import materialize

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"
#: Up to so many rules are one expression; more are a table joined by host suffix.
INLINE_RULES = 64

_PARTS = "://([^/?#]*)([^?#]*)"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _ordered(rules) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r))


def _with_rule(urls: DataFrame, rules) -> DataFrame:
    """``urls`` (with ``host`` and ``path``) with the ``rule`` and ``rule_verdict`` that fit, or nulls."""
    rules = _ordered(rules)
    if len(rules) <= INLINE_RULES:
        rule = verdict = None
        for what, host, path in rules:
            fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
            rule = F.when(fits, f"{host}{path}") if rule is None else rule.when(fits, f"{host}{path}")
            verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
        none = F.lit(None).cast("string")
        return urls.withColumns({"rule": none if rule is None else rule, "rule_verdict": none if verdict is None else verdict})
    table = urls.sparkSession.createDataFrame([(*r, n) for n, r in enumerate(rules)], "what string, on_host string, on_path string, place int")
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("host", "path").distinct()
    fitting = (
        hosts.withColumn("on_host", F.explode(suffixes))
        .join(table, "on_host")
        .where(F.col("path").startswith(F.col("on_path")))
        .groupBy("host", "path")
        .agg(F.min_by(F.struct(F.concat("on_host", "on_path").alias("rule"), F.col("what").alias("rule_verdict")), "place").alias("best"))
        .select("host", "path", "best.*")
    )
    return urls.join(fitting, ["host", "path"], "left")


def _resolved(base: Column, target: Column) -> Column:
    """``target`` as a whole url, seen from the page ``base``."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, "^([^:/?#]+)://", 1)
    site = F.regexp_extract(base, "^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "^([^:/?#]+://[^/?#]*(?:[^?#]*/)?)", 1)
    return (
        F.when(F.coalesce(target, F.lit("")) == "", None)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(folder.endswith("/") & ~folder.endswith("://"), F.concat(folder, target))
        .otherwise(F.concat(site, F.lit("/"), target))
    )


def _as_node(df: DataFrame, url: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the node of ``url``, host in lower case and no fragment; null without ``://``."""
    bare = df.withColumn("_wl_bare", F.regexp_replace(url, "(?s)#.*$", ""))
    head = bare.withColumn("_wl_head", F.regexp_extract("_wl_bare", "(?s)^(.*?://[^/?]*)", 1))
    node = F.when(F.col("_wl_head") != "", F.concat(_lower(F.col("_wl_head")), F.expr("substring(_wl_bare, length(_wl_head) + 1)")))
    return head.withColumn(name, node).drop("_wl_bare", "_wl_head")


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """``(u, v)`` nodes that are the same page: canonical links, refreshes and rows ``(from_url, to_url)`` of ``redirects``."""
    base, html = F.col(url_col), F.col(html_col)
    canonical = F.regexp_extract(F.regexp_extract(html, _CANONICAL, 0), _HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract(html, _REFRESH, 0), _URL, 1)
    links = pages.select(base.alias("from_url"), F.explode(F.array(canonical, refresh)).alias("target")).where("target <> ''")
    links = links.select("from_url", _resolved(F.col("from_url"), F.col("target")).alias("to_url"))
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    links = _as_node(_as_node(links, F.col("from_url"), "u"), F.col("to_url"), "v")
    return links.where("u is not null and v is not null and u <> v").select("u", "v").distinct()


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, redirects: DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``."""
    links = materialize(alias_links(pages, url_col, html_col, redirects), "alias-links")
    members = connected_components(links)
    judged = _with_rule(members.withColumns({"host": url_host(F.col("node")), "path": url_path(F.col("node"))}), rules)
    groups = materialize(judged.groupBy("root").agg(F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked")), "alias-groups")
    carried = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    shared = materialize(members.join(groups, "root").select("node", carried.alias("carried")).where("carried is not null"), "alias-verdicts")
    url = F.col(url_col)
    rows = _as_node(pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), url.alias("_wl_url")), F.col("_wl_url"), "node")
    return _with_rule(rows, rules).join(shared, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "carried", F.lit(default)).alias("verdict"))
