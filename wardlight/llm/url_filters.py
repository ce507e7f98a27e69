"""URL filters: allow and block rules, and block decisions that pass to every alias of a blocked page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import Given
from .components import connected_components
from .store import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the production list.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical[\"'\s/>])[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_BASE = r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(url: Column) -> Column:
    """struct(host, path, query): host after the first ``://``, in lower case; empty strings where there is none."""
    url = F.coalesce(url, F.lit(""))
    return F.struct(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, _PARTS, 2).alias("path"), F.regexp_extract(url, _PARTS, 3).alias("query"))


def _without_dots(path: Column) -> Column:
    """path with its segments ``.`` and ``..`` carried out."""
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    segments = F.aggregate(F.split(F.substring(path, 2, 1 << 30), "/"), F.array().cast("array<string>"), step)
    whole = F.concat(F.lit("/"), F.array_join(segments, "/"), F.when(path.rlike(r"/\.\.?$") & (F.size(segments) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), whole).otherwise(path)


def node(url: Column) -> Column:
    """What names a resource: host, path without dots and query, without scheme and fragment; null where there is no host."""
    return _let(parts(url), lambda p: F.when(p["host"] != "", F.concat(p["host"], F.when(p["path"] == "", "/").otherwise(_without_dots(p["path"])), p["query"])))


def resolve(link: Column, base: Column) -> Column:
    """A link, absolute or relative to the scheme, root, folder or page of ``base``, as an absolute url; null for a scheme without ``//``."""

    def absolute(x: Column, b: Column) -> Column:
        root = F.concat(F.lit("http://"), b["host"])
        folder = F.when(b["path"] == "", "/").otherwise(F.regexp_extract(b["path"], r"(?s)^(.*/)", 1))
        page = F.concat(root, F.when(b["path"] == "", "/").otherwise(b["path"]))
        there = F.when(x.rlike("(?i)^[a-z][a-z0-9+.-]*://"), x).when(x.startswith("//"), F.concat(F.lit("http:"), x)).when(x.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None).when(b["host"] == "", None)
        return there.when(x.startswith("/"), F.concat(root, x)).when(x.startswith("?"), F.concat(page, x)).when(x.startswith("#"), F.concat(page, b["query"])).otherwise(F.concat(root, folder, x))

    return _let(F.struct(F.regexp_replace(link, "(?i)&amp;", "&").alias("x"), parts(base).alias("b")), lambda v: absolute(v["x"], v["b"]))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes of a page and of the page that it names as canonical or sends its reader to."""
    found = F.array(F.regexp_extract(html, _CANONICAL, 1), F.regexp_extract(html, _REFRESH, 1))
    out = pages.where(F.col(html).rlike("(?i)canonical|refresh")).select(F.col(url).alias("_from"), F.regexp_extract(html, _BASE, 1).alias("_base"), F.explode(found).alias("_to")).where("_to <> ''")
    base = F.when(F.col("_base") == "", F.col("_from")).otherwise(F.coalesce(resolve(F.col("_base"), F.col("_from")), F.col("_from")))
    return out.select(node(F.col("_from")).alias("a"), node(resolve(F.col("_to"), base)).alias("b")).where("a <> b")


def matched_rule(h: Column, p: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does. Of equal length an allowing rule comes first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, url: str = "url", html: str | None = "html") -> DataFrame:
    """All columns of pages that don't clash, with host, path, rule, verdict and decided_by ('rule', 'alias', 'default').

    Pages that redirect to or name each other as canonical are one resource: connected components over ``redirects``
    (from_url, to_url) and the links in the pages themselves. A page under a rule takes the verdict of that rule, so an
    explicit allow always stands; another page is blocked if a page or a mere target of its component is blocked by a
    rule, and else allowed. Rows with a null url, or a url without ``://``, have an empty host and path, no rule and no
    alias; a null html has no links; html of any length is read whole; repeated rows are judged alike; an empty table gives
    an empty result. Columns of the input with the names of the added ones are replaced, further ones of any name are kept.
    """
    scratch = Scratch(pages.sparkSession, "url")
    whole = lambda p: F.struct(p["host"].alias("host"), p["path"].alias("path"), matched_rule(p["host"], p["path"], rules).alias("rule"))
    given = Given(pages)
    link = given[url]
    sources = [link_edges(given.table, given.of(url), given.of(html))] if html else []
    if redirects is not None:
        sources.append(redirects.select(node(F.col("from_url")).alias("a"), node(F.col("to_url")).alias("b")))
    judged = given.table.withColumn("found", _let(parts(link), whole))
    own = F.col("found.rule.verdict")
    members = connected_components(reduce(DataFrame.unionByName, sources), scratch) if sources else None
    if members is None or members.isEmpty():
        verdict, by = F.coalesce(own, F.lit("allow")), F.when(own.isNotNull(), "rule").otherwise("default")
        scratch.drop()
    else:
        members = scratch.keep(members)
        ruled = judged.where(own == "block").select(node(link).alias("node")).distinct()
        named = parts(F.concat(F.lit("http://"), F.col("node")))
        listed = members.where(_let(named, lambda p: matched_rule(p["host"], p["path"], rules))["verdict"] == "block").select("component")
        bad = members.join(ruled, "node", "left_semi").select("component").unionByName(listed).distinct()
        shut = scratch.keep(members.join(bad, "component", "left_semi").select(F.col("node").alias("shut")).distinct())
        scratch.drop(*[t for t in scratch.held if t is not shut])
        judged = judged.withColumn("node", node(link)).join(shut, F.col("node") == F.col("shut"), "left")
        verdict = F.coalesce(own, F.when(F.col("shut").isNotNull(), "block"), F.lit("allow"))
        by = F.when(own.isNotNull(), "rule").when(F.col("shut").isNotNull(), "alias").otherwise("default")
    return given.back(judged, host="found.host", path="found.path", rule="found.rule.rule", verdict=verdict, decided_by=by)
