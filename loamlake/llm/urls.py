"""URL rules with redirect equivalence.

A url's own rule (host and path, longest wins) decides first. Urls that are one
page by redirect or canonical link form a component; a block on one of them, in the table or only
linked to, holds for the aliases without a rule of their own, unless one is explicitly allowed. Urls that differ
in their query are different pages.

Cases: a null url or one without ``://`` has an empty host and path, no rule and
the verdict allow; repeated rows are judged one by one; without links a
component is the spellings of one address; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlake.llm.components import components
from loamlake.operators.once import with_once
from loamlake.runtime import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Where a page names its address or sends its readers: attribute order varies.
CANONICAL = (
    r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""",
    r"""(?i)<link\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)["']?[^>]*\brel\s*=\s*["']?canonical\b""",
    r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh["']?[^>]*\burl\s*=\s*["']?([^"'\s>;]+)""",
)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    """From ``?`` up to ``#`` or the end, the question mark included; empty without one."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^?#]*(\?[^#]*)", 1)


def address_of(url: Column) -> Column:
    """One spelling for a page: no scheme or fragment, no ``www.`` or ``m.`` where two labels are left, no closing ``/`` or ``.html``; null without a host."""
    host = host_of(url)
    bare = F.regexp_replace(host, r"^(?:www|m)\.([^.]+\..+)$", "$1")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path_of(url), r"(/|\.html)+$", ""), query_of(url)))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of length, rule and verdict of the longest (host, path prefix, verdict) that fits; null if none does."""
    fits = []
    for rule_host, rule_path, verdict in rules:
        inside = (host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))
        value = F.struct(F.lit(len(rule_host + rule_path)).alias("size"), F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(inside & F.startswith(path, F.lit(rule_path)), value))
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (a, b, target): a page's address, an address it names by a canonical link or redirect, and that one's url.

    A target without a host is taken from the page's own host; ``//host/path`` has one.
    """
    hits = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(p), F.lit(1)) for p in CANONICAL]))
    named = pages.select(F.col(url).alias("url"), F.explode(F.array_distinct(hits)).alias("target")).filter("target <> ''")
    own = F.concat(F.lit("http://"), host_of(F.col("url")), F.when(F.startswith("target", F.lit("/")), "").otherwise("/"), F.col("target"))
    full = F.when(F.startswith("target", F.lit("//")), F.concat(F.lit("http:"), F.col("target"))).when(F.contains("target", F.lit("://")), F.col("target")).otherwise(own)
    return named.select(address_of(F.col("url")).alias("a"), address_of(full).alias("b"), full.alias("target")).distinct()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None, *, key: str = "page_id") -> DataFrame:
    """``key``, host, path, rule, verdict, component and whether the verdict came from an alias.

    ``rules`` are (host, path prefix, allow or block) and become expressions;
    ``redirects`` are further (a, b) urls of redirect logs. Every end of a link is judged by the rules, whether it is a
    page of the table or not.
    """
    rule = lambda url: matched_rule(host_of(url), path_of(url), rules)
    url = F.col("url").cast("string")
    judged = with_once(pages.select(F.col(key), url.alias("url")), {"host": host_of(F.col("url")), "path": path_of(F.col("url")), "address": address_of(F.col("url"))}).drop("url")
    judged = with_once(judged, {"found": matched_rule(F.col("host"), F.col("path"), rules), "address": F.col("address")})
    linked = links(pages)
    if redirects is not None:
        for end in ("a", "b"):  # both ends of a logged redirect may lie outside the table
            linked = linked.unionByName(redirects.select(address_of(F.col("a")).alias("a"), address_of(F.col("b")).alias("b"), F.col(end).alias("target")))
    linked = cut_lineage(linked)
    ends = linked.select(address_of(F.col("target")).alias("address"), rule(F.col("target"))["verdict"].alias("verdict")).filter("verdict IS NOT NULL").distinct()
    decided = judged.select("address", F.col("found.verdict").alias("verdict")).filter("verdict IS NOT NULL").unionByName(ends)
    judged, decided = (df.withColumn("component", F.col("address")) for df in (judged, decided))
    edges = linked.select("a", "b").filter("a <> b").distinct()
    if not edges.isEmpty():
        named = cut_lineage(components(edges).select(F.col("node").alias("address"), F.col("component").alias("_named")))
        judged, decided = (df.join(named, "address", "left").withColumn("component", F.coalesce("_named", "address")).drop("_named") for df in (judged, decided))
    # One row per component, from partial aggregates.
    fate = decided.filter("component IS NOT NULL").groupBy("component").agg(
        F.max((F.col("verdict") == "allow").cast("int")).alias("allowed"), F.max((F.col("verdict") == "block").cast("int")).alias("blocked")
    )
    passed_on = F.when((F.col("blocked") == 1) & (F.col("allowed") == 0), "block").otherwise("allow")
    return judged.join(fate, "component", "left").select(
        key, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", passed_on).alias("verdict"), "component",
        (F.col("found").isNull() & (passed_on == "block")).alias("by_alias"),
    )
