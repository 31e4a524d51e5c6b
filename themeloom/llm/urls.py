"""URL rules with redirect equivalence, with DataFrame functions only.

A rule names a host and the beginning of a path; it fits its host and all subdomains, and the
longest fitting rule decides. Pages that redirect or name a canonical address are aliases of the
target: connected components over these edges carry decisions to the addresses that no rule fits.
An allow rule comes first: an address of its own keeps it, and a component that holds one allowed
address is allowed as a whole, but for what is blocked by its own rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.components import components
from themeloom.storage import settle

#: The rules of the registered query, as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column | str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; '' for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column | str) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Columns ``host``, ``path``, ``verdict`` of a list of rules."""
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])))


def fitting(places: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each (host, path) of ``places``; places without one are left out."""
    named = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    # Longer suffixes than any rule has need not be looked up.
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))),
                           lambda n: F.array_join(F.slice(labels, -n, n), "."))
    hit = (places.select("host", "path").distinct().filter(F.lit(depth) > 0)
           .select("host", "path", F.explode(suffixes).alias("_host")).join(named, "_host")
           .filter(F.col("path").startswith(F.col("_path"))))
    rule = F.concat("_host", "_path")
    best = F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), F.col("_verdict").alias("verdict")))
    return hit.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def address(url: Column | str) -> Column:
    """A URL without its fragment, which no server sees."""
    return F.regexp_replace(url, r"(?s)#.*$", "")


def targets(html: str = "html", url: str = "url") -> Column:
    """Addresses that a page names as canonical or refreshes to, made absolute."""
    def attribute(tag: Column, name: str) -> Column:
        found = [F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{q}", 1) for q in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")]
        return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])

    page = F.coalesce(F.col(html), F.lit(""))
    links = F.filter(F.regexp_extract_all(page, F.lit(r"(?is)<link\s[^>]*>"), 0), lambda t: t.rlike(r"(?is)\srel\s*=\s*[\"']?canonical\b"))
    moves = F.filter(F.regexp_extract_all(page, F.lit(r"(?is)<meta\s[^>]*>"), 0), lambda t: t.rlike(r"(?is)\shttp-equiv\s*=\s*[\"']?refresh\b"))
    named = F.concat(F.transform(links, lambda t: attribute(t, "href")),
                     F.transform(moves, lambda t: F.regexp_extract(attribute(t, "content"), r"(?is)url\s*=\s*[\"']?([^\"']*)", 1)))
    scheme = F.regexp_extract(url, r"(?s)^(.*?):", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    folder = F.regexp_extract(path(url), r"(?s)^(.*/)", 1)

    def absolute(raw: Column) -> Column:
        x = F.replace(F.trim(raw), F.lit("&amp;"), F.lit("&"))
        return address(F.when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), x).when(x.startswith("//"), F.concat(scheme, F.lit(":"), x))
                       .when(x.startswith("/"), F.concat(site, x))
                       .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), x)))

    return F.transform(F.filter(named, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), absolute)


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None,
          page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict.

    ``redirects(a, b)`` adds edges to those that the pages state. A null URL, or one without
    ``://``, has an empty host and path; no rule fits it, and it has no aliases. Repeated pages and
    URLs give a row each; other columns are not carried; an empty table gives no rows.
    """
    own = F.col(url).contains("://")
    rows = settle(pages.select(
        F.col(page_id).alias("page_id"), host(url).alias("host"), path(url).alias("path"),
        F.when(own, address(url)).alias("node"), F.when(own, targets(html, url)).alias("targets")), "page-addresses")
    edges = rows.select(F.col("node").alias("a"), F.explode("targets").alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address("a").alias("a"), address("b").alias("b")))
    linked = settle(components(edges), "aliases")
    aliases = linked.select("node", "root", host("node").alias("host"), path("node").alias("path"))
    found = settle(fitting(rows.select("host", "path").unionByName(aliases.select("host", "path")), rules), "fitting-rules")
    votes = settle(
        aliases.join(found, ["host", "path"]).groupBy("root")
        .agg(F.min("verdict").alias("carried"))  # allow comes before block
        .join(linked, "root").select("node", "carried"), "carried-verdicts")
    return (rows.join(found, ["host", "path"], "left").join(votes, "node", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("verdict", "carried", F.lit(DEFAULT)).alias("verdict")))


def oracle(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """DuckDB SQL for pages that state no links, as those of the given tables."""
    def fits(h: str, p: str) -> str:
        return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"

    by_length = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in by_length)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in by_length)
    return rf"""
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{_UPPER}', '{_LOWER}') AS host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages)
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE '{DEFAULT}' END AS verdict FROM parts"""
