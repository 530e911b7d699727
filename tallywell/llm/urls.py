"""Allow and block rules for URLs, matched by hash prefixes.

A rule names a host and the beginning of a path and fits that host and all its
subdomains.  Each URL is expanded into expressions, one for each suffix of its host
at a dot and each beginning of its path, as long as some rule's host has so many
labels and some rule's path so many characters; so every rule that fits a URL is
equal to one of its expressions.  Expressions and rules meet by an equi-join on the
first 32 bits of their SHA-256 digests, the full digests confirm, and the rule of
the longest text wins, "block" over "allow" among equals.

Distinct URLs are matched, so copies of a URL cost one.  The rules are broadcast if
there are at most ``BROADCAST_RULES``, of at most ``RULE_CHARS`` characters each; more
of them, or a longer one, are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to which they are broadcast, and the characters that each may then have.
BROADCAST_RULES, RULE_CHARS = 10_000, 2_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    action: str  # "allow" or "block"
    host: str
    path: str

    @classmethod
    def of(cls, action: str, text: str) -> Rule:
        """From a text such as ``example.com/en/``."""
        host, slash, path = text.partition("/")
        return cls(action, host, slash + path)


RULES = (
    Rule.of("allow", "com/"),
    Rule.of("block", "example.com/en/"),
    Rule.of("allow", "www.example.com/en/"),
    Rule.of("block", "net/es/"),
    Rule.of("block", "net/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.regexp_extract(url, _URL, 2)


def _expressions(rules: Sequence[Rule]) -> Column:
    """From columns _host and _path an array of host suffix and path beginning, joined."""
    labels = sorted({r.host.count(".") + 1 for r in rules})
    lengths = sorted({len(r.path) for r in rules})
    count = F.size(F.split("_host", r"\."))
    hosts = F.array_distinct(F.array_compact(F.array(*(F.when(count >= n, F.substring_index("_host", ".", -n)) for n in labels))))
    paths = F.array_compact(F.array(*(F.when(F.length("_path") >= n, F.substring("_path", 1, n)) for n in lengths)))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def verdicts(pages: DataFrame, rules: Sequence[Rule] = RULES, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with columns host, path, rule and verdict; columns of those names are
    replaced.  A URL that no rule fits has a null rule and the verdict ``default``.

    Null URLs, and those without ``://``, have an empty host and path, which a rule fits
    only if its host is empty too.  Repeated rows stay; no rows give no rows.
    """
    spark = pages.sparkSession
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    if not rules:
        host, path = host_and_path(F.col(url_col))
        return pages.select(*names, host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    table = spark.createDataFrame([(r.host + r.path, r.action) for r in rules], "_rule string, _action string")
    table = table.withColumn("_full", _digest(F.col("_rule"))).withColumn("_short", _prefix(F.col("_full")))
    if len(rules) <= BROADCAST_RULES and max(len(r.host + r.path) for r in rules) <= RULE_CHARS:
        table = F.broadcast(table)
    host, path = host_and_path(F.col("_url"))
    urls = pages.select(F.col(url_col).alias("_url")).where("_url IS NOT NULL").distinct()
    asked = (
        urls.select("_url", host.alias("_host"), path.alias("_path"))
        .select("_url", F.explode(_expressions(rules)).alias("_expr"))
        .withColumn("_digest", _digest(F.col("_expr")))
        .withColumn("_short", _prefix(F.col("_digest")))
    )
    # the hash prefix finds candidates, the full digest confirms them
    fits = asked.join(table, "_short").where("_digest = _full")
    best = fits.groupBy("_url").agg(
        F.max(F.struct(F.length("_rule").alias("n"), (F.col("_action") == "block").alias("b"), F.col("_rule").alias("r"), F.col("_action").alias("a"))).alias("_best")
    )
    host, path = host_and_path(F.col(url_col))
    named = pages.where(F.col(url_col).isNotNull())
    found = named.join(best, named[url_col] == best["_url"], "left").select(
        *(named[c] for c in names), host.alias("host"), path.alias("path"),
        F.col("_best.r").alias("rule"), F.coalesce("_best.a", F.lit(default)).alias("verdict"),
    )
    # null URLs, which may be many, are not dealt out by their key
    nameless = pages.where(F.col(url_col).isNull()).select(*names, host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return found.union(nameless)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return verdicts(pages).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages
), r(action, h, pre) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path,
  (SELECT h || pre FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) ORDER BY length(h || pre) DESC LIMIT 1) AS rule,
  coalesce((SELECT action FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) ORDER BY length(h || pre) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""
