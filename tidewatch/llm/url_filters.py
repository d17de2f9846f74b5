"""URL filters: rules are found through one literal key each, and only those found are run.

Pattern rules (regular expressions with their literal tokens) are indexed by the token that is rarest
in the URLs at hand; site rules (host and path prefix) by their host. Each distinct URL offers its
tokens and the last labels of its host as keys, an equi join fetches the candidate rules, and only those
are evaluated. Built-in functions throughout.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.llm.common import free_name, lower_ascii, small_side
from tidewatch.session import cut_lineage


@dataclass(frozen=True)
class SiteRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased URL. Each of ``tokens`` is in every URL that it matches."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str = "block"

    def __post_init__(self):
        if not self.tokens or any(not re.fullmatch("[a-z0-9]+", t) for t in self.tokens):
            raise ValueError(f"rule {self.name} needs literal tokens of a to z and 0 to 9")
        re.compile(self.pattern)


# The site rules of the contract.
SITE_RULES = (
    SiteRule("org", "/", "allow"),
    SiteRule("example.org", "/es/", "block"),
    SiteRule("example.org", "/en/1", "block"),
    SiteRule("com", "/fr/", "allow"),
    SiteRule("com", "/de/", "block"),
)

PATTERN_RULES = (
    PatternRule("spam_farm_host", r"://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    PatternRule("pill_shop_host", r"://([^/?#]*\.)?cheap-pills\.", ("cheap", "pills")),
    PatternRule("casino_host", r"://[^/?#]*\bcasino\b", ("casino",)),
    PatternRule("adult_host", r"://[^/?#]*\b(xxx)\b", ("xxx",)),
    PatternRule("login_page", r"://[^/?#]*/([^?#]*/)?login\b", ("login",)),
    PatternRule("session_id", r"[?&]phpsessid=[0-9a-f]+", ("phpsessid",)),
    PatternRule("cart_page", r"://[^/?#]*/([^?#]*/)?cart/checkout\b", ("cart", "checkout")),
    PatternRule("casino_news", r"://news\.[^/?#]*\bcasino\b", ("news", "casino"), "allow"),
)


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(lower_ascii(url), "[^a-z0-9]+"), ""))


def host_suffixes(host: Column, most: int) -> Column:
    """The last label of the host, the last two, and so on up to ``most`` labels: no rule has a longer host."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, most)))), lambda i: F.array_join(F.slice(labels, -i, i), "."))


SITE_COLUMNS = "host string, path string, verdict string"
PATTERN_COLUMNS = "name string, pattern string, tokens array<string>, verdict string"


def site_table(spark: SparkSession, rules: tuple[SiteRule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], SITE_COLUMNS)


def pattern_table(spark: SparkSession, rules: tuple[PatternRule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.pattern, list(r.tokens), r.verdict) for r in rules], PATTERN_COLUMNS)


def index_rules(urls: DataFrame, sites: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row per rule with its key. A pattern rule's key is the one of its tokens that fewest URLs hold.

    The counts come from all URLs, in one aggregate over the tokens that rules name. The choice
    changes how many candidates there are, never a verdict.
    """
    named = patterns.select("name", F.explode("tokens").alias("token")).distinct()
    wanted = small_side(named.select("token").distinct())
    seen = urls.select(F.explode(tokens_of(F.col("_url"))).alias("token")).join(wanted, "token").groupBy("token").agg(F.count("*").alias("seen"))
    rarest = named.join(seen, "token", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token"))["token"].alias("_key"))
    none = F.lit(None).cast("string")
    by_host = sites.select(F.lit("host").alias("_kind"), F.col("host").alias("_key"), F.concat("host", "path").alias("_rule"), F.col("path").alias("_prefix"), none.alias("_pattern"), F.col("verdict").alias("_rule_verdict"))
    by_token = patterns.join(rarest, "name").select(F.lit("token"), "_key", "name", none, "pattern", "verdict")
    return cut_lineage(by_host.union(by_token))


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    site_rules: tuple[SiteRule, ...] | DataFrame = SITE_RULES,
    pattern_rules: tuple[PatternRule, ...] | DataFrame = PATTERN_RULES,
) -> DataFrame:
    """``pages`` with host, path, rule (of the sites, else null), pattern (that decided, else null) and verdict.

    Rules are given in code or as tables (``SITE_COLUMNS``, ``PATTERN_COLUMNS``) of any size; names of pattern rules differ.
    The longest fitting site rule decides (ties: the first by its text). Without one, a matching
    allow pattern, then a matching block pattern (the first by name), then ``allow``. Null URLs and
    those without ``://`` have empty host and path and no site rule. Repeated rows are judged alike;
    columns named as the new ones are replaced. Very long URLs are judged whole; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    sites = site_rules if isinstance(site_rules, DataFrame) else site_table(spark, site_rules)
    patterns = pattern_rules if isinstance(pattern_rules, DataFrame) else pattern_table(spark, pattern_rules)
    count = sites.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    token = F.size(F.filter("tokens", lambda t: ~F.regexp_like(t, F.lit("^[a-z0-9]+$"))))
    bad = patterns.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("tokens") < 1, F.lit(True)) | (token > 0)).alias("bad")).first()
    if not count["n"] and not bad["n"]:
        raise ValueError("no rules given")
    if bad["bad"]:
        raise ValueError(f"{bad['bad']} pattern rules lack literal tokens of a to z and 0 to 9")
    # A URL is judged once however many pages have it. Partial aggregation makes a hot URL one row per task.
    urls = pages.select(F.col(url).alias("_url")).where(F.col(url).isNotNull()).distinct()
    rules = small_side(index_rules(urls, sites, patterns))
    offered = urls.select(
        "_url",
        F.explode(
            F.concat(
                F.transform(host_suffixes(host_of(F.col("_url")), count["labels"] or 1), lambda s: F.struct(F.lit("host").alias("kind"), s.alias("key"))),
                F.transform(tokens_of(F.col("_url")), lambda t: F.struct(F.lit("token").alias("kind"), t.alias("key"))),
            )
        ).alias("_offer"),
    )
    candidates = offered.join(rules, (F.col("_offer.key") == F.col("_key")) & (F.col("_offer.kind") == F.col("_kind")))
    fits = F.when(F.col("_kind") == "host", path_of(F.col("_url")).startswith(F.col("_prefix"))).otherwise(
        F.contains(F.col("_url"), F.lit("://")) & F.regexp_like(lower_ascii(F.col("_url")), F.col("_pattern"))
    )
    site = F.col("_kind") == "host"
    found = (
        candidates.where(fits)
        .groupBy("_url")
        .agg(
            F.min(F.when(site, F.struct((-F.length("_rule")).alias("n"), F.col("_rule").alias("rule"), F.col("_rule_verdict").alias("verdict")))).alias("_site"),
            F.min(F.when(~site, F.struct(F.col("_rule_verdict").alias("verdict"), F.col("_rule").alias("rule")))).alias("_match"),
        )
    )
    key, of_url, site_of, match_of = (free_name(pages, n) for n in ("_page_url", "_url", "_site", "_match"))
    found = found.select(F.col("_url").alias(of_url), F.col("_site").alias(site_of), F.col("_match").alias(match_of))
    judged = pages.withColumn(key, F.col(url)).join(found, F.col(key) == F.col(of_url), "left")
    new = {
        "host": host_of(F.col(url)),
        "path": path_of(F.col(url)),
        "rule": F.col(f"{site_of}.rule"),
        "pattern": F.when(F.col(site_of).isNull(), F.col(f"{match_of}.rule")),
        "verdict": F.coalesce(F.col(f"{site_of}.verdict"), F.col(f"{match_of}.verdict"), F.lit("allow")),
    }
    return judged.select(*[c for c in pages.columns if c.lower() not in new], *[v.alias(k) for k, v in new.items()])
