"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with literal tokens that any URL it matches
must have. Token counts over all URLs give the rarest one, under which the rule
is filed. A URL's tokens fetch candidate rules by an equi-join, and only those
run their expressions. Site rules (a host with its subdomains and a path prefix)
come first; the longest wins. They go through the same index, by the tokens of host and path.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, packed, quoted, unpacked

#: Rules up to this number are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 50_000


def _lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@dataclass(frozen=True)
class SiteRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> tuple[str, ...]:
        """Tokens of any URL that the rule fits; the path's last one only if the path ends after it."""
        cut = [t for t in re.split("[^a-z0-9]+", _lower(self.host)) if t]
        cut += [t for t in re.split("[^a-z0-9]+", re.sub("[a-z0-9]+$", "", _lower(self.path))) if t]
        return tuple(dict.fromkeys(cut))


@dataclass(frozen=True)
class PatternRule:
    """A verdict for URLs that match ``pattern``; each of ``tokens`` (lower-case letters
    and digits) is a whole token of any such URL."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]


#: The site rules of the query (fixed values).
SITE_RULES = [
    SiteRule("allow", "org", "/"),
    SiteRule("block", "example.org", "/es/"),
    SiteRule("block", "example.org", "/en/1"),
    SiteRule("allow", "com", "/fr/"),
    SiteRule("block", "com", "/de/"),
]


def word_rule(verdict: str, *tokens: str) -> PatternRule:
    """A rule for the tokens in sequence, parted by one character."""
    return PatternRule(verdict, r"(?i)(?<![a-z0-9])" + "[^a-z0-9]".join(map(re.escape, tokens)) + r"(?![a-z0-9])", tokens)


#: Pattern rules for pages that no site rule fits.
PATTERN_RULES = [
    word_rule("block", "spam", "farm"),
    word_rule("block", "cheap", "pills"),
    *[
        word_rule("block", w)
        for w in ("casino", "porn", "xxx", "viagra", "cialis", "betting", "poker", "warez", "phishing", "malware", "escort", "lottery")
    ],
    PatternRule("block", r"(?i)[?&]affiliate=", ("affiliate",)),
    PatternRule("block", r"(?i)/wp-login\.php(?![a-z0-9])", ("wp", "login", "php")),
]


def host(url: Column) -> Column:
    return lower_ascii(F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise(""))


def path(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def tokens(url: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lower-cased."""
    parts = F.split(lower_ascii(F.coalesce(url, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def rule_index(urls: DataFrame, site_rules: list[SiteRule], pattern_rules: list[PatternRule]) -> DataFrame:
    """``token, number, host, path, name, pattern, verdict``: each rule under the rarest of
    its tokens in ``urls.url``; a rule without tokens is filed under the empty one, which every URL has."""
    spark = urls.sparkSession
    rules = [(k, r.tokens or ("",), r.host, r.path, r.name, None, r.verdict) for k, r in enumerate(site_rules)]
    rules += [(k, r.tokens or ("",), None, None, None, r.pattern, r.verdict) for k, r in enumerate(pattern_rules)]
    rows = [(n, t, *r[:1], *r[2:]) for n, r in enumerate(rules) for t in r[1]]
    literal = spark.createDataFrame(rows, "rule int, token string, number int, host string, path string, name string, pattern string, verdict string")
    seen = _small(literal.select("token").distinct(), len(rules))
    counts = urls.select(F.explode(tokens(F.col("url"))).alias("token")).join(seen, "token").groupBy("token").agg(F.count("*").alias("n"))
    known = literal.join(counts, "token", "left").select("*", F.coalesce("n", F.lit(0)).alias("seen"))
    fields = ("token", "number", "host", "path", "name", "pattern", "verdict")
    pick = known.groupBy("rule").agg(F.min(F.struct("seen", *fields)).alias("m"))
    return pick.select(*[f"m.{f}" for f in fields])


def _small(df: DataFrame, rules: int) -> DataFrame:
    return F.broadcast(df) if rules <= BROADCAST_RULES else df


def judge(pages: DataFrame, *, url: str = "url", site_rules: list[SiteRule] | None = None, pattern_rules: list[PatternRule] | None = None) -> DataFrame:
    """``pages`` with ``url_host, url_path, url_rule, url_verdict``.

    The verdict is that of the longest site rule that fits (of two as long, the one
    whose name is greater); else that of the first pattern rule (in list order) that
    matches; else ``allow``. A null URL, or one without ``://``, has empty host and
    path, so that no site rule fits it. URLs are matched once for each distinct value,
    very long ones whole; repeated rows stay repeated, an empty table stays empty.
    Columns of ``pages`` named like the four give way; others pass through.
    """
    site_rules = SITE_RULES if site_rules is None else site_rules
    pattern_rules = PATTERN_RULES if pattern_rules is None else pattern_rules
    urls = pages.select(F.col(quoted(url)).cast("string").alias("url")).where("url is not null").distinct()
    index = rule_index(urls, site_rules, pattern_rules)
    index = _small(index.select(*[F.col(c).alias(f"r_{c}") for c in index.columns]), len(site_rules) + len(pattern_rules))
    words = F.array_append(tokens(F.col("url")), "")
    candidates = urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.explode(words).alias("token"))
    candidates = candidates.join(index, F.col("token") == F.col("r_token"))
    of_site = F.expr("r_pattern IS NULL AND host != '' AND (host = r_host OR endswith(host, concat('.', r_host))) AND startswith(path, r_path)")
    of_pattern = F.expr("r_pattern IS NOT NULL AND url RLIKE r_pattern")
    fits = candidates.select("url", of_site.alias("s"), of_pattern.alias("p"), "r_name", "r_number", "r_verdict").where("s OR p")
    site = F.when(F.col("s"), F.struct(F.length("r_name").alias("n"), F.col("r_name").alias("name"), F.col("r_verdict").alias("v")))
    pattern = F.when(F.col("p"), F.struct("r_number", F.col("r_verdict").alias("v")))
    found = fits.groupBy("url").agg(F.max(site).alias("_site"), F.min(pattern).alias("_pattern")).withColumnRenamed("url", "_found")
    whole = packed(pages, _url=F.col(quoted(url)).cast("string"))
    out = whole.join(found, F.col("_url") == F.col("_found"), "left").select(
        "_doc",
        F.coalesce(host(F.col("_url")), F.lit("")).alias("url_host"),
        F.coalesce(path(F.col("_url")), F.lit("")).alias("url_path"),
        F.col("_site.name").alias("url_rule"),
        F.coalesce("_site.v", "_pattern.v", F.lit("allow")).alias("url_verdict"),
    )
    return unpacked(out, pages.columns, ["url_host", "url_path", "url_rule", "url_verdict"])
