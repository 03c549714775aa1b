"""URL filters: pattern rules indexed by their rarest literal token, all in native expressions.

A rule is an anchored pattern over ``host + path`` with the literal tokens that every match must hold.
The rules are filed in a hash table under the one of their tokens that is rarest in the data; a URL's
tokens fetch its candidate rules from the table, and only those candidates run their regular expression.
Up to ``MAX_RULES`` rules the table is a literal array of buckets, so a look-up costs one array access and nothing
is shuffled.  With more rules it is a table of its own that the tokens of the distinct URLs are joined with.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, written
from .quality import let

#: Rules up to which the table is a literal in the plan.
MAX_RULES = 2_000
_SPLIT = "[^0-9A-Za-z_\\x{80}-\\x{10FFFF}]+"


class UrlRule(NamedTuple):
    """``rule`` names it, ``pattern`` is searched in host + path, ``tokens`` are whole tokens of any match."""

    rule: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def prefix_rule(verdict: str, host: str, path: str) -> UrlRule:
    """A host with its subdomains and a path prefix; longer rules win."""
    whole = [t for t in re.split(r"[^0-9A-Za-z_\x80-\U0010FFFF]+", host) if t]
    parts = re.split(r"([^0-9A-Za-z_\x80-\U0010FFFF]+)", path)
    whole += [t for t in parts[:-1:2] if t]  # the last run may go on in the URL: no whole token
    return UrlRule(host + path, verdict, f"^(?:[^/]*\\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(whole)), 1000 + len(host + path))


def word_rule(verdict: str, word: str) -> UrlRule:
    """A word as a whole token of the host."""
    return UrlRule(word, verdict, f"^[^/]*(?<![0-9a-z_]){re.escape(word)}(?![0-9a-z_])[^/]*(?:/|$)", (word,), len(word))


def path_rule(verdict: str, word: str) -> UrlRule:
    """A word as a whole token of the path."""
    return UrlRule("/" + word, verdict, f"^[^/]*/(?:.*[^0-9A-Za-z_])?{re.escape(word)}(?![0-9A-Za-z_\\x{{80}}-\\x{{10FFFF}}])", (word,), len(word))


#: Fixed values: (verdict, host, path).
PREFIX_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The method's own rules: whole tokens of hosts, and whole tokens of paths.
BLOCKED_WORDS = (
    "spam", "pills", "casino", "porn", "viagra", "malware", "phishing", "xxx", "sex", "cialis", "poker", "gambling", "betting", "jackpot", "payday", "escort",
    "hentai", "torrent", "warez", "keygen", "adserver", "doubleclick", "clickbait", "spyware", "ransomware", "botnet",
    "adult", "ads", "bet", "bets", "lottery", "tracker", "adtech", "popups", "hookup", "steroids",
)
BLOCKED_PATHS = ("porn", "xxx", "viagra", "cialis", "casino", "warez", "keygen", "crack", "torrent", "phishing", "malware", "exe", "apk", "adclick", "popunder")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; null or without ``://``: both empty."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def token_counts(pages: DataFrame, url: str, rules: list[UrlRule]) -> dict[str, int]:
    """How many rows hold each rule token: counted over all rows, at most one result row per token."""
    wanted = sorted({t for r in rules for t in r.tokens})
    host, path = split_url(F.col(url))
    found = F.explode(F.array_intersect(F.split(F.concat(host, path), _SPLIT), F.lit(wanted)))
    return {r.token: r["n"] for r in pages.select(found.alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}


def bucket_table(rules: list[UrlRule], counts: dict[str, int]) -> tuple[Column, int]:
    """Rules by hash of their rarest token, as one literal array of buckets."""
    size = 1 << max(4, (2 * len(rules) - 1).bit_length())
    buckets: list[list] = [[] for _ in range(size)]
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.rule!r} has no whole literal token")
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), t))
        entry = F.struct(F.lit(r.rank).alias("rank"), F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.lit(token).alias("token"))
        buckets[_crc(token) % size].append(entry)
    kind = "array<struct<rank:int,rule:string,verdict:string,pattern:string,token:string>>"
    return F.array(*[F.array(*b).cast(kind) if b else F.array().cast(kind) for b in buckets]), size


def _crc(token: str) -> int:
    import zlib

    return zlib.crc32(token.encode())


def rule_table(spark: SparkSession, keys: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """Rules with their rarest token among the keys' tokens, as a table."""
    if any(not r.tokens for r in rules):
        raise ValueError("each rule needs a whole literal token")
    rows = spark.createDataFrame(rules, "rule string, verdict string, pattern string, tokens array<string>, rank int")
    each = rows.withColumn("token", F.explode("tokens"))
    held = keys.select(F.explode(_tokens(F.concat("host", "path"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rarest = each.join(held, "token", "left").groupBy("rule", "verdict", "pattern", "rank").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return rarest


def _tokens(key: Column) -> Column:
    return F.array_distinct(F.split(key, _SPLIT))


def judge_urls(pages: DataFrame, url: str = "url", rules: list[UrlRule] | None = None, default: str = "allow") -> DataFrame:
    """Add ``host``, ``path`` and ``match`` (the winning rule as a struct, or null).

    Null and empty URLs and URLs without ``://`` have an empty host and path and match nothing; repeated rows are
    judged alike; very long URLs are split and matched whole; an empty table gives none.  Of rules of equal rank the
    greater name, then verdict, wins.  Other columns pass through; ``host``, ``path`` and ``match`` are replaced.
    ``default`` is for the caller: see ``verdict``.
    """
    rules = default_rules() if rules is None else rules
    host, path = split_url(F.col(url))
    named = lambda r: F.struct(r["rank"].alias("rank"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))
    if len(rules) > MAX_RULES:
        placed = pages.withColumns({"host": host, "path": path}).drop("match")
        keys = placed.select("host", "path").distinct()
        key = F.concat("host", "path")
        # up to a counted size the rules go to the URLs, so tokens that nearly every URL holds are not shuffled
        filed = broadcast_if_small(written(rule_table(pages.sparkSession, keys, rules)))
        fetched = keys.withColumn("token", F.explode(_tokens(key))).join(filed, "token")
        best = fetched.where(F.regexp_like(key, F.col("pattern"))).groupBy("host", "path").agg(F.max(F.struct("rank", "rule", "verdict")).alias("match"))
        return placed.join(best, ["host", "path"], "left").select(*placed.columns, "match")
    table, size = bucket_table(rules, token_counts(pages, url, rules))

    def best(key: Column) -> Column:
        fetched = F.flatten(F.transform(_tokens(key), lambda t: F.filter(F.get(table, F.pmod(F.crc32(t.cast("binary")), F.lit(size)).cast("int")), lambda r: r["token"] == t)))
        return F.array_max(F.transform(F.filter(fetched, lambda r: F.regexp_like(key, r["pattern"])), named))

    return pages.withColumns({"host": host, "path": path, "match": let(F.concat(host, path), best)})


def default_rules() -> list[UrlRule]:
    own = [word_rule("block", w) for w in BLOCKED_WORDS] + [path_rule("block", w) for w in BLOCKED_PATHS]
    return [prefix_rule(*r) for r in PREFIX_RULES] + own
