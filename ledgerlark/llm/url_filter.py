"""URL filters by a Bloom filter cascade, in DataFrame expressions only.

Level 1 encodes the listed keys. Every other level encodes the keys of the complete universe on
the other side that the levels so far get wrong: level 2 the unlisted keys that pass level 1,
level 3 the listed keys that pass level 2, and so on, until no key of the universe is wrong. A
key is listed iff the first level that it fails has an even number, or if it passes all of an
odd number of levels. For keys of the universe that is exact, and no join is needed: the
filters are binary literals in the expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import Filter, build_filter
from .common import lower_ascii, materialise

class Cascade:
    """Filters by level."""

    def __init__(self, levels: list[Filter]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        """Whether the key is listed (exact for keys of the universe); null for a null key."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            verdict = F.when(~self.levels[level].passes(key), F.lit(level % 2 == 1)).otherwise(verdict)
        return F.when(key.isNotNull(), verdict)


def build_cascade(listed: DataFrame, universe: DataFrame, rate: float = 0.5) -> Cascade:
    """Cascade for the column `key` of `listed` over that of `universe` (all keys that will be
    asked for; keys that are only listed belong to it too). Null keys are ignored; repeated keys
    count once; an empty list gives a cascade that lists nothing. Level 1's rate falls with the
    ratio of unlisted to listed keys, the others halve what is left, so the sum of the sizes
    follows the number of listed keys times the logarithm of that ratio."""
    yes = materialise(listed.select("key").where("key is not null").distinct())
    n = yes.count()
    if not n:
        return Cascade([])
    rest = materialise(universe.select("key").where("key is not null").distinct().join(yes, "key", "left_anti"))
    others = rest.count()
    cascade = Cascade([])
    inside, outside = yes, rest
    while inside.take(1):
        level = len(cascade.levels)
        share = rate if level else min(rate, n / max(others, 1) * math.sqrt(rate))
        cascade.levels.append(build_filter(inside, max(share, 1e-6), level))
        inside, outside = materialise(outside.where(cascade.levels[level].passes(F.col("key")))), inside
    return cascade


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains where the url's path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, up to /, ?, # or the end, A-Z lower-cased) and path (from there
    up to ?, # or the end); both empty for null and where :// is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def _candidates(host: Column, path: Column, rules) -> Column:
    """Keys of all rules that could fit: every suffix of the host at a dot, with the url's path
    cut to each length that the rules' paths have."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    none = F.array().cast("array<string>")

    def of_length(size: int) -> Column:
        cut = F.substring(path, F.lit(1), F.lit(size))
        return F.when(F.length(path) >= size, F.transform(suffixes, lambda s: F.concat(s, cut))).otherwise(none)

    by_length = [of_length(size) for size in sorted({len(r.path) for r in rules})]
    return F.array_distinct(F.concat(*by_length))


def judge_urls(pages: DataFrame, listed_hosts: DataFrame | None = None, rules=RULES, url: str = "url") -> DataFrame:
    """page_id, host, path, rule (the longest fitting rule's key, else null) and verdict (the
    rule's, else `block` for a host in `listed_hosts` (column key), else `allow`).

    Three cascades decide: which of a url's candidate keys is a rule, which rule blocks, which
    host is listed; their universe is all keys of `pages`. Null urls and urls without :// have
    empty host and path, fit no rule and are allowed unless the empty host is listed. Repeated
    rows stay; other columns are ignored; an empty table gives an empty result. The pages
    themselves are not shuffled, only their distinct keys are.
    """
    host, path = split_url(F.col(url))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    spark = pages.sparkSession
    keys = spark.createDataFrame([(r.key, r.verdict) for r in rules], "key string, verdict string")
    asked = parts.select(F.explode(_candidates(F.col("host"), F.col("path"), rules)).alias("key")).distinct()
    is_rule = build_cascade(keys, asked.union(keys.select("key")))
    blocks = build_cascade(keys.where("verdict = 'block'"), keys)
    hosts = build_cascade(listed_hosts, parts.select(F.col("host").alias("key"))) if listed_hosts is not None else Cascade([])
    fitting = F.filter(_candidates(F.col("host"), F.col("path"), rules), is_rule.contains)
    longest = F.array_max(F.transform(fitting, lambda k: F.struct(F.length(k).alias("size"), k.alias("key"))))
    judged = parts.withColumn("rule", longest["key"])
    by_rule = F.when(blocks.contains(F.col("rule")), "block").otherwise("allow")
    by_list = F.when(hosts.contains(F.col("host")), "block").otherwise("allow")
    return judged.withColumn("verdict", F.when(F.col("rule").isNotNull(), by_rule).otherwise(by_list))


#: Host labels that put a host on the query's list (fixed values).
LISTED_LABELS = ("casino-win", "free-bets", "cheap-pills", "ads-track")


def listed_by_label(pages: DataFrame, url: str = "url") -> DataFrame:
    """Distinct hosts (key) of pages that have one of LISTED_LABELS among their labels."""
    host, _ = split_url(F.col(url))
    hit = F.arrays_overlap(F.split(F.col("key"), r"\."), F.array(*(F.lit(x) for x in LISTED_LABELS)))
    return pages.select(host.alias("key")).distinct().where(hit)


ORACLE = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(coalesce(r, ''), length(regexp_extract(coalesce(r, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest),
rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS rn
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN list_has_any(string_split(host, '.'),
         ['casino-win', 'free-bets', 'cheap-pills', 'ads-track']) THEN 'block' ELSE 'allow' END) AS verdict
FROM fit WHERE rn = 1
"""
