"""URL filters by longest-match rules and a Bloom filter cascade.

A cascade stores which keys of a *complete, known* key universe are listed. Level 0 is a Bloom filter of the
listed keys; level 1 one of the unlisted keys that level 0 wrongly holds; level 2 one of the listed keys that
level 1 wrongly holds, and so on until a level has no false positive left. The first level that does not hold a
key decides, so for every key of the universe the answer is exact, and looking a key up is a few bit tests in an
expression: no join, no shuffle. The list of hosts is made from a table of domains, which may be of any size; it and the
levels are built by aggregations and joins of distinct hosts.

Null urls, and urls without a host, have an empty host, which no domain but an empty one lists. Repeated rows are judged
alike, each on its own. An empty table gives no rows, an empty list blocks nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, column_of, delete, fresh, stored


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to
    ``?``, ``#`` or the end. Both are empty for null and for an url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (null: none). A rule fits its host and all subdomains if the
    path starts with the rule's; equally long rules go by name."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def test_bits(bitmap: Column, key: Column, level: int, bits: int, hashes: int) -> Column:
    """Whether all of the key's bits are set in the bitmap (array<bigint>)."""
    test = F.lit(True)
    for p in positions(key, level, bits, hashes):
        word = F.get(bitmap, F.shiftright(p, 6).cast("int"))
        test &= F.expr("1").cast("long") == F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return test


@dataclass
class Level:
    """A bitmap as a literal, for use inside lambda functions."""

    bits: int
    hashes: int
    words: list[int] = field(repr=False)

    def holds(self, key: Column, level: int) -> Column:
        # folded by the optimizer into one literal array, so the test is an array access
        return test_bits(F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>"), key, level, self.bits, self.hashes)


@dataclass
class Bitmap:
    """A bitmap as a table of one row (words array<bigint>), which a query reads once, as a scalar subquery."""

    bits: int
    hashes: int
    table: DataFrame = field(repr=False)

    def holds(self, key: Column, level: int) -> Column:
        return test_bits(self.table.scalar(), key, level, self.bits, self.hashes)


def positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """Double hashing, seeded by the level; stays below 2**63, as sums may not overflow."""
    a = F.pmod(F.xxhash64(key, F.lit(f"a{level}")), F.lit(bits).cast("long"))
    b = F.pmod(F.xxhash64(key, F.lit(f"b{level}")), F.lit(bits).cast("long"))
    return [F.pmod(a + F.lit(i).cast("long") * b + F.lit(i * i), F.lit(bits).cast("long")) for i in range(hashes)]


class BloomCascade:
    """Exact membership of a column's keys in a listed set.

    ``universe`` has columns key (string) and listed (boolean): each key once or more often; a key with any listed
    row is listed, null keys are dropped (a null key is never listed). Every key that is looked up later must be in
    the universe, else its answer may be a false positive.

    A level's bitmap goes to every executor, once. ``max_bits`` bounds it (2**26 bits are 8 MB). A list that needs more
    raises ``TooLarge``; `filter_urls` then looks its hosts up by a join.
    An empty list, an empty universe and a list that is the whole universe need no special case: with no listed
    key there is no level, and nothing is listed.
    """

    class TooLarge(ValueError):
        pass

    def __init__(self, universe: DataFrame, first_rate: float = 0.01, rate: float = 0.5, max_bits: int = 1 << 26):
        keys, path = stored(universe.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("listed").alias("listed")), "cascade")
        self.levels: list[Bitmap] = []
        listed, rest = keys.where("listed"), keys.where("NOT coalesce(listed, false)")
        side, other = listed, rest
        while n := side.count():
            p = first_rate if not self.levels else rate
            hashes = max(1, math.ceil(-math.log2(p)))
            bits = max(64, -(-math.ceil(n * hashes / math.log(2)) // 64) * 64)
            if bits > max_bits:
                raise self.TooLarge(f"level {len(self.levels)} needs {bits} bits, over max_bits={max_bits}")
            level = self._build(side, len(self.levels), bits, hashes)
            other = other.where(level.holds(F.col("key"), len(self.levels)))
            self.levels.append(level)
            side, other = other, side
        delete(universe.sparkSession, path)

    @staticmethod
    def _build(keys: DataFrame, level: int, bits: int, hashes: int) -> Bitmap:
        p = F.col("p")
        words = (
            keys.select(F.explode(F.array(*positions(F.col("key"), level, bits, hashes))).alias("p"))
            .groupBy(F.shiftright(p, 6).alias("w"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
        )
        every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(words, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
        # one row of bits / 64 words, bounded by max_bits
        one = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))
        return Bitmap(bits, hashes, stored(one, "bitmap")[0])

    def listed(self, key: Column) -> Column:
        """Whether the key is listed: the first level without it decides; odd levels hold unlisted keys."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].holds(key, i), F.lit(i % 2 == 1)).otherwise(out)
        return F.when(key.isNull(), False).otherwise(out)


def listed_keys(df: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """Rows of df whose key is listed, by a semi join."""
    return df.join(listed.select(F.col("key").alias(key)), key, "left_semi")


def hosts_under(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """The distinct (key) of hosts that are one of the domains (domain), or a subdomain of one. A host is looked up by its
    ends, of no more labels than the longest domain has."""
    labels = F.split("key", r"\.")
    most = domains.agg(F.max(F.size(F.split("domain", r"\.")))).first()[0] or 0
    n = F.size(labels)
    ends = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(1, most)))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    tried = hosts.select("key").where(F.col("key").isNotNull()).distinct().select("key", F.explode(ends).alias("domain"))
    return tried.join(domains.select("domain").distinct(), "domain", "left_semi").select("key").distinct()


def filter_urls(pages: DataFrame, rules: list[Rule], blocked: DataFrame | tuple[str, ...], max_bits: int = 1 << 26) -> DataFrame:
    """All columns of pages (page_id, url needed) with host, path, rule and verdict appended; columns that pages
    already has under these names are replaced. ``blocked`` is a table of domains (domain), or some of them. The cascade's
    list is every host of the pages under one of them, its universe every host of the pages. If that needs over
    ``max_bits`` bits a level, hosts are looked up by a join with the list, with the same result."""
    spark, name = pages.sparkSession, fresh(pages, "listed_host")
    domains = blocked if isinstance(blocked, DataFrame) else column_of(spark, "domain", list(blocked))
    host, path = host_path(F.col("url"))
    hosts = pages.select(host.alias("key")).distinct()
    listed, _ = stored(hosts_under(hosts, domains), "listed")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    out = pages.withColumn("host", host).withColumn("path", path)
    try:
        cascade = BloomCascade(hosts.withColumn("listed", F.lit(False)).unionByName(listed.withColumn("listed", F.lit(True))), max_bits=max_bits)
        found = cascade.listed(F.col("host"))
    except BloomCascade.TooLarge:
        out = out.join(listed.select(F.col("key").alias(name)), F.col("host") == F.col(name), "left")
        found = F.col(name).isNotNull()
    names = [*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")], "host", "path"]
    return out.select(*[F.col(f"`{c}`") for c in names], rule.alias("rule"), F.coalesce(verdict, F.when(found, "block").otherwise("allow")).alias("verdict"))
