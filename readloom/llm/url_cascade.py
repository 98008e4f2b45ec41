"""URL rules through Bloom filter cascades over the corpus's complete key universe.

The keys of a URL are its host's suffixes of up to as many labels as some rule's host has, each joined to the
prefixes of its path that have the length of some rule's path. Level 1 encodes the listed keys; level 2 the corpus's keys
that pass level 1 without being listed; level 3 the listed keys that pass level 2; and so on until
no key is wrong. The first level that a key fails decides: failing an odd level means not listed,
an even one listed. For every key of this corpus that is exact, and looking a key up is a
narrow pass with a broadcast of a few bits for each rule: no join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.let import let
from readloom.llm.common import cut, lower_ascii

#: A rule list beyond this many keys isn't broadcast; the keys are then joined with it.
LARGEST = 5_000_000
BLOCK, ALLOW = "block", "allow"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int], most: int) -> Column:
    """All candidate keys of up to `most` labels, the longest first, the smallest by code points among equals."""
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda p: p.isNotNull())

    def suffixes(labels: Column) -> Column:
        every = F.transform(F.sequence(F.greatest(F.size(labels) - (most - 1), F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, most), "."))
        return F.filter(every, lambda s: s != "")

    keys = let(prefixes, lambda ps: F.flatten(F.transform(let(F.split(host, r"\."), suffixes), lambda s: F.transform(ps, lambda p: F.concat(s, p)))))
    longest_first = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.array_sort(F.array_distinct(keys), longest_first)


class Bloom:
    """Bits of one level. Keys come as two 64-bit hashes; the places are their combinations."""

    def __init__(self, n: int, rate: float):
        self.hashes = max(1, round(-math.log2(rate)))
        self.size = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
        self.bits = np.zeros((self.size + 7) // 8, np.uint8)

    def places(self, h1: np.ndarray, h2: np.ndarray, level: int):
        a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
        for i in range(self.hashes):
            yield (a + np.uint64(level * 1_000_003 + i) * b ^ (b >> np.uint64(7 + i))) % np.uint64(self.size)

    def add(self, h1, h2, level) -> None:
        for p in self.places(h1, h2, level):
            np.bitwise_or.at(self.bits, (p >> np.uint64(3)).astype(np.int64), (1 << (p & np.uint64(7))).astype(np.uint8))

    def has(self, h1, h2, level) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for p in self.places(h1, h2, level):
            out &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def listed(levels: list[Bloom], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Membership by the cascade: the first level failed decides, an odd number of levels passed means listed."""
    out, alive = np.zeros(len(h1), bool), np.arange(len(h1))
    for k, level in enumerate(levels):
        passed = level.has(h1[alive], h2[alive], k)
        out[alive[~passed]] = k % 2 == 1
        alive = alive[passed]
    out[alive] = len(levels) % 2 == 1
    return out


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))


def passing(spark: SparkSession, levels: list[Bloom]):
    """A function of a key's two hashes: whether it passes all these levels."""
    shared = spark.sparkContext.broadcast(levels)

    @F.pandas_udf("boolean")
    def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        a, b = h1.to_numpy(), h2.to_numpy()
        out = np.ones(len(a), bool)
        for k, level in enumerate(shared.value):
            out &= level.has(a, b, k)
        return pd.Series(out)

    return passes


def cascade(universe: DataFrame, rules: list[str], most_levels: int = 60) -> list[Bloom]:
    """Levels that are exact for every key of `universe` (column key, repeats allowed).
    Level 1 passes about as many unlisted keys as there are listed ones, so what is gathered from the
    corpus is bounded by the list, not by the corpus."""
    spark = universe.sparkSession
    own = spark.createDataFrame([(r,) for r in rules], "key string")
    got = own.select(*(h.alias(n) for h, n in zip(hashes(F.col("key")), ("a", "b")))).toPandas()
    yes_a, yes_b = got["a"].to_numpy(np.int64), got["b"].to_numpy(np.int64)
    total = universe.agg(F.approx_count_distinct("key")).first()[0]
    levels = [Bloom(len(rules), min(0.5, max(1e-9, len(rules) / max(1, total) / 2)))]
    levels[0].add(yes_a, yes_b, 0)
    passes = passing(spark, levels)
    h = hashes(F.col("key"))
    wrong = universe.where(passes(*h)).distinct().join(F.broadcast(own), "key", "left_anti")
    got = wrong.select(h[0].alias("a"), h[1].alias("b")).toPandas()
    no_a, no_b = got["a"].to_numpy(np.int64), got["b"].to_numpy(np.int64)
    # From here on both sets are of the list's size.
    sides = [(no_a, no_b), (yes_a, yes_b)]
    while len(sides[0][0]):
        if len(levels) >= most_levels:
            raise ValueError("the cascade doesn't end: a listed and an unlisted key have equal hashes")
        k, level = len(levels), Bloom(len(sides[0][0]), 0.5)
        level.add(*sides[0], k)
        levels.append(level)
        left = level.has(*sides[1], k)
        sides = [tuple(x[left] for x in sides[1]), sides[0]]
    return levels


def judge(df: DataFrame, rules: dict[str, str], default: str = ALLOW, id_column: str = "page_id", url_column: str = "url", largest: int = LARGEST) -> DataFrame:
    """(id, host, path, rule, verdict) for every row. rules: a host and path such as `net/` to block
    or allow; a rule fits its host and all subdomains whose path starts with the rule's; the
    longest rule wins, the smaller by code points among equals; without a rule the verdict is
    `default`, since the key is on no list. Null urls and urls without :// have an empty host and
    path, and no rule. Repeated rows stay repeated; an empty table gives no rows; further columns of `df` don't matter,
    whatever their names. Long urls cost in proportion to their length."""
    if any(v not in (BLOCK, ALLOW) for v in rules.values()) or any("/" not in r for r in rules):
        raise ValueError("a rule is a host and a path, to block or allow")
    url = F.col(url_column)
    lengths = sorted({len(r) - r.index("/") for r in rules})
    rows = df.select(F.col(id_column), host_of(url).alias("host"), path_of(url).alias("path"))
    lists = {v: [r for r, w in rules.items() if w == v] for v in (BLOCK, ALLOW)}
    labels = max((r[: r.index("/")].count(".") + 1 for r in rules), default=1)
    keys = keys_of(F.col("host"), F.col("path"), lengths, labels)
    if len(rules) > largest:
        return joined(rows, rules, default, id_column, keys)
    spark = df.sparkSession
    universe = rows.select(F.explode(keys).alias("key"))
    levels = {v: cascade(universe, rs) for v, rs in lists.items() if rs}
    shared = spark.sparkContext.broadcast(levels)

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def decide(keys: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        n = np.array([len(k) for k in keys], np.int64)
        empty = [np.empty(0, np.int64)]
        a, b = (np.concatenate([*map(np.asarray, h), *empty]).astype(np.int64) for h in (h1, h2))
        on = {v: listed(ls, a, b) for v, ls in shared.value.items()}
        hit = np.any([*on.values(), np.zeros(len(a), bool)], axis=0)
        row = np.repeat(np.arange(len(n)), n)
        first = np.full(len(n), -1, np.int64)
        at = np.flatnonzero(hit)[::-1]
        first[row[at]] = at  # the earliest, that is the longest, is written last
        starts = np.cumsum(n) - n
        rule = [keys.iloc[i][f - s] if f >= 0 else None for i, (f, s) in enumerate(zip(first, starts))]
        verdict = [next((v for v in on if on[v][f]), default) if f >= 0 else default for f in first]
        return pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": verdict})

    both = [F.transform("keys", lambda k: hashes(k)[0]), F.transform("keys", lambda k: hashes(k)[1])]
    got = rows.withColumn("keys", keys).withColumn("got", decide(F.col("keys"), *both))
    return got.select(id_column, "host", "path", F.col("got.rule").alias("rule"), F.col("got.verdict").alias("verdict"))


def joined(rows: DataFrame, rules: dict[str, str], default: str, id_column: str, keys: Column) -> DataFrame:
    """The same for a list too large to broadcast: candidate keys joined with the list."""
    spark = rows.sparkSession
    own = spark.createDataFrame(list(rules.items()), "key string, verdict string")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("keys", keys))
    found = rows.select("row", F.posexplode("keys").alias("at", "key")).join(own, "key").groupBy("row").agg(F.min(F.struct("at", "key", "verdict")).alias("m"))
    out = rows.join(found, "row", "left")
    return out.select(id_column, "host", "path", F.col("m.key").alias("rule"), F.coalesce("m.verdict", F.lit(default)).alias("verdict"))


RULES = {"net/": BLOCK, "example.net/en/": ALLOW, "example.com/de/": BLOCK, "org/fr/": ALLOW}

SQL = r"""
with p as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r(rule_host, rule_path, rule, verdict) as (values ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
  ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')),
m as (select p.*, (select max({'n': length(rule), 'rule': rule, 'verdict': verdict}) from r
        where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as best from p)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from m
"""
