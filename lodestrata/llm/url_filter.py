"""URL filtering by a Bloom filter cascade.

A rule (action, host, path) fits its host and all subdomains where the url's path
starts with the rule's. A url's candidate keys are its host suffixes joined with
its path prefixes, for the label counts and path lengths that rules have; the
longest listed candidate decides.

Listed keys and the corpus's candidate keys make up the complete key universe.
Level 1 of a cascade encodes the listed keys; level 2 the unlisted candidates that
level 1 lets through; level 3 the listed keys that level 2 lets through, and so
on until nothing false is left: membership is exact for every key of the corpus,
without a join. With a first-level rate of about r / (s * sqrt 2), for r listed and
s other keys, level 2 holds about 0.7 r keys: what is collected and broadcast
follows the list (at most `max_listed` keys), not the corpus.

Defined results: a null url, or one without "://", has an empty host and path and
no rule; no rule means `default`; of a key listed twice "block" holds; of
candidates of one length the longer host wins; very long urls are judged whole;
repeated rows are each returned; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, quoted

#: The contract's rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MAX_LISTED = 5_000_000


class Bloom:
    """A Bloom filter over UTF-8 keys; `level` seeds its hashes."""

    def __init__(self, keys: Sequence[str], rate: float, level: int):
        n, rate = max(1, len(keys)), min(0.5, max(rate, 1e-12))
        self.m = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.k = max(1, round(-math.log2(rate)))
        self.level, self.bits = level, bytearray(self.m // 8 + 1)
        for key in keys:
            for i in self._places(key):
                self.bits[i >> 3] |= 1 << (i & 7)

    def _places(self, key: str) -> Iterator[int]:
        import xxhash

        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.level)
        a, b = h & (1 << 64) - 1, h >> 64 | 1
        for i in range(self.k):
            yield (a + i * b) % self.m

    def __contains__(self, key: str) -> bool:
        return all(self.bits[i >> 3] >> (i & 7) & 1 for i in self._places(key))


class Cascade:
    """Exact membership for listed keys and for every key whose false positives at level 1 were given."""

    def __init__(self, first: Bloom, listed: Sequence[str], false_first: Sequence[str], max_levels: int = 64):
        self.levels = [first]
        inside, outside = list(listed), list(false_first)
        while outside and len(self.levels) < max_levels:
            level = Bloom(outside, 0.5, len(self.levels))
            self.levels.append(level)
            inside, outside = outside, [k for k in inside if k in level]
        self.rest = frozenset(outside)  # what 64 levels have not told apart; empty but for astonishing chance

    def __contains__(self, key: str) -> bool:
        for depth, level in enumerate(self.levels):
            if key not in level:
                return depth % 2 == 1
        return (len(self.levels) % 2 == 1) != (key in self.rest)


def candidates(host: str, path: str, labels: Sequence[int], lengths: Sequence[int]) -> list[tuple[str, str]]:
    """(host suffix, path prefix) pairs, longest first."""
    parts = host.split(".") if host else []
    hosts = [".".join(parts[-n:]) for n in labels if n <= len(parts)]
    paths = [path[:n] for n in lengths if n <= len(path)]
    return sorted(((h, p) for h in hosts for p in paths), key=lambda c: (-len(c[0]) - len(c[1]), -len(c[0])))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    text, pattern = F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def _shape(rules: Sequence[tuple[str, str, str]]) -> tuple[list[int], list[int]]:
    return sorted({h.count(".") + 1 for _, h, _ in rules}), sorted({len(p) for _, _, p in rules})


def build_cascades(df: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url", max_listed: int = MAX_LISTED) -> dict[str, Cascade]:
    """Cascades of the block and the allow list over all urls of `df`. Runs two jobs: a count, and the search for level 1's false positives."""
    if len(rules) > max_listed:
        raise ValueError(f"{len(rules)} rules; the broadcast bound is {max_listed}")
    labels, lengths = _shape(rules)
    block = sorted({h + p for a, h, p in rules if a == "block"})
    allow = sorted({h + p for a, h, p in rules if a == "allow"} - set(block))
    keys = {"block": block, "allow": allow}
    host, path = url_parts(F.col(url_col))
    urls = df.select(host.alias("host"), path.alias("path")).filter("host <> ''")
    others = max(1, urls.count() * max(1, len(labels)) * max(1, len(lengths)))
    rates = {a: len(k) / (others * math.sqrt(2)) for a, k in keys.items()}
    while True:
        first = {a: Bloom(k, rates[a], 0) for a, k in keys.items()}
        sent = df.sparkSession.sparkContext.broadcast(first)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            filters = sent.value
            for b in batches:
                found = {
                    (a, h + p)
                    for host_, path_ in zip(b["host"], b["path"])
                    for h, p in candidates(host_, path_, labels, lengths)
                    for a, f in filters.items()
                    if h + p in f
                }
                yield pd.DataFrame(sorted(found), columns=["list", "key"])

        # the listed keys that occur come back too, and are taken off here: only filters are sent out
        bound = 9 * len(rules) + 1000
        passed = urls.mapInPandas(search, "list string, key string").distinct().limit(bound + 1).collect()
        if len(passed) <= bound:
            found = {a: {r["key"] for r in passed if r["list"] == a} for a in keys}
            return {a: Cascade(first[a], k, sorted(found[a].difference(k))) for a, k in keys.items()}
        rates = {a: r / 16 for a, r in rates.items()}  # an unlucky level 1: make it larger, drop nothing


def judge_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """`df` with host, path, rule and verdict in place of columns of those names."""
    labels, lengths = _shape(rules)
    sent = df.sparkSession.sparkContext.broadcast(build_cascades(df, rules, url_col))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        cascades = sent.value
        out = []
        for host, path in zip(hosts, paths):
            for h, p in candidates(host, path, labels, lengths):
                action = next((a for a, c in cascades.items() if h + p in c), None)
                if action:
                    out.append((h + p, action))
                    break
            else:
                out.append((None, default))
        return pd.DataFrame(out, columns=["rule", "verdict"])

    host, path = url_parts(F.col(url_col))
    kept = quoted([c for c in df.columns if c not in ("host", "path", "rule", "verdict")])
    judged = df.select(*kept, host.alias("host"), path.alias("path")).withColumn("__ls_j", judge("host", "path"))
    return judged.select(*kept, "host", "path", "__ls_j.rule", "__ls_j.verdict")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


ORACLE = r"""
WITH u AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, arg_max(h || p, len(h || p)) AS rule, arg_max(verdict, len(h || p)) AS verdict
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""
