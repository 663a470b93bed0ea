"""URL filters by a sort-merge range join.

A url's key is its host with the labels reversed and a closing dot, ``net.example.blog.``;
the keys of a rule's host and of all its subdomains form an interval that starts at the
rule's own key. Urls are range-partitioned and sorted by key; one sweep goes along a
partition with the rules' hosts sorted the same way and keeps a stack of those whose
intervals are open. Intervals nest or are disjoint, so closing is popping.

Paths can't be part of that interval, since a rule's path holds for all subdomains. Within an
open host its rules are sorted by path; prefixes nest too, so the longest that fits is found
from the url's place in that order, upwards. Of the open hosts' best rules the longest wins.

Rules are broadcast in blocks of a bounded number; urls aren't joined with each rule. Between
blocks the winner's whole rank is compared, so the size of a block changes no verdict.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches

BLOCK = 200_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def key(self) -> str:
        return ".".join(reversed(self.host.split("."))) + "."

    @property
    def rank(self) -> tuple[int, int, bool]:
        """The longest rule wins; of equal length the one with the longer host, then a block."""
        return len(self.name), len(self.host), self.verdict == "block"


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


@dataclass
class Host:
    """The rules of one host: by ascending path, each with the longest other that is a prefix of it (or -1)."""

    key: str
    within: int  # the closest enclosing host, or -1
    rules: list[Rule] = field(default_factory=list)
    above: list[int] = field(default_factory=list)

    def best(self, path: str) -> Rule | None:
        i = bisect_right(self.rules, path, key=lambda r: r.path) - 1
        while i >= 0 and not path.startswith(self.rules[i].path):
            i = self.above[i]
        return self.rules[i] if i >= 0 else None


def _enclosing(names: list[str]) -> list[int]:
    """Of each of ascending names the last before it that is a prefix of it, or -1."""
    out, stack = [], []
    for i, name in enumerate(names):
        while stack and not name.startswith(names[stack[-1]]):
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return out


def hosts(rules: list[Rule]) -> list[Host]:
    """Hosts by ascending key; of rules with the same host and path a block wins."""
    own: dict[str, dict[str, Rule]] = {}
    for r in rules:
        paths = own.setdefault(r.key, {})
        paths[r.path] = max(paths.get(r.path, r), r, key=lambda x: x.rank)
    keys = sorted(own)
    out = [Host(k, i, [own[k][p] for p in sorted(own[k])]) for k, i in zip(keys, _enclosing(keys), strict=True)]
    for h in out:
        h.above = _enclosing([r.path for r in h.rules])
    return out


def sweep(known: list[Host]) -> Callable[[str, str], Rule | None]:
    """A function that takes the urls of a partition, (key, path) by ascending key, and gives each one's winning rule."""
    stack: list[int] = []
    n = -1

    def step(key: str, path: str) -> Rule | None:
        nonlocal n
        if n < 0:  # of the hosts before a partition's first url only those that enclose it are open
            n = bisect_right(known, key, key=lambda h: h.key)
            i = n - 1
            while i >= 0:
                if key.startswith(known[i].key):
                    stack.insert(0, i)
                i = known[i].within
        while n < len(known) and known[n].key <= key:
            while stack and not known[n].key.startswith(known[stack[-1]].key):
                stack.pop()
            stack.append(n)
            n += 1
        while stack and not key.startswith(known[stack[-1]].key):
            stack.pop()
        return max((r for i in stack if (r := known[i].best(path))), key=lambda r: r.rank, default=None)

    return step


def split_url(pages: DataFrame) -> DataFrame:
    """pages with host and path. Null urls and urls without :// have both empty."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    whole = F.instr(url, "://") > 0
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": F.when(whole, host).otherwise(""), "path": F.when(whole, path).otherwise("")})


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """A row per input row: page_id, host, path, rule, verdict.

    Takes page_id and url; other columns are ignored. Where no rule fits, rule is null and the
    verdict is ``default``. Null and odd urls have no host and fit no rule; very long ones are
    judged whole. Repeated rows are judged alike, and so are rules given twice; an empty table or
    no rules at all are fine.
    """
    urls = split_url(pages.select("page_id", "url")).withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")))
    ordered = sorted(set(rules), key=lambda r: (r.key, r.path, r.verdict))
    blocks = [hosts(ordered[i : i + BLOCK]) for i in range(0, len(ordered), BLOCK)]
    urls = urls.select("page_id", "host", "path", "key", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("host_length"))
    # the path and the id take part in the range, so that a frequent host is dealt over several tasks
    urls = urls.repartitionByRange("key", "path", "page_id").sortWithinPartitions("key")
    for block in blocks:
        held = pages.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held):
            step = sweep(held.value)
            for batch in batches:
                keys, paths, names, verdicts, lengths = (batch.column(c).to_pylist() for c in ("key", "path", "rule", "verdict", "host_length"))
                for i, (key, path) in enumerate(zip(keys, paths, strict=True)):
                    r = step(key, path)
                    if r and (names[i] is None or r.rank > (len(names[i]), lengths[i], verdicts[i] == "block")):
                        names[i], verdicts[i], lengths[i] = r.name, r.verdict, len(r.host)
                yield {c: batch.column(c) for c in ("page_id", "host", "path", "key")} | {"rule": pa.array(names, pa.string()), "verdict": pa.array(verdicts, pa.string()), "host_length": pa.array(lengths, pa.int32())}

        urls = map_batches(urls, f"page_id {dict(urls.dtypes)['page_id']}, host string, path string, key string, rule string, verdict string, host_length int", run)
    return urls.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
r AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM h),
m AS (SELECT *,
  (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') AS a,
  (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') AS b,
  (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') AS c,
  (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') AS d FROM p)
SELECT page_id, host, path,
  CASE WHEN b THEN 'example.net/en/' WHEN c THEN 'example.com/de/' WHEN d THEN 'org/fr/' WHEN a THEN 'net/' END AS rule,
  CASE WHEN b THEN 'allow' WHEN c THEN 'block' WHEN d THEN 'allow' WHEN a THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
