"""Block and allow rules for URLs by a sort-merge range join.

A host is turned round label by label ("a.b.net" -> "net.b.a."), so that a rule's host and all
its subdomains are one interval of keys. URLs and rules are dealt by ranges of that key, a rule
to each range that its interval touches; within a range one sweep in key order keeps a stack of
the intervals that are open, which nest. A URL looks only at the stack. (A rule's host and path are
no single interval: its subdomains lie between them in the key. So the paths of each host's rules are
intervals of their own, nested in the same way.)

The longest fitting rule (host and path together) wins; among equally long ones blocking wins,
then the rule's text. A hot host is split by key and, where one key spans several ranges, by a
hash of the row. Very long URLs are judged whole. Edge cases: a null URL or one without "://" has an empty host and path, fits no
rule and gets the default; repeated rows are judged each; columns named like the results are
replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.ranges import bounds, place
from tessella.llm.runtime import quoted, ship, shuffle_width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Paths:
    """The rules of one host by path. Paths are intervals too: in order, each knows the nearest one before it that it continues."""

    def __init__(self) -> None:
        self.rules: dict[str, tuple] = {}
        self.ordered: list[str] | None = None

    def add(self, path: str, found: tuple) -> None:
        self.rules[path] = min(self.rules.get(path, found), found)
        self.ordered = None

    def nested(self) -> list[str]:
        self.ordered, self.above, held = sorted(self.rules), [], []
        for i, path in enumerate(self.ordered):
            while held and not path.startswith(self.ordered[held[-1]]):
                held.pop()
            self.above.append(held[-1] if held else -1)
            held.append(i)
        return self.ordered

    def longest(self, path: str) -> tuple | None:
        """The rule of the longest path that this one starts with."""
        ordered = self.ordered if self.ordered is not None else self.nested()
        i = bisect_right(ordered, path) - 1
        while i >= 0 and not path.startswith(ordered[i]):
            i = self.above[i]
        return self.rules[ordered[i]] if i >= 0 else None


class Sweep:
    """Open intervals, outermost first; each holds its rules by path."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, Paths]] = []
        self.part = None

    def to(self, part: int, key: str) -> None:
        if part != self.part:
            self.part, self.stack = part, []
        while self.stack and not key < self.stack[-1][1]:
            self.stack.pop()

    def rule(self, key: str, end: str, path: str, text: str, verdict: str) -> None:
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, end, Paths()))
        self.stack[-1][2].add(path, (verdict != "block", text, verdict))

    def url(self, path: str) -> tuple[str | None, str | None]:
        best = None
        for _, _, paths in self.stack:
            found = paths.longest(path)
            if found:
                rank = (-len(found[1]), found[0], found[1])
                if best is None or rank < best[0]:
                    best = (rank, found)
        return (best[1][1], best[1][2]) if best else (None, None)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = Sweep()
    for b in batches:
        c = {n: b.column(n).to_pylist() for n in ("_part", "_key", "_kind", "_path", "_end", "_rule", "_verdict")}
        keep, rules, verdicts = [], [], []
        for i, (part, key, kind) in enumerate(zip(c["_part"], c["_key"], c["_kind"], strict=True)):
            at.to(part, key)
            if kind == 0:
                at.rule(key, c["_end"][i], c["_path"][i], c["_rule"][i], c["_verdict"][i])
            else:
                rule, verdict = at.url(c["_path"][i])
                keep.append(i)
                rules.append(rule)
                verdicts.append(verdict)
        row = b.column("_row").take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([row, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["_row", "rule", "verdict"])


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict; rules has host, path and verdict ("block" or "allow")."""
    ship(df.sparkSession)
    parts = max(1, shuffle_width(df.sparkSession))
    names = [c for c in df.columns if c == url or c not in ("host", "path", "rule", "verdict")]
    # Columns travel under numbers, so that no name of theirs can clash.
    own = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)]
    at_url = F.col(quoted(url))
    rows = df.select(F.struct(*own, host_of(at_url).alias("host"), path_of(at_url).alias("path")).alias("_row"))
    rows = rows.select(reversed_host(F.col("_row.host")).alias("_key"), F.lit(1).alias("_kind"), F.col("_row.path").alias("_path"), "_row")
    at = bounds(rows.select("_key", F.xxhash64("_row").alias("_salt")), "_key", parts)
    low, high = place(F.col("_key"), at, inclusive=False), place(F.col("_key"), at)
    rows = rows.withColumn("_part", low + F.pmod(F.xxhash64("_row"), high - low + 1).cast("int"))
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    edge = F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")
    given = rules.select(
        F.when(host == "", "").otherwise(F.concat(edge, F.lit("."))).alias("_key"),
        F.lit(0).alias("_kind"),
        F.coalesce("path", F.lit("")).alias("_path"),
        F.when(host == "", "\U0010ffff").otherwise(F.concat(edge, F.lit("/"))).alias("_end"),
        F.concat(host, F.coalesce("path", F.lit(""))).alias("_rule"),
        F.col("verdict").alias("_verdict"),
    )
    spread = F.sequence(place(F.col("_key"), at, inclusive=False), place(F.col("_end"), at))
    given = given.withColumn("_part", F.explode(spread))
    both = rows.unionByName(given, allowMissingColumns=True)
    both = both.repartitionById(parts, "_part").sortWithinPartitions("_part", "_key", "_kind")
    schema = T.StructType([both.schema["_row"], T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    made = both.mapInArrow(sweep, schema)
    back = [F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)]
    return made.select(*back, "_row.host", "_row.path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.createDataFrame(
        [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")],
        "host string, path string, verdict string",
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.)*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.v,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
