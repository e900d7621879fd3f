"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are cut into lower-case runs of letters, digits and underscores.
Windows of MIN_MATCH tokens that a document shares with an item are the seeds; they are joined by
their hashes, and only a document and an item that meet in enough of them go on: tiles of MIN_MATCH
tokens or more that cover a share of an item hold a fifth as many windows at least (for windows of
five). Only the stretches of the document that the item's seeds cover can hold matches. There, the
longest common stretches are found by Karp-Rabin hashes of falling lengths and marked in both
texts, so that no token is used twice, until none of MIN_MATCH tokens is left. The marked share of
the item's tokens is the coverage; the order of the passages does not matter to it. A document with
an item covered to THRESHOLD or more is contaminated.

A benchmark of at most BENCHMARK_BYTES of text goes to the workers as one broadcast, and the join
is a search in its sorted seeds. A larger one stays distributed: the documents' window hashes are
shuffled to its seeds. Both give the same rows.

Edge cases: a null text has no tokens; items of fewer than MIN_MATCH tokens are no evidence and are
never found; items with the same text are each reported; repeated documents are each judged; of
equally long matches the first in the item, then in the document, is marked; texts are whole
however long; a column named leaks is replaced, all others pass through.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.blocks import mixed
from tessella.llm.runtime import numbered, quoted, ship, stored, table

MIN_MATCH = 5
THRESHOLD = 0.5
BENCHMARK_BYTES = 16 << 20
WORDS_KEPT = 500_000
LEAK = "struct<item_id:bigint,tiles:int,matched_tokens:int,item_tokens:int,coverage:double>"
LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("tiles", pa.int32()), ("matched_tokens", pa.int32()), ("item_tokens", pa.int32()), ("coverage", pa.float64())]))
WORDS = re.compile(r"\w+").findall
BASE, PRIME = 1_000_003, (1 << 61) - 1


def running(tokens: list[int], size: int, marked: bytearray) -> Iterator[tuple[int, int]]:
    """Start and Karp-Rabin hash of every window of unmarked tokens."""
    top = pow(BASE, size - 1, PRIME)
    value = length = 0
    for i, t in enumerate(tokens):
        if marked[i]:
            value = length = 0
            continue
        if length == size:
            value = (value - (tokens[i - size] + 2) * top) % PRIME
        else:
            length += 1
        value = (value * BASE + t + 2) % PRIME
        if length == size:
            yield i - size + 1, value


def common(a: list[int], i: int, b: list[int], j: int, most: int) -> int:
    """How many tokens, up to most, are equal from i and j on."""
    if a[i : i + most] == b[j : j + most]:
        return most
    n, step = 0, 1
    while a[i + n : i + n + step] == b[j + n : j + n + step]:
        n, step = n + step, 2 * step
    while step > 1:  # the first difference lies within the next step tokens
        step = (step + 1) // 2
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
    return min(n, most)


def matches(text: list[int], item: list[int], size: int, in_text: bytearray, in_item: bytearray) -> list[tuple[int, int, int]]:
    """(length, place in item, place in text) of common unmarked stretches of size or more that can't be made longer on either side."""
    # By hash, then by the token before: a window that follows an equal token lies inside a longer match.
    places: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for t, h in running(text, size, in_text):
        places[h][text[t - 1] if t and not in_text[t - 1] else -2].append(t)
    found = []
    if not places:
        return found
    for p, h in running(item, size, in_item):
        before = item[p - 1] if p and not in_item[p - 1] else -3
        for other, starts in places.get(h, {}).items():
            if other == before:
                continue
            end = in_item.find(1, p)
            room = (len(item) if end < 0 else end) - p
            for t in starts:
                end = in_text.find(1, t)
                n = common(item, p, text, t, min(room, (len(text) if end < 0 else end) - t))
                if n >= size:  # else the hash was equal by chance
                    found.append((n, p, t))
    return found


def tile(text: list[int], item: list[int], least: int) -> tuple[int, int]:
    """Tiles and tokens of item that they cover. Negative tokens in text match nothing."""
    in_text, in_item = bytearray(t < 0 for t in text), bytearray(len(item))
    tiles = covered = 0
    size = max(least, min(len(item), len(text)))
    while True:
        found = matches(text, item, size, in_text, in_item)
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        waiting = [(-n, p, t) for n, p, t in found]
        heapify(waiting)
        while waiting:
            n, p, t = heappop(waiting)
            n = -n
            first = min(x for x in (in_item.find(1, p, p + n) - p, in_text.find(1, t, t + n) - t, n) if x >= 0)
            if first == n:
                in_item[p : p + n], in_text[t : t + n] = b"\1" * n, b"\1" * n
                tiles += 1
                covered += n
                continue
            # Tiles took parts of it: each stretch that is left waits for its turn.
            taken = [a or b for a, b in zip(in_item[p : p + n], in_text[t : t + n], strict=True)]
            start = 0
            for i, x in enumerate([*taken, 1]):
                if x:
                    if i - start >= size:
                        heappush(waiting, (start - i, p + start, t + start))
                    start = i + 1
        if size == least:
            return tiles, covered
        size = max(least, size // 2)


class Hashed:
    """Words to 64-bit hashes, of which some are kept."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def words(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def windows(self, words: list[str], size: int) -> np.ndarray:
        """Hash of the size words from each place on."""
        if len(words) < size:
            return np.zeros(0, dtype=np.uint64)
        h = self.words(words)
        out = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(out) + k]
        return mixed(out)


def needed(tokens: int, least: int, threshold: float) -> int:
    """Windows of an item that a document has at least if tiles cover the threshold: a tile of n >= least tokens has n - least + 1 of them, n / least or more."""
    return max(1, int(np.ceil(threshold * tokens / least - 1e-9)))


def leak(item_id: int | None, item: list[str], words: list[str], starts: list[int], least: int, threshold: float) -> dict | None:
    """What tiling says of an item and a document whose shared windows start at starts; None below the threshold."""
    number: dict[str, int] = {}
    of_item = [number.setdefault(w, len(number)) for w in item]
    part, end = [], None
    for s in starts:  # the stretches that this item's seeds cover, with a token between them that matches nothing
        if end is not None and s > end:
            part.append(-1)
        part += [number.get(w, -1) for w in words[max(s, end or 0) : s + least]]
        end = s + least
    tiles, covered = tile(part, of_item, least)
    if covered < threshold * len(item):
        return None
    return {"item_id": item_id, "tiles": tiles, "matched_tokens": covered, "item_tokens": len(item), "coverage": covered / len(item)}


def by_id(leaks: list[dict]) -> list[dict]:
    return sorted(leaks, key=lambda x: (x["item_id"] is not None, x["item_id"] or 0))


class Benchmark:
    """Items with their seeds in hash order."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int, threshold: float):
        self.least, self.threshold, self.hashed = least, threshold, Hashed()
        self.items = [(i, WORDS((t or "").lower())) for i, t in items]
        each = [self.hashed.windows(w, least) for _, w in self.items]
        seeds = np.concatenate([*each, np.zeros(0, dtype=np.uint64)])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[order], np.repeat(np.arange(len(each)), [len(h) for h in each])[order]
        self.needed = np.array([needed(len(w), least, threshold) for _, w in self.items], dtype=np.int64)

    def leaks(self, text: str) -> list[dict]:
        words = WORDS(text.lower())
        h = self.hashed.windows(words, self.least)
        if not len(h) or not len(self.seeds):
            return []
        at = np.searchsorted(self.seeds, h)
        starts = np.flatnonzero(self.seeds[np.minimum(at, len(self.seeds) - 1)] == h)
        if not len(starts):
            return []
        distinct = np.unique(h[starts])
        low, high = np.searchsorted(self.seeds, distinct), np.searchsorted(self.seeds, distinct, side="right")
        who = np.concatenate([self.owner[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        met = np.bincount(who, minlength=len(self.items))
        out = []
        for k in np.flatnonzero(met >= self.needed).tolist():
            number, item = self.items[k]
            own = self.hashed.windows(item, self.least)
            out.append(leak(number, item, words, starts[np.isin(h[starts], own)].tolist(), self.least, self.threshold))
        return by_id([x for x in out if x])


_indexes: dict[tuple, Benchmark] = {}


def index_of(name: str, items: list[tuple], min_match: int, threshold: float) -> Benchmark:
    """One index of a broadcast benchmark for each worker, kept for its other tasks."""
    key = (name, min_match, threshold)
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Benchmark(items, min_match, threshold)
    return _indexes[key]


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, most_bytes: int = BENCHMARK_BYTES, text: str = "text") -> DataFrame:
    """docs with leaks: the items that each document covers to the threshold or more. most_bytes: of a benchmark that is broadcast."""
    spark = docs.sparkSession
    ship(spark)
    docs, benchmark = docs.drop("leaks"), benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    if benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"] > most_bytes:
        return joined_leaks(docs, benchmark, min_match, threshold, text)
    rows, (body,) = numbered(docs, text)
    sent = spark.sparkContext.broadcast([tuple(r) for r in benchmark.orderBy("item_id", "text").collect()])
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm.tiling import LEAKS, index_of

        index = index_of(name, sent.value, min_match, threshold)
        for b in batches:
            found = [index.leaks(t.as_py() or "") for t in b.column(body)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, LEAKS)], names=[*b.schema.names, "leaks"])

    made = rows.mapInArrow(run, T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"leaks array<{LEAK}>").fields]))
    return made.toDF(*docs.columns, "leaks")


def joined_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int, threshold: float, text: str) -> DataFrame:
    """find_leaks for a benchmark of any size: the seeds of both sides meet in a join, then the texts of the pairs that are left."""
    own = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(quoted(text)).alias("text"), F.struct(*own).alias("own")), "documents")
    items = stored(benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").alias("item_text")), "items")

    def windows(key: str, body: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from tessella.llm.tiling import WORDS, Hashed, needed

            hashed = Hashed()
            for b in batches:
                for i in range(b.num_rows):
                    words = WORDS((b.column(body)[i].as_py() or "").lower())
                    h, times = np.unique(hashed.windows(words, min_match), return_counts=True)
                    n = len(h)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.column(key)[i].as_py()] * n, pa.int64()), pa.array(h.astype(np.int64)), pa.array(times, pa.int64()), pa.array([needed(len(words), min_match, threshold)] * n, pa.int64())],
                        names=[key, "h", "times", "needed"],
                    )

        return run

    seeds = stored(items.select("item", "item_text").mapInArrow(windows("item", "item_text"), "item long, h long, times long, needed long"), "seeds")
    having = rows.select("row", "text").mapInArrow(windows("row", "text"), "row long, h long, times long, needed long").select("row", "h")
    met = having.join(seeds, "h").groupBy("row", "item").agg(F.sum("times").alias("met"), F.first("needed").alias("needed")).where("met >= needed")
    pairs = stored(met.select("row", "item"), "pairs").join(items, "item").join(rows.select("row", "text"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm.tiling import LEAKS, WORDS, Hashed, leak

        hashed = Hashed()
        for b in batches:
            out = []
            for row, number, item, body in zip(*(b.column(c).to_pylist() for c in ("row", "item_id", "item_text", "text")), strict=True):
                item, words = WORDS(item.lower()), WORDS(body.lower())
                starts = np.flatnonzero(np.isin(hashed.windows(words, min_match), hashed.windows(item, min_match)))
                found = leak(number, item, words, starts.tolist(), min_match, threshold)
                if found:
                    out.append((row, found))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([x for _, x in out], LEAKS.value_type)], names=["row", "leak"])

    found = pairs.select("row", "item_id", "item_text", "text").mapInArrow(run, f"row long, leak {LEAK}")
    found = stored(found.groupBy("row").agg(F.sort_array(F.collect_list("leak")).alias("leaks")), "leaks")
    back = [F.col(f"own.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return rows.join(found, "row", "left").select(*back, F.coalesce("leaks", F.array().cast(f"array<{LEAK}>")).alias("leaks"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each contaminated document and the item it holds."""
    docs = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
