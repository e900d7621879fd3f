"""Token counts of a sentencepiece BPE model by rank-synchronous merging in ragged arrays.

Texts are cut where no piece of the model reaches across (before a space mark, around
characters that no longer piece has), so each cut part is encoded by itself. New parts are
gathered, laid end to end in one array and merged in rounds: in a round every part applies its
pair of best rank, until no part has a pair left. What survives is counted.

A part above LONG symbols is first cut between characters that no piece holds side by side; what
is still longer would need a round for nearly each of its pairs, so its pairs wait in a heap by
rank and place instead, with the same result: the time grows with the length, not its square.

Edge cases: a null or empty text has no tokens; a character that the model lacks counts as its
UTF-8 bytes, as the model's byte fallback has it; ties of rank go to the leftmost pair; very long
texts are counted whole, a batch holds few of them; repeated rows are counted each; an empty table
stays empty; a column named like the result is replaced, all others pass through.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.byte_bpe import read_vocabulary
from tessella.llm.runtime import numbered, ship

MARK = "▁"
LONG = 256  # symbols in a part
KNOWN_BYTES = 128 << 20  # about what a worker keeps of parts that it has counted
KNOWN_CHARS = 64  # longer parts are not kept
BATCH_CHARS = 4 << 20  # characters of texts that are cut at once
NEVER = np.iinfo(np.int64).max


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            size = varint() if size is None else size
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """Pieces, ranks and pair table of a BPE model file with byte fallback."""

    def __init__(self, data: bytes):
        scores: dict[str, float] = {}
        dummy_prefix, model_type, fallback = True, 1, False
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                if piece.get(3, 1) in (1, 4):  # normal and user-defined pieces can be met in a text
                    scores[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            elif number == 2:
                spec = dict(fields(value))
                model_type, fallback = spec.get(3, 1), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(fields(value))
                dummy_prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models that leave texts as they are and mark spaces are supported")
        if model_type != 2 or not fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        self.dummy_prefix = dummy_prefix
        order = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        times = Counter(scores.values())
        self.chars: dict[str, int] = {}
        names = list(scores)
        self.id = {p: i for i, p in enumerate(names)}
        #: Characters outside the vocabulary come after the pieces.
        self.others: dict[str, int] = {}
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        children: dict[int, list[int]] = {}
        for p in names:
            single = [*p]
            for cut in range(1, len(single)):
                left, right = p[:cut], p[cut:]
                a, b = (self.id.get(x, self.symbol(x) if len(x) == 1 else None) for x in (left, right))
                if a is not None and b is not None:
                    pairs[a, b] = (order[scores[p]], self.id[p])
                    for child in (a, b):
                        children.setdefault(child, []).append(order[scores[p]])
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        sort = np.argsort(keys)
        self.keys = keys[sort]
        self.rank = np.array([v[0] for v in pairs.values()], dtype=np.int64)[sort]
        self.made = np.array([v[1] for v in pairs.values()], dtype=np.int64)[sort]
        #: A pair can be joined everywhere in a round if no tie exists and what it makes only takes part in later ranks.
        safe = {self.id[p]: times[scores[p]] == 1 and min(children.get(self.id[p], [NEVER])) > order[scores[p]] for p in names}
        self.safe = np.array([safe[m] for m in self.made.tolist()], dtype=bool)
        inner = {x for p in names if len(p) > 1 for x in p}
        crossing = any(a != MARK and b == MARK for p in names for a, b in zip(p, p[1:], strict=False))
        joints = np.array(sorted({ord(a) << 32 | ord(b) for p in names for a, b in zip(p, p[1:], strict=False)}), dtype=np.int64)
        self.joints = joints if len(joints) else np.array([-1], dtype=np.int64)
        self.table: dict[int, tuple[int, int]] = {}
        lone = "\n" if "\n" not in inner else ""
        self.cut = re.compile(f"[^{lone}]+|{lone}" if crossing and lone else "(?s:.+)" if crossing else f"{MARK}*[^{MARK}{lone}]+|{MARK}+" + (f"|{lone}" if lone else "")).findall

    def symbol(self, char: str) -> int:
        known = self.id.get(char)
        if known is None:
            known = self.others.setdefault(char, len(self.id) + len(self.others))
        return known

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        whole = self.cut((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))
        if len(text) <= LONG or max(map(len, whole)) <= LONG:
            return whole
        return [x for p in whole for x in (self.apart(p) if len(p) > LONG else (p,))]

    def apart(self, part: str) -> list[str]:
        """A part cut between characters that no piece holds side by side."""
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        key = code[:-1] << 32 | code[1:]
        at = np.minimum(np.searchsorted(self.joints, key), len(self.joints) - 1)
        cuts = np.flatnonzero(self.joints[at] != key) + 1
        return [part[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True)]

    def count_long(self, part: str) -> int:
        """As count, of one long part: the pair of best rank and leftmost place comes next from a heap."""
        if not self.table and len(self.keys):
            self.table = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))
        known, others = self.id, {}
        sym = [known[c] if c in known else others.setdefault(c, (1 << 31) - 1 - len(others)) for c in part]
        cost = {i: len(c.encode()) for c, i in others.items()}
        n, find = len(sym), self.table.get
        behind, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [pair[0] << 40 | i for i in range(n - 1) if (pair := find(sym[i] << 32 | sym[i + 1]))]
        heapify(waiting)
        while waiting:
            top = heappop(waiting)
            i = top & (1 << 40) - 1
            j = behind[i]
            if sym[i] < 0 or j >= n:
                continue
            pair = find(sym[i] << 32 | sym[j])
            if pair is None or pair[0] != top >> 40:  # an older pair of this place
                continue
            sym[i], sym[j] = pair[1], -1
            k = behind[i] = behind[j]
            if k < n:
                before[k] = i
                pair = find(sym[i] << 32 | sym[k])
                if pair:
                    heappush(waiting, pair[0] << 40 | i)
            h = before[i]
            if h >= 0:
                pair = find(sym[h] << 32 | sym[i])
                if pair:
                    heappush(waiting, pair[0] << 40 | h)
        return sum(cost.get(s, 1) for s in sym if s >= 0)

    def count(self, parts: list[str]) -> list[int]:
        """Surviving symbols of each part, bytes for characters that the model lacks."""
        if not parts:
            return []
        known, extra = self.id, {}
        symbols, cost = [], {}
        for p in parts:
            for c in p:
                i = known.get(c)
                if i is None:
                    i = self.others.get(c)
                    if i is None:
                        i = extra.setdefault(c, (1 << 31) - 1 - len(extra))
                    cost[i] = len(c.encode())
                symbols.append(i)
        sym = np.array(symbols, dtype=np.int64)
        seq = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        weight = np.zeros(len(parts), dtype=np.int64)
        sym, seq = self.merge(sym, seq, weight, cost)
        return weight.tolist()

    def look(self, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Index in the pair table of each symbol with its right neighbour, or -1."""
        key = sym[:-1] << 32 | sym[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), at, -1)

    def tally(self, sym: np.ndarray, seq: np.ndarray, weight: np.ndarray, cost: dict[int, int]) -> None:
        w = np.ones(len(sym), dtype=np.int64)
        if cost:
            rare = np.flatnonzero(np.isin(sym, np.fromiter(cost, np.int64)))
            w[rare] = [cost[s] for s in sym[rare].tolist()]
        np.add.at(weight, seq, w)

    def merge(self, sym: np.ndarray, seq: np.ndarray, weight: np.ndarray, cost: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        while len(sym) > 1 and len(self.keys):
            at = self.look(sym, seq)
            rank = np.where(at >= 0, self.rank[at], NEVER)
            heads = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            padded = np.r_[rank, NEVER]
            best = np.minimum.reduceat(padded, heads)
            done = best == NEVER
            own = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(sym)]))
            if done.any():  # finished parts leave the array
                out = done[own]
                self.tally(sym[out], seq[out], weight, cost)
                keep = ~out
                sym, seq = sym[keep], seq[keep]
                if not len(sym):
                    return sym, seq
                padded, at, own = padded[keep], np.r_[at, -1][keep], (np.cumsum(~done) - 1)[own[keep]]
                best = best[~done]
            else:
                at = np.r_[at, -1]
            hit = np.flatnonzero(padded == best[own])
            first = np.r_[True, own[hit[1:]] != own[hit[:-1]]]
            chosen = first | self.safe[at[hit]]
            hit = hit[chosen]
            # Of hits that follow one another directly, each second one overlaps its left neighbour.
            run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            hit = hit[place % 2 == 0]
            sym[hit] = self.made[at[hit]]
            stay = np.ones(len(sym), dtype=bool)
            stay[hit + 1] = False
            sym, seq = sym[stay], seq[stay]
        self.tally(sym, seq, weight, cost)
        return sym[:0], seq[:0]


class Known:
    """Counts of short parts, bounded by about the bytes they take; emptied when full, which changes time only."""

    def __init__(self, most: int = KNOWN_BYTES):
        self.most, self.size = most, 0
        self.counts: dict[str, int] = {}

    def add(self, parts: list[str], counts: list[int]) -> None:
        self.size += sum(map(len, parts)) + 150 * len(parts)
        if self.size > self.most:
            self.counts, self.size = {}, 0
        else:
            self.counts.update(zip(parts, counts, strict=True))


_models: dict[str, tuple[PieceModel, Known]] = {}


def loaded(data: bytes) -> tuple[PieceModel, Known]:
    key = hashlib.sha256(data).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = PieceModel(data), Known()
    return _models[key]


def count_batch(model: PieceModel, known: Known, texts: list[str | None]) -> list[int]:
    cut = [model.parts(t or "") for t in texts]
    have = known.counts
    new = list({p for parts in cut for p in parts if p not in have})
    fresh = {p: model.count_long(p) for p in new if len(p) > LONG}
    some, size = [], 0
    for p in [*(p for p in new if len(p) <= LONG), None]:
        if p is None or size > 1 << 18:
            fresh.update(zip(some, model.count(some), strict=True))
            some, size = [], 0
        if p is not None:
            some.append(p)
            size += len(p)
    out = [sum([fresh[p] if p in fresh else have[p] for p in parts]) for parts in cut]
    kept = [p for p in fresh if len(p) <= KNOWN_CHARS]
    known.add(kept, [fresh[p] for p in kept])
    return out


def in_turn(lengths: list[int], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of rows of about most characters each."""
    start = size = 0
    for i, n in enumerate(lengths):
        size += n
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def count_tokens(df: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of a text column."""
    spark = df.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    df = df.drop(n_tokens)
    rows, (body,) = numbered(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm.piece_counts import count_batch, in_turn, loaded

        model, known = loaded(vocabulary.value)
        for whole in batches:
            sizes = [n or 0 for n in pc.binary_length(whole.column(body)).to_pylist()]
            for a, b in in_turn(sizes):
                some = whole.slice(a, b - a)
                counts = count_batch(model, known, some.column(body).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(counts, pa.int64())], names=[*some.schema.names, n_tokens])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(n_tokens, T.LongType())])).toDF(*df.columns, n_tokens)


def op10(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    """Bytes and tokens of every whole document, and whether the tokens exceed the limit."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    made = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return made.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
