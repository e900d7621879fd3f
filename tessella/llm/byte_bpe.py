"""Byte-level BPE with a transducer that is determinised as texts need it.

A prefix of a piece has exactly one encoding, and its last token is fixed by the rule that
neighbouring tokens must be what BPE itself makes of their joint bytes. A state therefore is
(last emitted token, bytes read since). Reading a byte extends the pending bytes; as soon as
every way in which the vocabulary could go on shares its first tokens, these are emitted. The
lookahead is bounded by the longest token. States and transitions are built when first met and
kept; the store is emptied when it exceeds KEPT, which changes time and memory only, not results.

Edge cases: a null text counts as empty and has no ids; repeated rows are encoded each; ties do not
arise, as ranks differ; texts are whole however long, and a long piece lets go of its states on the
way. Columns named like the results (ids, n_tokens, decoded, the digests) are replaced; all others
pass through, whatever their names (round_trip leaves the text out).
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessella.llm.runtime import numbered, ship

#: How many transitions, token pairs and pieces (in each of two generations) a worker keeps.
KEPT = 300_000
VOCABULARY_BYTES = 64 << 20  # a broadcast vocabulary may not be larger than this


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class MergeTransducer:
    """Encodes one piece of bytes; see the module's docstring.

    A state keeps, for each position of its pending bytes, the last token of the encoding up to
    there (-2: none that follows the anchor), where that token begins, and which positions are
    live: a token of the vocabulary may begin there and reach beyond what has been read. An anchor
    that forbids none of the tokens to come is forgotten (-3), so few states suffice.
    """

    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT):
        self.ranks, self.kept = ranks, kept
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.prefixes = {t[:n] for t in ranks for n in range(1, len(t))}
        self.sorted = sorted(ranks)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple[bytes, tuple[int, ...], tuple[int, ...], tuple[int, ...]]] = [(b"", (-1,), (0,), ())]
        self.number: dict[tuple[int, bytes, tuple[int, ...]], int] = {(-1, b"", ()): 0}
        self.steps: dict[int, tuple[tuple[int, ...], int]] = {}

    def joined(self, piece: bytes, down_to: int = 1) -> list[bytes]:
        """The defining procedure: join the neighbours of lowest rank until none can be joined or few are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > down_to:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def half(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose join makes this one; None for a byte or a token that no join makes."""
        if token not in self.halves:
            parts = self.joined(self.bytes_of[token], 2)
            whole = len(parts) == 2 and parts[0] in self.ranks and parts[1] in self.ranks
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if whole else None
        return self.halves[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves b after a (a = -1: b at the start)."""
        if a < 0:
            return a == -3 or self.half(b) is not None or len(self.bytes_of[b]) == 1
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > self.kept:
                self.pairs.clear()
            known = self.pairs[a, b] = self.seam(a, b)
        return known

    def seam(self, a: int, b: int) -> bool:
        """Undo the joins on both sides of the seam, latest first: no join across it may come before what was undone."""
        ranks, text = self.ranks, self.bytes_of
        bound = 1 << 62
        while True:
            across = ranks.get(text[a] + text[b])
            if across is not None and across < bound and self.half(across) == (a, b):
                return False
            left, right = self.half(a), self.half(b)
            if left is None and right is None:
                return True
            # The later of the two joins is undone; on equal ranks the left one was made first.
            if right is None or left is not None and a > b:
                bound, a = a, left[1]
            else:
                bound, b = b + 1, right[0]

    def indifferent(self, anchor: int, rest: bytes) -> bool:
        """Whether every token that begins with rest and goes on may follow the anchor; not looked at if they are many."""
        low = bisect_right(self.sorted, rest)
        high = low
        while high < len(self.sorted) and self.sorted[high].startswith(rest):
            high += 1
            if high - low > 16:
                return False
        return all(self.fits(anchor, self.ranks[t]) for t in self.sorted[low:high])

    def step(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        pending, last, begin, live = self.states[state]
        n = len(pending) + 1
        pending += bytes((byte,))
        if last[-1] != -2:
            live += (n - 1,)
        found, at = -2, 0
        for start in live:
            token = self.ranks.get(pending[start:])
            if token is not None and self.fits(last[start], token):
                found, at = token, start
                break
        last += (found,)
        begin += (at,)
        live = tuple([p for p in live if pending[p:] in self.prefixes])
        meet = {*live, n} if found != -2 else {*live}
        while len(meet) > 1:
            far = max(meet)
            meet.remove(far)
            meet.add(begin[far])
        cut = end = meet.pop()
        out = []
        while end:
            out.append(last[end])
            end = begin[end]
        rest, anchor = pending[cut:], last[cut]
        if cut < n and (cut not in live or self.indifferent(anchor, rest)):
            anchor = -3
        key = anchor, rest, last[cut + 1 :]
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            begin, live = tuple([x - cut for x in begin[cut:]]), tuple([p - cut for p in live])
            self.states.append((rest, (anchor, *key[2]), begin, live))
        made = self.steps[state << 8 | byte] = tuple(out[::-1]), number
        return made

    def end(self, state: int) -> list[int]:
        _, last, begin, _ = self.states[state]
        out, at = [], len(last) - 1
        while at:
            out.append(last[at])
            at = begin[at]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:  # a piece that is a token stays whole
            return [self.ranks[piece]]
        out: list[int] = []
        state = 0
        for at in range(0, len(piece), 1024):
            if len(self.steps) > self.kept:  # only the state that the piece is in lives on
                held = self.states[state], next(k for k, v in self.number.items() if v == state)
                self.clear()
                state = self.number.get(held[1], 1)
                if state:
                    self.states.append(held[0])
                    self.number[held[1]] = 1
            steps = self.steps
            for byte in piece[at : at + 1024]:
                made = steps.get(state << 8 | byte) or self.step(state, byte)
                if made[0]:
                    out += made[0]
                state = made[1]
        return out + self.end(state)


def utf8_machine() -> list[bytes]:
    """For each state the next one by byte: 0 between characters, 1-3 so many bytes to come, 4-7 the second byte is restricted, 8 no character."""
    ranges = [
        (0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE0, 0xE0, 4), (0, 0xE1, 0xEF, 2), (0, 0xED, 0xED, 5), (0, 0xF0, 0xF0, 6), (0, 0xF1, 0xF3, 3), (0, 0xF4, 0xF4, 7),
        (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2),
    ]
    table = [bytearray([8] * 256) for _ in range(9)]
    for state, low, high, then in ranges:
        for byte in range(low, high + 1):
            table[state][byte] = then
    return [bytes(row) for row in table]


class Utf8Stream:
    """Decodes UTF-8 bytes that come in parts cut anywhere.

    The state between two parts is that of the machine above; bytes of a character that it has
    begun and not ended are held back. Only a part's last bytes can leave it within a character, so
    it is run from the last byte there that may begin one.
    """

    NEXT = utf8_machine()

    def __init__(self) -> None:
        self.held = b""

    def feed(self, part: bytes) -> str:
        data = self.held + part
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            if data[cut - back] >= 0xC0:
                state = 0
                for byte in data[cut - back :]:
                    state = self.NEXT[state][byte]
                if 0 < state < 8:
                    cut -= back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Codec:
    """Texts to packed ids (little-endian, 32 bits) and back."""

    def __init__(self, data: bytes, pattern: str, kept: int = KEPT):
        ranks = parse_ranks(data)
        self.kept = kept
        self.split = regex.compile(pattern).findall
        self.machine = MergeTransducer(ranks, kept)
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.token[r] = t

    def encode(self, text: str) -> bytes:
        known, out = self.pieces, []
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.older.get(piece)
                if ids is None:
                    ids = packed(self.machine.encode(piece.encode()))
                if len(piece) <= 64:
                    if len(known) > self.kept:
                        self.older = known
                        known = self.pieces = {}
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes, at_once: int = 1 << 16) -> Iterator[str]:
        stream, numbers = Utf8Stream(), np.frombuffer(ids, dtype="<u4")
        for i in range(0, len(numbers), at_once):
            yield stream.feed(b"".join([self.token[t] for t in numbers[i : i + at_once].tolist()]))
        yield stream.finish()


_codecs: dict[tuple[str, str, int], Codec] = {}


def codec(data: bytes, pattern: str, kept: int = KEPT) -> Codec:
    """One codec for each vocabulary and worker; its states stay warm between batches."""
    key = hashlib.sha256(data).hexdigest(), pattern, kept
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data, pattern, kept)
    return _codecs[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"vocabulary {path} exceeds {VOCABULARY_BYTES} bytes")
    return data


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", kept: int = KEPT) -> DataFrame:
    """df with the token ids of a text column (binary, 32 bits little-endian each) and their number.

    kept: as KEPT; a worker that also serves other steps does with less memory at more time.
    """
    spark = df.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    df = df.drop(ids, n_tokens)
    rows, (body,) = numbered(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm.byte_bpe import codec

        c = codec(vocabulary.value, pattern, kept)
        for b in batches:
            packed = [c.encode(t or "") for t in b.column(body).to_pylist()]
            cols = [*b.columns, pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, ids, n_tokens])

    out = T.StructType([*rows.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())])
    return rows.mapInArrow(run, out).toDF(*df.columns, ids, n_tokens)


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that packed ids stand for, decoded as a stream."""
    spark = df.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    df = df.drop(text)
    rows, (packed,) = numbered(df, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm.byte_bpe import codec

        c = codec(vocabulary.value, pattern)
        for b in batches:
            texts = ["".join(c.decode(x or b"")) for x in b.column(packed).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, text])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])).toDF(*df.columns, text)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with the number of tokens and digests of a text's ids and of what they decode to; ids do not leave the worker."""
    spark = df.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]
    df = df.drop(*made)
    rows, (body,) = numbered(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm.byte_bpe import codec

        c = codec(vocabulary.value, pattern)
        for b in batches:
            numbers, digests, decoded = [], [], []
            for t in b.column(body):
                ids = c.encode(t.as_py() or "")
                again = hashlib.sha256()
                for part in c.decode(ids):
                    again.update(part.encode())
                numbers.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(again.hexdigest())
            cols = [pa.array(numbers, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.drop_columns([body]).columns, *cols], names=[*(n for n in b.schema.names if n != body), *made])

    kept = [f for f in rows.schema.fields if f.name != body]
    out = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return rows.mapInArrow(run, out).toDF(*(c for c in df.columns if c != text), *made)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded, then decoded from the ids; digests of both."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
