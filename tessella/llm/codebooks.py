"""Vectors as short codes: each part of a vector is told by its nearest codebook entry (product quantisation).

Codebooks move by Lloyd's rounds. A chunk of vectors keeps, for each part position and entry, a heap
of the parts that the entry holds, keyed by slack: the lower bound of the distance to any other
entry minus the upper bound of that to its own, plus the drift that the entry had gathered when the
part came in. Entries gather drift as codebooks move (their own and the largest of the others); a
round pops only the parts whose key that drift has passed and rescans these against all entries in
exact integers. All others provably kept their one nearest entry. A heap is a sorted array, so what
must be popped is its front. A round's task returns, besides its heaps, only what changed in the
entries' sums.

Chunks (CHUNK vectors, their integers packed in the smallest type that holds them, and their heaps)
are rows of one table for each round in the shared folder; the one before it goes. No rows are
shuffled: sums of changes are added up, positions * entries * (components + 1) numbers for any input.

Edge cases: rows whose vector is null or holds null or non-finite components are dropped; with fewer
vectors than entries there are as many entries as vectors; vectors of another length than that of
the smallest id's, or whose length the parts don't divide, have a null code and error and move no
entry; null ids come last; of repeated ids the smaller vector comes first, and repeated rows count
each; an empty table gives no rows; further columns are ignored. An error that no long holds is
null, and sums leave it out. Integers that int64 can't square are kept as Python's own; their parts
are rescanned in each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.runtime import Tables, quoted, ship, stored, table
from tessella.llm.vectors import LIMB, as_longs, integers, largest, limbs, matrix, plain_vectors, squared

CHUNK = 4096
#: A generous bound on the rounding of the few float64 operations that make a key.
ROUNDING = 2.0**-48
#: Integers up to this are squared and summed in int64.
PLAIN_MOST = 1 << 27


class Books:
    """Codebooks by position, and the drift that each entry has gathered."""

    def __init__(self, entries: list):
        self.entries = entries  # position, entry, component: Python integers
        self.drift = np.zeros((len(entries), len(entries[0]) if entries else 0))

    def moved(self, entries: list) -> Books:
        out = Books(entries)
        for p, (old, new) in enumerate(zip(self.entries, entries, strict=True)):
            way = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(old, new, strict=True)]
            way = np.array([float(w) ** 0.5 if w < 1 << 1000 else np.inf for w in way])
            rest = np.array([np.delete(way, j).max(initial=0.0) for j in range(len(way))])
            out.drift[p] = (self.drift[p] + way + rest) * (1 + ROUNDING)
        return out


def packed(x: np.ndarray) -> tuple[str, bytes]:
    """Integers in the smallest type that holds them; Python's own as decimal text."""
    if x.dtype == object or largest(x) > PLAIN_MOST:
        return "text", ",".join(map(str, x.ravel().tolist())).encode()
    kind = "<i2" if largest(x) < 1 << 15 else "<i4"
    return kind, x.astype(kind).tobytes()


def unpacked(kind: str, data: bytes, dims: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(v) for v in data.decode().split(",")], dtype=object).reshape(-1, dims)
    return np.frombuffer(data, dtype=kind).astype(np.int64).reshape(-1, dims)


def scanned(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry (of equally near ones the first) and its slack, rounded down."""
    if x.dtype != object and c.dtype != object and largest(x) <= 1 << 22 and largest(c) <= 1 << 22 and x.shape[1] <= 64:
        # Every product and sum is an integer below 2**53, so float64 is exact here.
        xs, cs = x.astype(np.float64), c.astype(np.float64)
        d = (xs * xs).sum(axis=1)[:, None] - 2.0 * (xs @ cs.T) + (cs * cs).sum(axis=1)[None, :]
    else:
        d = np.stack([squared(x, np.broadcast_to(e, x.shape)) for e in c], axis=1)
    own = d.argmin(axis=1)
    if len(c) == 1:
        return own, np.full(len(x), np.inf)
    if d.dtype == object:
        return own, np.full(len(x), -np.inf)
    best = d[np.arange(len(x)), own].astype(np.float64)
    d[np.arange(len(x)), own] = np.iinfo(np.int64).max if d.dtype != np.float64 else np.inf
    near, far = np.sqrt(best), np.sqrt(d.min(axis=1).astype(np.float64))
    return own, (far - near) - (far + near) * ROUNDING


class Heaps:
    """The parts of a chunk at one position: a sorted array of (key, part) for each entry."""

    def __init__(self, count: int, keys: list[np.ndarray] | None = None, parts: list[np.ndarray] | None = None):
        self.keys = keys or [np.zeros(0) for _ in range(count)]
        self.parts = parts or [np.zeros(0, dtype=np.int32) for _ in range(count)]

    def pop(self, entry: int, drift: float) -> np.ndarray:
        """The parts whose slack the entry's drift has reached."""
        cut = int(np.searchsorted(self.keys[entry], drift, side="right"))
        out = self.parts[entry][:cut]
        self.keys[entry], self.parts[entry] = self.keys[entry][cut:], self.parts[entry][cut:]
        return out

    def push(self, entry: int, keys: np.ndarray, parts: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        at = np.searchsorted(self.keys[entry], keys[order])
        self.keys[entry], self.parts[entry] = np.insert(self.keys[entry], at, keys[order]), np.insert(self.parts[entry], at, parts[order])

    def owners(self, size: int) -> np.ndarray:
        out = np.zeros(size, dtype=np.int64)
        for entry, parts in enumerate(self.parts):
            out[parts] = entry
        return out


def heaps_to_bytes(heaps: list[Heaps]) -> bytes:
    sizes = np.array([[len(k) for k in h.keys] for h in heaps], dtype="<i4")
    return b"".join([sizes.tobytes(), *(k.astype("<f8").tobytes() for h in heaps for k in h.keys), *(p.astype("<i4").tobytes() for h in heaps for p in h.parts)])


def heaps_from_bytes(data: bytes, positions: int, entries: int) -> list[Heaps]:
    sizes = np.frombuffer(data, dtype="<i4", count=positions * entries)
    total, ends = int(sizes.sum()), np.cumsum(sizes)[:-1]
    keys = np.split(np.frombuffer(data, dtype="<f8", count=total, offset=4 * len(sizes)), ends)
    parts = np.split(np.frombuffer(data, dtype="<i4", count=total, offset=4 * len(sizes) + 8 * total), ends)
    return [Heaps(entries, keys[p * entries : (p + 1) * entries], parts[p * entries : (p + 1) * entries]) for p in range(positions)]


def settle(x: np.ndarray, books: Books, heaps: list[Heaps] | None) -> tuple[list[Heaps], np.ndarray, int]:
    """The chunk's heaps under these codebooks, what changed in each entry's count and sums, and how many parts were rescanned.

    heaps None: a new chunk, whose parts are all scanned. The change has a row for each position and entry: count, then sums.
    """
    positions, k = len(books.entries), len(books.entries[0])
    width = x.shape[1] // positions
    change = np.zeros((positions, k, width + 1), dtype=object if x.dtype == object else np.int64)
    fresh = heaps is None
    heaps = [Heaps(k) for _ in range(positions)] if fresh else heaps
    scans = 0
    for p, h in enumerate(heaps):
        part = x[:, p * width : (p + 1) * width]
        popped = [np.arange(len(x), dtype=np.int32)] if fresh else [h.pop(j, books.drift[p, j]) for j in range(k)]
        rows = np.concatenate(popped)
        if not len(rows):
            continue
        scans += len(rows)
        own, slack = scanned(part[rows], whole_book(books.entries[p]))
        drift = books.drift[p][own]
        with np.errstate(invalid="ignore"):
            keys = slack + drift
            keys = np.where(np.isfinite(keys), keys - (np.abs(slack) + drift) * ROUNDING, np.where(slack > 0, np.inf, -np.inf))
        before = np.full(len(rows), -1) if fresh else np.repeat(np.arange(k), [len(r) for r in popped])
        for j in np.unique(own).tolist():
            mine = own == j
            h.push(j, keys[mine], rows[mine])
        for j in range(k):
            come, gone = rows[(own == j) & (before != j)], rows[(before == j) & (own != j)]
            if len(come) or len(gone):
                change[p, j, 0] += len(come) - len(gone)
                change[p, j, 1:] += part[come].sum(axis=0) - part[gone].sum(axis=0)
    return heaps, change, scans


def whole_book(rows: list) -> np.ndarray:
    fits = all(abs(v) <= PLAIN_MOST for r in rows for v in r)
    return np.array(rows, dtype=np.int64 if fits else object)


def change_rows(change: np.ndarray) -> list[dict]:
    """What is not zero: place in the flat array, limb, part."""
    flat = change.ravel()
    return [{"place": i, "limb": n, "part": v} for i in np.flatnonzero(flat).tolist() for n, v in enumerate(limbs(int(flat[i])))]


STATE = "kind string, dims int, vectors binary, heaps binary, scans long, changes array<struct<place: int, limb: int, part: long>>"


def chunk_schema(rows: DataFrame) -> str:
    at = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return f"ids array<{at['id']}>, labels array<{at['label']}>, {STATE}"


def chunks(books: Books, dims: int, scale: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, label, v) as chunks, settled under the first codebooks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, values = matrix(b.column("v"), dims)
            ids, labels = (b.column(c).filter(pa.array(keep)).to_pylist() for c in ("id", "label"))
            for at in range(0, len(values), CHUNK):
                kind, data = packed(integers(values[at : at + CHUNK], scale))
                heaps, change, scans = settle(unpacked(kind, data, dims), books, None)
                row = {"ids": ids[at : at + CHUNK], "labels": labels[at : at + CHUNK], "kind": kind, "dims": dims, "vectors": data, "heaps": heaps_to_bytes(heaps), "scans": scans, "changes": change_rows(change)}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return each


def next_round(books: Books) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks settled under the next codebooks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                kind, dims, data, state = (one.column(c)[0].as_py() for c in ("kind", "dims", "vectors", "heaps"))
                heaps = heaps_from_bytes(state, len(books.entries), len(books.entries[0]))
                heaps, change, scans = settle(unpacked(kind, data, dims), books, heaps)
                new = {"heaps": [heaps_to_bytes(heaps)], "scans": [scans], "changes": [change_rows(change)]}
                yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else one.column(f.name) for f in one.schema], schema=one.schema)

    return each


def coded(books: Books, out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id, label, code and error of each vector of settled chunks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions = len(books.entries)
        for b in batches:
            for i in range(b.num_rows):
                kind, dims, data, state = (b.column(c)[i].as_py() for c in ("kind", "dims", "vectors", "heaps"))
                x, heaps = unpacked(kind, data, dims), heaps_from_bytes(state, positions, len(books.entries[0]))
                width, error, code = dims // positions, 0, [""] * len(x)
                for p, h in enumerate(heaps):
                    own = h.owners(len(x))
                    error = error + squared(x[:, p * width : (p + 1) * width], whole_book(books.entries[p])[own])
                    code = [a + f"{j:02x}" for a, j in zip(code, own.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("labels")[i].values, pa.array(code), as_longs(error)], schema=out)

    return each


def first_books(rows: DataFrame, parts: int, entries: int, scale: int) -> tuple[Books | None, int]:
    """The parts of the smallest ids' vectors, and the vectors' length (0: nothing to code)."""
    ordered = [F.col("id").asc_nulls_last(), F.col("v")]
    least = rows.where(finite(F.col("v"))).orderBy(*ordered).select(F.size("v").alias("n")).first()
    if least is None or not least.n or least.n % parts:
        return None, 0
    got = rows.where(finite(F.col("v")) & (F.size("v") == least.n)).orderBy(*ordered).limit(entries).collect()
    x, width = integers(np.array([r.v for r in got], dtype=np.float64), scale).tolist(), least.n // parts
    return Books([[v[p * width : (p + 1) * width] for v in x] for p in range(parts)]), least.n


def finite(v: Column) -> Column:
    """Whether a vector is there and all of its components are finite."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def next_books(books: Books, totals: dict[int, int]) -> Books:
    """Each entry at the mean of its parts, rounded down; entries without parts stay."""
    width = len(books.entries[0][0])
    out = []
    for p, book in enumerate(books.entries):
        at = lambda j, i, p=p: totals.get((p * len(books.entries[0]) + j) * (width + 1) + i, 0)
        out.append([[at(j, 1 + i) // at(j, 0) for i in range(width)] if at(j, 0) else entry for j, entry in enumerate(book)])
    return books.moved(out)


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id: str = "vec_id", vector: str = "embedding", label: str = "label", scans: list | None = None) -> DataFrame:
    """The id, code, error, label_error and codebooks_sha256 of each vector. scans: gets the number of parts that each round rescanned."""
    spark = vectors.sparkSession
    ship(spark)
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number has two hexadecimal digits")
    rows = vectors.select(F.col(quoted(id)).alias("id"), F.col(quoted(label)).alias("label"), plain_vectors(vectors, vector).alias("v"))
    books, dims = first_books(rows, parts, entries, scale)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out_schema = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    rest = rows.where(finite(F.col("v")) & (F.size("v") != dims)).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if books is None:
        made, digest = rest, hashlib.sha256(b"").hexdigest()
    else:
        tables, totals = Tables(spark), {}
        schema = chunk_schema(rows)
        state = tables.keep(rows.mapInArrow(chunks(books, dims, scale, arrow_schema(spark, schema)), schema), "chunks-0")
        for r in range(rounds + 1):
            if scans is not None:
                scans.append(state.agg(F.sum("scans")).first()[0])
            if r == rounds:
                break
            change = state.select(F.explode("changes").alias("c")).groupBy("c.place", "c.limb").agg(F.sum(F.col("c.part").cast("decimal(38,0)")).alias("part"))
            for c in change.collect():  # as many as the codebooks have numbers
                totals[c.place] = totals.get(c.place, 0) + (int(c.part) << LIMB * c.limb)
            books = next_books(books, totals)
            state = tables.keep(state.mapInArrow(next_round(books), schema), f"chunks-{r + 1}")
            tables.drop(f"chunks-{r}")
        made = stored(state.mapInArrow(coded(books, arrow_schema(spark, out_schema)), out_schema).unionByName(rest), "codes")
        tables.drop(f"chunks-{rounds}")
        digest = hashlib.sha256(",".join(str(v) for book in books.entries for e in book for v in e).encode()).hexdigest()
    # Tables on both sides: few labels are broadcast, and of many a frequent one can be split between tasks.
    sums = made.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    sums = stored(sums.select(F.col("label").alias("of"), F.expr("try_cast(total AS bigint)").alias("label_error")), "label-errors")
    met = made.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return met.select(F.col("id").alias(id), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's code after six rounds of eight codebooks of sixteen entries."""
    return compress(table(spark, sf_dir, "embeddings"))


def op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6, dims: int = 64, scale: int = 4096) -> str:
    """The same rounds, one table expression each; every distance is computed."""
    width = dims // parts
    each = [
        f"""WITH x AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
        f"y AS MATERIALIZED (SELECT vec_id, label, p, v[p * {width} + 1 : p * {width} + {width}] AS v FROM x, range(0, {parts}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, v FROM y QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries})",
    ]
    near = "SELECT vec_id, y.p, any_value(label) AS label, any_value(y.v) AS v, min({{'d': list_sum(list_transform(range(1, {width} + 1), lambda i: (y.v[i] - c.v[i]) * (y.v[i] - c.v[i])))::BIGINT, 'j': c.j}}) AS m FROM y JOIN c{r} c ON c.p = y.p GROUP BY vec_id, y.p"
    for r in range(rounds):
        each.append(f"a{r} AS MATERIALIZED ({near.format(width=width, r=r)})")
        each.append(f"""s{r} AS (SELECT p, j, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS q FROM (
  SELECT p, m.j AS j, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {width} + 1) t(i) GROUP BY ALL))""")
        each.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.j, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT p, j, list(q ORDER BY i) AS v FROM s{r} GROUP BY p, j) n ON n.p = c.p AND n.j = c.j)")
    each.append(f"f AS MATERIALIZED ({near.format(width=width, r=rounds)})")
    each.append("g AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.j), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM f GROUP BY vec_id)")
    return ",\n".join(each) + f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, j)) FROM c{rounds}) AS codebooks_sha256
FROM g"""
