"""Clusters around centroids with integer arithmetic: float32 products screen, exact integers decide.

Each round hands the centroids to the tasks; a task screens its vectors with one float32 matrix
product. A product's error is at most gamma * |x| * |c| (gamma: d + 3 rounding units, whatever the
order of summation), so each squared distance lies in an interval around what the product says. Only
centroids whose interval reaches below the least upper end stay on a vector's shortlist; where more
than one stays, exact integers decide and the lower number wins a tie. Sums are exact, so neither
partitioning nor lost executors change a result. A task returns sums and counts of each cluster;
what comes to the driver has k * (dims + 1) rows, as many for any input.

Every round reads the vectors once, so hand in a table or a frame that is cheap to read. Edge cases:
vectors that are null, have another length or hold null or non-finite components are left out; null
ids are kept (and are no first centroids while others are there); repeated rows count each; with
fewer than k vectors there are as many centroids as vectors; an empty table gives no rows; further
columns are ignored. A distance or sum that no long holds is null, and sums leave such distances out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.runtime import quoted, ship, stored, table
from tessella.llm.vectors import LIMB, alike, as_longs, integers, limbs, matrix, plain_vectors, squared, usable

UNIT = 2.0**-24
SUMS = "cluster int, place int, limb int, part long"


def shortlist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row of x, which rows of c may be nearest: intervals that reach below the least upper end."""
    if x.dtype == object or c.dtype == object:
        return np.ones((len(x), len(c)), dtype=bool)
    xs, cs = x.astype(np.float64), c.astype(np.float64)
    with np.errstate(all="ignore"):
        size_x, size_c = np.sqrt((xs * xs).sum(axis=1)), np.sqrt((cs * cs).sum(axis=1))
        if not (size_x.max(initial=0) < 1e18 and size_c.max(initial=0) < 1e18):
            return np.ones((len(x), len(c)), dtype=bool)
        terms = x.shape[1] + 3
        gamma = terms * UNIT / (1 - terms * UNIT)
        near = (size_c * size_c)[None, :] - 2.0 * (xs.astype(np.float32) @ cs.astype(np.float32).T).astype(np.float64)
        # The second part covers the float64 operations of these two lines.
        error = (2.0 * gamma + 1e-12) * size_x[:, None] * size_c[None, :] + 1e-12 * (size_c * size_c)[None, :]
    return near - error <= (near + error).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid; of equally near ones the smallest."""
    if not len(x):
        return np.zeros(0, dtype=np.int64)
    listed = shortlist(x, c)
    x, c = alike(x, c)
    found = listed.argmax(axis=1)
    open_ = np.flatnonzero(listed.sum(axis=1) > 1)
    if len(open_):
        best = squared(x[open_], c[found[open_]])
        for j in range(len(c)):
            again = np.flatnonzero(listed[open_, j] & (found[open_] < j))
            rows = open_[again]
            if not len(rows):
                continue
            other = squared(x[rows], np.broadcast_to(c[j], x[rows].shape))
            closer = (other < best[again]).astype(bool)
            best[again[closer]] = other[closer]
            found[rows[closer]] = j
    return found


def sums_of(centroids: list[list[int]], dims: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = whole(centroids)
        total = np.zeros((len(c), dims), dtype=object)
        count = np.zeros(len(c), dtype=np.int64)
        for b in batches:
            x = integers(matrix(b.column("v"), dims)[1], scale)
            own = nearest(x, c)
            count += np.bincount(own, minlength=len(c))
            for j in np.unique(own).tolist():
                total[j] += x[own == j].sum(axis=0).astype(object)
        rows = [(j, -1, 0, int(n)) for j, n in enumerate(count) if n]
        rows += [(j, i, k, part) for j in np.flatnonzero(count).tolist() for i in range(dims) for k, part in enumerate(limbs(int(total[j, i])))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "place", "limb", "part"])

    return each


def whole(rows: list[list[int]]) -> np.ndarray:
    """Integers as int64 if they fit."""
    fits = all(abs(v) < 1 << 61 for r in rows for v in r)
    return np.array(rows, dtype=np.int64 if fits else object)


def moved(centroids: list[list[int]], sums: list) -> list[list[int]]:
    """Centroids after sums (cluster, place, limb, part) of their vectors; those without vectors stay."""
    count = {r.cluster: int(r.part) for r in sums if r.place == -1}
    total: dict[tuple[int, int], int] = {}
    for r in sums:
        if r.place >= 0:
            total[r.cluster, r.place] = total.get((r.cluster, r.place), 0) + (int(r.part) << LIMB * r.limb)
    return [[total[j, i] // count[j] for i in range(len(c))] if j in count else c for j, c in enumerate(centroids)]


def first_centroids(rows: DataFrame, k: int, dims: int, scale: int, seed: int) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    got = rows.where(usable(F.col("v"), dims)).select(order.alias("h"), "id", "v").orderBy(F.col("h").asc_nulls_last(), "id", "v").limit(k).collect()
    return integers(np.array([r.v for r in got], dtype=np.float64).reshape(-1, dims), scale).tolist()


def fit(rows: DataFrame, k: int, dims: int, scale: int, seed: int, rounds: int) -> list[list[int]]:
    """The centroids after so many rounds over rows (id, v)."""
    centroids = first_centroids(rows, k, dims, scale, seed)
    for _ in range(rounds if centroids else 0):
        sums = rows.select("v").mapInArrow(sums_of(centroids, dims, scale), SUMS)
        centroids = moved(centroids, sums.groupBy("cluster", "place", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect())
    return centroids


def assigned(rows: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> DataFrame:
    """id, cluster and distance of each usable row."""
    kind = rows.schema["id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = whole(centroids).reshape(-1, dims)
        for b in batches:
            keep, values = matrix(b.column("v"), dims)
            x = integers(values, scale)
            if len(x):
                own = nearest(x, c)
                yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(keep)), pa.array(own, pa.int32()), as_longs(squared(*alike(x, c[own])))], names=["id", "cluster", "distance"])

    return rows.mapInArrow(each, f"id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each usable vector."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(quoted(id)).alias("id"), plain_vectors(vectors, vector).alias("v"))
    centroids = fit(rows, k, dims, scale, seed, rounds)
    out = stored(assigned(rows, centroids, dims, scale), "clusters")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    inertia = out.groupBy("cluster").agg(wide("distance").alias("s")).collect()  # k rows
    each = {r.cluster: int(r.s or 0) for r in inertia}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    long = lambda v: v if v < 1 << 63 else None
    facts = [(j, long(each.get(j, 0)), long(sum(each.values())), d) for j, d in enumerate(digests)]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's cluster after ten rounds around eight centroids."""
    return cluster(table(spark, sf_dir, "embeddings"))


def op11_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same rounds, one table expression each; every distance is computed."""
    parts = [
        f"""WITH x AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR)) - 1)::INTEGER AS j, v FROM x
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR)) <= {k})""",
    ]
    near = "SELECT vec_id, any_value(x.v) AS v, min({{'d': list_sum(list_transform(range(1, {dims} + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT, 'j': c.j}}) AS m FROM x, c{r} c GROUP BY vec_id"
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(dims=dims, r=r)})")
        parts.append(f"""s{r} AS (SELECT j, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS q FROM (
  SELECT m.j AS j, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {dims} + 1) t(i) GROUP BY ALL))""")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce((SELECT list(s.q ORDER BY s.i) FROM s{r} s WHERE s.j = c.j), c.v) AS v FROM c{r} c)")
    parts.append(f"f AS MATERIALIZED ({near.format(dims=dims, r=rounds)})")
    return ",\n".join(parts) + f"""
SELECT f.vec_id, f.m.j AS cluster, f.m.d AS distance, (sum(f.m.d) OVER (PARTITION BY f.m.j))::BIGINT AS cluster_inertia, (sum(f.m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM f JOIN c{rounds} c ON c.j = f.m.j"""
