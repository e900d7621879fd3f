"""Near-duplicate embeddings through binary codes: iterative quantisation, multi-index Hamming tables, and the vectors' own cosine.

1. Equal vectors (of equal hash: two 64-bit hashes of the components) are one node with a weight, so
   exact copies never meet each other.
2. Rotations that make balanced binary codes are learned by iterative quantisation (principal axes,
   then alternately the signs and the rotation nearest to them) on at most SAMPLE nodes of least hash.
   How often a bit differs in a pair of a given cosine is measured on the sample; the number of
   tables follows from it: a pair just at the threshold meets in one table at least with probability CHANCE.
3. Each code is cut into keys of about log2(nodes) bits; each key is a table. Only codes (four longs)
   travel to the tables. Codes that share a key and differ in at most `radius` bits are joined: not as pairs but
   as one row for each code, which names the least node that it meets. A key that more than RUN codes
   share is peeled first: codes within the radius of its least code are joined to that one and leave, unless another
   code outside could still reach them by the triangle inequality; what is left
   after PEELS rounds is compared block by block. So a group of near copies takes time in proportion to its size.
4. What these rows join (candidate groups) brings its vectors together, each once. Small groups are
   multiplied whole. In groups of more than RUN nodes those within half of the angle of the threshold
   around the middle are linked with each other for certain, and only the others are compared, in
   blocks. Each pair is seen once, so counts are exact for all pairs that the tables find together.
   Links, too, leave as one row a node.

Recall against all pairs is 1.0 on the tables at hand (near copies at a cosine of 0.976 and more), and about CHANCE
for pairs just at the threshold (figures in the README). Precision is 1: every link is a computed cosine or certain.

Edge cases: vectors that are null, zero, hold null or non-finite components, or have another length
than `dims` (None: the most frequent length, of equally frequent ones the smaller) link with nothing;
rows of one id are rows of their own, and each counts as a link of another; a null id is never a component's smallest (null if there is no other); an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.components import components
from tessella.llm.runtime import Tables, quoted, shuffle_width, ship, table
from tessella.llm.vectors import matrix, plain_vectors, usable

SAMPLE = 4096
CHANCE = 0.95
STEPS = 20
#: Codes of a key, or nodes of a group, that are compared whole.
RUN = 512
#: Rows that are worked on at once.
PIECE = 1 << 13
PEELS = 4
#: Rotations whose bits are compared.
WORDS = 4
BROADCAST_ROWS = 200_000


class Index:
    """Rotations, the key bits of the tables, and the Hamming radius."""

    def __init__(self, sample: np.ndarray, nodes: int, threshold: float):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.middle = unit.mean(axis=0)
        dims = sample.shape[1]
        self.bits = min(64, dims)
        self.key_bits = min(self.bits, max(8, round(math.log2(max(2, nodes)))))
        axes = np.linalg.svd(unit - self.middle, full_matrices=True)[2][: self.bits].T
        self.rotations = [axes @ learned((unit - self.middle) @ axes, seed) for seed in range(WORDS)]
        per = self.bits // self.key_bits
        miss = lambda: math.log(1 - (1 - self.flips(unit, threshold).mean()) ** self.key_bits + 1e-12)
        self.tables = max(1, math.ceil(math.log(1 - CHANCE) / miss()))
        for seed in range(WORDS, math.ceil(self.tables / per)):
            self.rotations.append(axes @ learned((unit - self.middle) @ axes, seed))
        # Nearly all pairs at the threshold lie within the radius: it only spares comparisons.
        seen = self.flips(unit, threshold).sum(axis=1)
        self.radius = math.ceil(seen.mean() + 4 * seen.std()) if len(seen) else 0

    def flips(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Which of the compared bits differ between each vector and a random one at this cosine."""
        r = np.random.default_rng(7)
        other = r.standard_normal(unit.shape)
        other -= (other * unit).sum(axis=1, keepdims=True) * unit
        length = np.linalg.norm(other, axis=1, keepdims=True)
        other = np.where(length > 0, other / np.where(length > 0, length, 1), 0)
        near = cosine * unit + math.sqrt(1 - cosine * cosine) * other
        return np.concatenate([self.signs(unit, k) != self.signs(near, k) for k in range(WORDS)], axis=1)

    def signs(self, unit: np.ndarray, k: int) -> np.ndarray:
        return (unit - self.middle) @ self.rotations[k] >= 0

    def codes(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The compared words, and the keys (rows by tables) of vectors; a key holds its table's number."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        words, keys = [], []
        per = self.bits // self.key_bits
        for k in range(len(self.rotations)):
            bits = self.signs(unit, k)
            if k < WORDS:
                words.append(packed_bits(bits))
            for t in range(k * per, min(self.tables, (k + 1) * per)):
                at = (t - k * per) * self.key_bits
                key = packed_bits(bits[:, at : at + self.key_bits]) if self.key_bits < 48 else mixed_bits(packed_bits(bits[:, at : at + self.key_bits]))
                keys.append(key | (t << 48))
        return words, np.stack(keys, axis=1)


def learned(z: np.ndarray, seed: int) -> np.ndarray:
    """The rotation under which the signs of z are nearest to z, from a random start."""
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((z.shape[1], z.shape[1])))[0]
    for _ in range(STEPS if len(z) else 0):
        u, _, v = np.linalg.svd(np.where(z @ r >= 0, 1.0, -1.0).T @ z)
        r = (u @ v).T
    return r


def packed_bits(bits: np.ndarray) -> np.ndarray:
    """Up to 64 booleans a row as one long."""
    wide = np.zeros((len(bits), 64), dtype=np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<i8").ravel().astype(np.int64)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """Folded into 48 bits."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(16)).astype(np.int64)


def least_reached(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of size things, the least one that the links (a, b) reach."""
    least = np.arange(size)
    while len(a):
        low = np.minimum(least[a], least[b])
        after = least.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == least).all():
            break
        least = after
    return least


def pieces(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows that come sorted by key, in tables of about PIECE rows that never cut a key."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, PIECE)
            at += part.num_rows
            held.append(part)
            rows += part.num_rows
            if rows < PIECE:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            keys = t.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield t.slice(0, cut)
            held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def runs_of(keys: np.ndarray) -> list[tuple[int, int]]:
    """Where each key with several rows begins and ends."""
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[heads[1:], len(keys)]
    several = ends - heads > 1
    return list(zip(heads[several].tolist(), ends[several].tolist(), strict=True))


CODE = [f"w{i}" for i in range(WORDS)]
CODE_SCHEMA = ", ".join(f"{w} long" for w in CODE)
LINK = "a long, b long"


def link_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_codes(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Codes sorted by key: each with the least node that it reaches within its key."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pieces(batches, "key"):
            keys, node = t.column("key").to_numpy(), t.column("node").to_numpy()
            order = np.lexsort((node, keys))
            keys, node = keys[order], node[order]
            words = np.stack([t.column(w).to_numpy() for w in CODE], axis=1)[order]
            left, right = [], []
            for step in range(1, len(keys)):
                same = np.flatnonzero(keys[step:] == keys[:-step])
                if not len(same):
                    break
                near = same[apart(words[same], words[same + step]) <= radius]
                left.append(near)
                right.append(near + step)
            if left:
                least = least_reached(len(keys), np.concatenate(left), np.concatenate(right))
                moved = np.flatnonzero(node[least] != node)
                yield link_batch(node[moved], node[least][moved])

    return each


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits rows differ."""
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=1, dtype=np.int64)


def block_codes(radius: int) -> Callable[[pa.Table], pa.Table]:
    """The codes of two blocks of one key (or of one block): each with the least node that it reaches here."""

    def each(t: pa.Table) -> pa.Table:
        node, order = np.unique(t.column("node").to_numpy(), return_index=True)
        words = np.stack([t.column(w).to_numpy() for w in CODE], axis=1)[order]
        a, b = [], []
        for i in range(len(node) - 1):
            near = np.flatnonzero(apart(words[i + 1 :], words[i : i + 1]) <= radius)
            a.append(np.full(len(near), i))
            b.append(near + i + 1)
        least = least_reached(len(node), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(node))
        moved = np.flatnonzero(least != np.arange(len(node)))
        return pa.Table.from_batches([link_batch(node[moved], node[least[moved]])])

    return each


def distance(*pairs: tuple[Column, Column]) -> Column:
    total = F.lit(0)
    for x, y in pairs:
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def small(df: DataFrame) -> DataFrame:
    """Broadcast if it has few rows (they are counted); df must be a table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def in_blocks(rows: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """rows of keys with many rows, a copy for each pair of blocks (i, j) that a row's block is in; counts: key, rows."""
    met = rows.join(counts.select(key, F.ceil(F.col("rows") / RUN).cast("int").alias("_n")), key)
    own = F.pmod(F.xxhash64("node", F.lit(11)), F.col("_n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda j: F.struct(F.least("_own", j).alias("i"), F.greatest("_own", j).alias("j")))
    return met.withColumn("_own", own).withColumn("_p", F.explode(pairs)).select(*rows.columns, F.col("_p.i").alias("i"), F.col("_p.j").alias("j"))


def candidate_links(codes: DataFrame, radius: int, tables: Tables, width: int) -> DataFrame:
    """(a, b) rows that join all codes which share a key and lie within the radius; codes: node, words, keys."""
    keyed = codes.select("node", *CODE, F.explode("keys").alias("key"))
    busy = lambda rows: rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > RUN)
    hot = tables.keep(busy(keyed), "hot-at-first")
    out, cold = [], keyed
    if hot.head(1):
        cold = keyed.join(small(hot), "key", "left_anti")
        rest = tables.keep(keyed.join(small(hot), "key", "left_semi"), "peel-0")
        for k in range(PEELS):
            heads = tables.keep(rest.groupBy("key").agg(F.min(F.struct("node", *CODE)).alias("head")), f"heads-{k}")
            far = distance(*((F.col(w), F.col(f"head.{w}")) for w in CODE))
            met = tables.keep(rest.join(small(heads), "key").withColumn("far", far).withColumn("to", F.col("head.node")).drop("head"), f"met-{k}")
            # A code that leaves lies too near to the head for any code outside the radius to reach it.
            reach = met.where((F.col("far") > radius) & (F.col("far") <= 2 * radius)).groupBy("key").agg(F.min("far").alias("nearest"))
            met = met.join(small(tables.keep(reach, f"reach-{k}")), "key", "left")
            stays = (F.col("far") > radius) | F.coalesce(F.col("far") >= F.col("nearest") - radius, F.lit(False))
            out.append(tables.keep(met.where((F.col("far") <= radius) & (F.col("node") != F.col("to"))).select(F.col("node").alias("a"), F.col("to").alias("b")), f"peeled-{k}"))
            rest = tables.keep(met.where(stays).select("node", *CODE, "key"), f"peel-{k + 1}")
            tables.drop(f"peel-{k}", f"heads-{k}", f"met-{k}", f"reach-{k}")
            hot = tables.keep(busy(rest), f"hot-{k}")
            if not hot.head(1):
                cold = cold.unionByName(rest)
                break
        else:
            cold = cold.unionByName(rest.join(small(hot), "key", "left_anti"))
            blocks = in_blocks(rest.join(small(hot.select("key")), "key", "left_semi"), "key", small(hot))
            out.append(blocks.groupBy("key", "i", "j").applyInArrow(block_codes(radius), LINK))
    out.append(cold.repartition(width, "key").sortWithinPartitions("key").mapInArrow(near_codes(radius), LINK))
    links = out[0]
    for x in out[1:]:
        links = links.unionByName(x)
    return links


FOUND = "node long, weight long, links long, least long"


def found_table(node: np.ndarray, weight: np.ndarray, links: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (node, weight, links, least)], names=["node", "weight", "links", "least"])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])


def linked_runs(threshold: float, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nodes sorted by group: each with the weight that it links to and the least node that it reaches."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pieces(batches, "component"):
            node, weight = t.column("node").to_numpy(), t.column("weight").to_numpy()
            x = matrix(t.column("v").combine_chunks(), dims)[1]
            for at, end in runs_of(t.column("component").to_numpy()):
                near = cosines(x[at:end], x[at:end]) >= threshold
                np.fill_diagonal(near, False)
                if near.any():
                    names = node[at:end]
                    order = np.argsort(names)
                    least = np.empty(end - at, dtype=np.int64)
                    least[order] = names[order][least_reached(end - at, *np.nonzero(near[np.ix_(order, order)]))]
                    yield found_table(names, weight[at:end], near @ weight[at:end], least)

    return each


def sums_by_group(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of unit vectors by group, for each batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"), dims)[1]
                groups, of = np.unique(b.column("component").to_numpy(), return_inverse=True)
                total = np.zeros((len(groups), dims))
                np.add.at(total, of, x / np.linalg.norm(x, axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["component", "s"])

    return each


def cores(threshold: float, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whether each node lies so near to its group's middle that it is linked with all others that do."""
    most = math.acos(threshold) / 2 - 1e-6

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = (matrix(b.column(c), dims)[1] for c in ("v", "middle"))
            size = np.linalg.norm(x, axis=1) * np.linalg.norm(m, axis=1)
            angle = np.arccos(np.clip((x * m).sum(axis=1) / np.where(size > 0, size, np.inf), -1, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("component", "node", "weight", "v")), pa.array(angle <= most)], names=["component", "node", "weight", "v", "core"])

    return each


def rim_links(threshold: float, dims: int) -> Callable[[pa.Table], pa.Table]:
    """A block of a group's nodes outside its core (side 0) against a block of all its nodes (side 1)."""

    def each(t: pa.Table) -> pa.Table:
        node, weight, side, core = (t.column(c).to_numpy() for c in ("node", "weight", "side", "core"))
        x = matrix(t.column("v").combine_chunks(), dims)[1]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        near = (cosines(x[a], x[b]) >= threshold) & (node[a][:, None] != node[b][None, :])
        # A core's node is only seen from here; one outside is seen from its own side 0.
        links = np.zeros(len(node), dtype=np.int64)
        links[a] = near @ weight[b]
        links[b] = np.where(core[b], weight[a] @ near, 0)
        names, at = np.unique(node, return_inverse=True)
        i, j = np.nonzero(near)
        least = names[least_reached(len(names), at[a[i]], at[b[j]])][at]
        seen = np.flatnonzero((links > 0) | (least != node))
        return pa.Table.from_batches([found_table(node[seen], weight[seen], links[seen], least[seen])])

    return each


def large_groups(members: DataFrame, groups: DataFrame, threshold: float, dims: int, tables: Tables) -> DataFrame:
    """What linked_runs gives, for groups of more than RUN nodes; groups: component, rows."""
    kind = members.schema["v"].dataType.simpleString()
    sums = members.select("component", "v").mapInArrow(sums_by_group(dims), "component long, s array<double>")
    sums = sums.select("component", F.posexplode("s").alias("i", "x")).groupBy("component", "i").agg(F.sum("x").alias("x"))
    middle = sums.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("middle"))  # dims numbers of a group
    met = members.join(small(tables.keep(middle, "middles")), "component").select("component", "node", "weight", "v", "middle")
    met = tables.keep(met.mapInArrow(cores(threshold, dims), f"component long, node long, weight long, v {kind}, core boolean"), "cores")
    core = tables.keep(met.where("core").groupBy("component").agg(F.sum("weight").alias("held"), F.min("node").alias("least")), "core-sums")
    certain = met.where("core").join(small(core), "component").select("node", "weight", (F.col("held") - F.col("weight")).alias("links"), "least")
    # Fewer rows a block on the side that all nodes stand on would mean more copies of the other.
    rim = tables.keep(met.where("NOT core").groupBy("component").agg(F.count("*").alias("rim")), "rims")
    counts = small(tables.keep(groups.join(rim, "component").select("component", F.ceil(F.col("rim") / RUN).cast("int").alias("_a"), F.ceil(F.col("rows") / RUN).cast("int").alias("_b")), "rim-blocks"))
    met = met.join(counts, "component")
    place = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["component", "node", "weight", "v", "core", "side", "i", "j"]
    one = met.where("NOT core").withColumns({"side": F.lit(0), "i": place("_a", 1)}).withColumn("j", upto("_b")).select(*columns)
    other = met.withColumns({"side": F.lit(1), "j": place("_b", 2)}).withColumn("i", upto("_a")).select(*columns)
    compared = one.unionByName(other).groupBy("component", "i", "j").applyInArrow(rim_links(threshold, dims), FOUND)
    return certain.unionByName(compared)


def most_frequent_length(v: Column, rows: DataFrame) -> int:
    got = rows.where(F.size(v) > 0).groupBy(F.size(v).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return got.n if got else 0


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, dims: int | None = None, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The id, n_links, component_id and kept of each row."""
    spark = vectors.sparkSession
    ship(spark)
    width, tables = shuffle_width(spark), Tables(spark)
    keep, drop = tables.keep, tables.drop
    v = F.col("v")
    rows = vectors.select(F.col(quoted(id)).alias("id"), plain_vectors(vectors, vector).alias("v"))
    dims = dims or most_frequent_length(v, rows)
    if dims < 2:
        return rows.select(F.col("id").alias(id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    good = usable(v, dims) & F.exists(v, lambda x: x != 0)
    named = rows.select("id", "v", good.alias("good"), F.when(good, F.xxhash64("v")).alias("node"), F.when(good, F.xxhash64(F.lit(5), "v")).alias("second"))
    ids = keep(named.where("good").groupBy("node", "second", "id").agg(F.count("*").alias("rows")), "ids")
    shared = keep(ids.groupBy("node").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low < high").select("node", "low"), "shared-hashes")
    if shared.head(1):  # different vectors of one hash: all but one get another
        apart_now = lambda df: df.join(small(shared), "node", "left").withColumn("node", F.when(F.col("second") != F.col("low"), F.xxhash64("node", "second")).otherwise(F.col("node"))).drop("low")
        named, ids = apart_now(named), apart_now(ids)
    nodes = ids.groupBy("node").agg(F.min("id").alias("first"), F.sum("rows").alias("weight"), F.count("*").alias("ids"), F.max("rows").alias("times"))
    nodes = keep(nodes, "nodes")
    count = nodes.count()
    if not count:
        return rows.select(F.col("id").alias(id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    copies = small(keep(nodes.where("ids > 1").select("node", "first"), "copies"))
    one = named.where("good").select("node", "id", "v").join(copies, "node", "left").where("first IS NULL OR id = first").select("node", "v")
    if nodes.where("times > 1").head(1):
        one = one.dropDuplicates(["node"])
    sampled = keep(nodes.orderBy("node").limit(SAMPLE).select("node"), "sampled")
    sample = one.join(F.broadcast(sampled), "node", "left_semi").dropDuplicates(["node"]).orderBy("node").collect()
    index = Index(np.array([r.v for r in sample], dtype=np.float64), count, threshold)
    sent = spark.sparkContext.broadcast(index)  # a rotation is dims * 64 numbers

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                words, keys = sent.value.codes(matrix(b.column("v"), dims)[1])
                listed = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1], keys.ravel())
                yield pa.RecordBatch.from_arrays([b.column("node"), *map(pa.array, words), listed], names=["node", *CODE, "keys"])

    codes = keep(one.mapInArrow(coded, f"node long, {CODE_SCHEMA}, keys array<long>"), "codes")
    groups = components(keep(candidate_links(codes, index.radius, tables, width).distinct(), "candidates"), tables, "candidate-groups")
    weights = nodes.select("node", "weight")
    members = one.join(small(keep(groups.join(weights, "node"), "grouped")), "node").select("component", "node", "weight", "v")
    members = keep(members, "members")
    large = keep(members.groupBy("component").agg(F.count("*").alias("rows")).where(F.col("rows") > RUN), "large")
    rest = members.join(small(large), "component", "left_anti")
    found = rest.repartition(width, "component").sortWithinPartitions("component").mapInArrow(linked_runs(threshold, dims), FOUND)
    if large.head(1):
        found = found.unionByName(large_groups(keep(members.join(small(large), "component", "left_semi"), "large-members"), large, threshold, dims, tables))
    found = keep(found, "found")
    linked = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")), tables, "linked")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    facts = nodes.join(links, "node", "left").join(linked, "node", "left").select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    facts = keep(facts, "facts")
    least = keep(facts.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    facts = keep(facts.join(least, "component").select("node", "n_links", "component_id"), "told")
    shown = named.select("id", "node").join(facts, "node", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    drop(*(n for n in list(tables.at) if n not in ("told", "shared-hashes")))
    return shown.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE u AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[64] AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND array_cosine_similarity(a.v, b.v) >= 0.9),
r(a, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = m.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM m
"""
