"""Similarity join of documents by their word shingles, and its components.

Two documents link when their sets of SHINGLE-word shingles have a Jaccard similarity of at least
PERCENT / 100. The incidence of documents by shingles is a sparse matrix, kept in blocks of
documents. A link is found by multiplying one document's row with the rows of a whole block: the
block's postings of each shingle add to the overlap counts, and counts below the bound that the two
sizes set are dropped.

Which rows meet which blocks is found without comparing all pairs, and without losing a link:
1. Documents with a common least hash under one of SEEDS hash functions are compared with the
   smallest id among them. That joins groups of near copies in time linear in their size.
2. Shingles are ordered by their document frequency, rare ones first. If two documents link, they
   share one of the first n - ceil(0.8 n) + 1 shingles of both, at places behind which enough are
   left. First one document for each such shingle and group from step 1 meets those of the other
   groups, which joins most groups that belong together; then the product over these first
   columns adds up, for all documents that are still in different groups, how many they share.
   A pair goes on only while its count and what is left behind it can reach the bound of the sizes.
   Before a pair is made at all, the counts of its documents' shingles in FOLDS folds of the columns
   are compared: their lesser counts add up to no less than the overlap.
Pairs within a group are skipped: links there cannot change the components.

Words are runs of characters other than ASCII white space, with A-Z in lower case. A document with
fewer words than SHINGLE has one shingle, the whole sequence. Edge cases: a text that is null or
without words has no shingles, links with nothing and is its own component; rows with one doc_id
are one node; rows with a null doc_id link with nothing and have a null component. Texts are whole,
however long; columns other than doc_id and text are left out; ties do not arise.

Shingles are told apart by 64-bit hashes; words of more than LONG_WORD bytes are hashed by xxHash,
as a sum of powers has known collisions there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.blocks import NULL_ID, StoredBlocks, grouped, mixed
from tessella.llm.components import components
from tessella.llm.runtime import Tables, ship, table

SHINGLE = 5
PERCENT = 80
SEEDS = 6
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LONG_WORD = 64
FOLDS = 64
FOLDED = 4000  # shingles; larger sets fill the folds too evenly to tell anything
AT_ONCE = 1 << 18  # bytes of text hashed at once


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_powers: dict[str, np.ndarray] = {}


def powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * AT_ONCE)
        _powers["up"], _powers["down"] = powers(ODD, size), powers(INVERSE, size)
    return _powers["up"][:n], _powers["down"][:n]


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    blank = SPACE[data]
    edge = np.flatnonzero(np.r_[True, blank[:-1]] != blank)  # starts and ends of words by turns
    start, end = edge[0::2], edge[1::2]
    up, down = powers_up_to(len(data) + 1)
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)]
    word = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        word[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    upto = np.searchsorted(start, ends_of)
    joined = word[: max(0, len(word) - SHINGLE + 1)].copy() if len(word) >= SHINGLE else word[:0].copy()
    for k in range(1, SHINGLE):
        joined = joined * np.uint64(ODD) + word[k : len(joined) + k]
    joined = mixed(joined)
    out, a = [], 0
    for b in upto.tolist():
        if b - a >= SHINGLE:
            h = np.sort(joined[a : b - SHINGLE + 1])
            out.append(h[np.r_[True, h[1:] != h[:-1]]])
        elif b > a:
            h = 0
            for x in word[a:b].tolist():
                h = (h * INVERSE + x + 1) & (1 << 64) - 1
            out.append(mixed(np.array([h ^ (b - a)], dtype=np.uint64)))
        else:
            out.append(word[:0])
        a = b
    return out


def sets_of(texts: list[bytes]) -> list[np.ndarray]:
    out, some, size = [], [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= AT_ONCE:
            out += shingles(some)
            some, size = [], 0
    return out + (shingles(some) if some else [])


def ids_and_texts(batch) -> tuple[list[int], list[bytes]]:
    ids = [NULL_ID if x is None else x for x in batch.column("doc_id").to_pylist()]
    return ids, [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, least hashes and folded counts of each document."""
    seeds = [mixed(np.array([s + 1], dtype=np.uint64))[0] for s in range(SEEDS)]
    for whole in batches:
        for i in range(0, whole.num_rows, 500):
            b = whole.slice(i, 500)
            ids, texts = ids_and_texts(b)
            sets = sets_of(texts)
            keys = [[int((mixed(h ^ s).min() ^ s).astype(np.int64)) for s in seeds] if len(h) else [] for h in sets]
            folds = [np.bincount((h >> np.uint64(58)).astype(np.int64), minlength=FOLDS).astype(np.int16) if 0 < len(h) <= FOLDED else None for h in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), b.column("block"), pa.array([len(h) for h in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(folds, pa.list_(pa.int16()))],
                names=["doc_id", "block", "n", "keys", "folds"],
            )


def combined(h: np.ndarray, owners: int) -> np.ndarray:
    """Owner and 32 bits of a shingle in one number."""
    return (h >> np.uint64(32)) % np.uint64(owners) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def block_sets(left: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and sets of a block, in an order that does not depend on how rows arrived."""
    ids, texts = ids_and_texts(left)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return np.array([ids[i] for i in order], dtype=np.int64), sets_of([texts[i] for i in order])


def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All shingles one after another, and the number of the set that each belongs to."""
    if not sets:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def ask(owners: int):
    def step(left: pa.Table) -> pa.Table:
        block = left.column("block")[0].as_py() if left.num_rows else 0
        h, _ = flat(block_sets(left)[1])
        distinct, count = np.unique(combined(h, owners), return_counts=True)
        own, at = grouped((distinct >> np.uint64(32)).astype(np.int64))
        low, count = distinct.astype(np.uint32), np.minimum(count, 255).astype(np.uint8)
        spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        return pa.table(
            {
                "owner": pa.array(own.astype(np.int32)),
                "block": pa.array(np.full(len(own), block, dtype=np.int32)),
                "keys": pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()),
                "counts": pa.array([count[a:b].tobytes() for a, b in spans], pa.binary()),
            }
        )

    return step


def tell_frequency(table: pa.Table) -> pa.Table:
    """For each key that a block asked for, eight times the logarithm of how many documents have it (0: one)."""
    keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
    key = np.frombuffer(b"".join(keys), dtype=np.uint32)
    distinct, index = np.unique(key, return_inverse=True)
    total = np.bincount(index, weights=np.frombuffer(b"".join(counts), dtype=np.uint8), minlength=len(distinct))
    code = np.minimum(255, np.ceil(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)[index]
    cuts = np.cumsum([0, *(len(k) // 4 for k in keys)])
    n = len(keys)
    return pa.table(
        {
            "block": table.column("block").cast(pa.int32()).combine_chunks(),
            "kind": pa.array([0] * n, pa.int32()),
            "owner": table.column("owner").cast(pa.int64()).combine_chunks(),
            "other": pa.array([0] * n, pa.int64()),
            "data": pa.array([code[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        }
    )


REPLY = "block int, kind int, owner long, other long, data binary"


def rare_first(owners: int):
    """The shingles of which linked documents share one: (shingle, doc_id, block, n, label, place), without those that one document has."""

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.column("block")[0].as_py() if left.num_rows else 0
        ids, sets = block_sets(left)
        rows = list(zip(*(right.column(c).to_pylist() for c in ("kind", "owner", "other", "data")), strict=True))
        codes = np.frombuffer(b"".join(d for _, d in sorted((o, d) for k, o, _, d in rows if k == 0)), dtype=np.uint8)
        label = {o: x for k, o, x, _ in rows if k == 1}
        h, _ = flat(sets)
        distinct, index = np.unique(combined(h, owners), return_inverse=True)
        if len(codes) != len(distinct):
            raise ValueError(f"{len(codes)} replies for {len(distinct)} shingles")
        code = codes[index]
        at, out = 0, ([], [], [], [], [])
        for i, s in enumerate(sets):
            n = len(s)
            c = code[at : at + n]
            at += n
            if not c.any() or ids[i] == NULL_ID:
                continue
            first = np.lexsort((s, c))[: n - -(-PERCENT * n // 100) + 1]
            spot = np.flatnonzero(c[first] > 0)
            first = first[spot]
            out[0].append(s[first])
            out[4].append(spot)
            for k, value in enumerate((ids[i], n, label.get(int(ids[i]), int(ids[i])))):
                out[k + 1].append(np.full(len(first), value, dtype=np.int64))
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
        shingle = cat(out[0], np.uint64).astype(np.int64)
        return pa.table(
            {
                "shingle": pa.array(shingle),
                "doc_id": pa.array(cat(out[1], np.int64)),
                "block": pa.array(np.full(len(shingle), block, dtype=np.int32)),
                "n": pa.array(cat(out[2], np.int64)),
                "label": pa.array(cat(out[3], np.int64)),
                "place": pa.array(cat(out[4], np.int64)),
            }
        )

    return step


def some_sets(left: pa.Table, wanted: set[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    ids, texts = ids_and_texts(left.filter(pc.is_in(left.column("doc_id"), pa.array(sorted(wanted), pa.int64()))))
    some = sorted(zip(ids, texts, strict=True))
    return np.array([i for i, _ in some], dtype=np.int64), sets_of([t for _, t in some])


def send_rows(left: pa.Table, right: pa.Table) -> pa.Table:
    """The rows (sets) that other blocks have asked for; right has a document and the block that asks."""
    asked: dict[int, list[int]] = {}
    for doc, to in zip(right.column("owner").to_pylist(), right.column("other").to_pylist(), strict=True):
        asked.setdefault(doc, []).append(to)
    out = [(to, int(i), s.tobytes()) for i, s in zip(*some_sets(left, set(asked)), strict=True) for to in asked[int(i)]]
    return pa.table(
        {
            "block": pa.array([x[0] for x in out], pa.int32()),
            "kind": pa.array([3] * len(out), pa.int32()),
            "owner": pa.array([x[1] for x in out], pa.int64()),
            "other": pa.array([0] * len(out), pa.int64()),
            "data": pa.array([x[2] for x in out], pa.binary()),
        }
    )


def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between the block's documents and the rows sent to it, as far as they are asked for (kind 2: this document, that row)."""
    rows = list(zip(*(right.column(c).to_pylist() for c in ("kind", "owner", "other", "data")), strict=True))
    pairs: dict[int, set[int]] = {}
    for k, here, there, _ in rows:
        if k == 2:
            pairs.setdefault(there, set()).add(here)
    ids, sets = some_sets(left, {x for v in pairs.values() for x in v})
    h, who = flat(sets)
    order = np.argsort(h, kind="stable")
    h, who = h[order], who[order]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    links = set()
    for k, there, _, data in rows:
        if k != 3 or not len(h):
            continue
        row = np.frombuffer(data, dtype=np.uint64)
        low, high = np.searchsorted(h, row, side="left"), np.searchsorted(h, row, side="right")
        count = high - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        overlap = np.bincount(who[at], minlength=len(sizes))
        near = np.flatnonzero(100 * overlap >= PERCENT * (sizes + len(row) - overlap))
        links |= {(int(i), there) for i in ids[near].tolist() if overlap.any() and i in pairs.get(there, ()) and i != there}
    links = sorted(links)
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def verified(blocks: StoredBlocks, pairs: DataFrame) -> DataFrame:
    """Of pairs (doc_id, block, other, other_block), those that link, as (a, b)."""
    none = F.lit(None).cast("binary").alias("data")
    wanted = pairs.select(F.col("other_block").alias("block"), F.lit(4).alias("kind"), F.col("other").alias("owner"), F.col("block").cast("long").alias("other"), none).distinct()
    sent = blocks.answer(wanted, send_rows, REPLY)
    tests = pairs.select("block", F.lit(2).alias("kind"), F.col("doc_id").alias("owner"), "other", none)
    return blocks.answer(sent.unionByName(tests), multiply, "a long, b long")


def fits(a: str, b: str):
    """Whether two sizes allow a link."""
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b))


def apart(rows: DataFrame) -> DataFrame:
    """Pairs of rows (x, y) of different groups that share a shingle at places behind which enough are left for a link, and whose folds allow one."""
    x, y = rows.alias("x"), rows.alias("y")
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    enough = lambda overlap: (100 + PERCENT) * overlap >= PERCENT * (F.col("x.n") + F.col("y.n"))
    folded = F.aggregate(F.zip_with("x.folds", "y.folds", lambda a, b: F.least(a, b).cast("int")), F.lit(0), lambda a, b: a + b)
    bounds = (F.col("x.label") != F.col("y.label")) & (F.col("x.doc_id") > F.col("y.doc_id")) & fits("x.n", "y.n") & enough(left) & F.coalesce(enough(folded), F.lit(True))
    return x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & bounds)


def meeting(rows: DataFrame) -> DataFrame:
    """Pairs that some shared shingle names; rows need not hold all of a document's first shingles."""
    return apart(rows).select("x.doc_id", "x.block", F.col("y.doc_id").alias("other"), F.col("y.block").alias("other_block")).distinct()


def product(rows: DataFrame) -> DataFrame:
    """Pairs whose count of shared first shingles and what is left behind the last one can reach the bound; rows hold all that documents of different groups share."""
    keys = ["doc_id", "block", "other", "other_block"]
    met = apart(rows).select("x.doc_id", "x.block", F.col("y.doc_id").alias("other"), F.col("y.block").alias("other_block"), F.col("x.n").alias("n"), F.col("y.n").alias("m"), F.col("x.place").alias("i"), F.col("y.place").alias("j"), (F.col("x.alone") & F.col("y.alone")).alias("alone"))
    counts = met.groupBy(*keys).agg(F.count("*").alias("shared"), F.max("i").alias("i"), F.max("j").alias("j"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("alone").alias("alone"))
    most = F.col("shared") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1
    return counts.where(~F.col("alone") | ((100 + PERCENT) * most >= PERCENT * (F.col("n") + F.col("m")))).select(*keys)


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    spark = docs.sparkSession
    ship(spark)
    blocks, tables = StoredBlocks(docs), Tables(spark)
    keep, drop = tables.keep, tables.drop
    sizes = keep(blocks.rows.mapInArrow(profile, "doc_id long, block int, n long, keys array<long>, folds array<smallint>"), "profiles")
    keyed = sizes.where(F.col("doc_id") != NULL_ID).select(F.explode("keys").alias("key"), "doc_id", "block", "n")
    heads = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "block", "n")).alias("head"), F.count("*").alias("times")).where("times > 1")
    near = keyed.join(keep(heads, "heads"), "key").where((F.col("doc_id") != F.col("head.doc_id")) & fits("n", "head.n"))
    near = near.select("doc_id", "block", F.col("head.doc_id").alias("other"), F.col("head.block").alias("other_block")).distinct()
    groups = components(keep(verified(blocks, keep(near, "near")), "links"), tables, "near-groups")
    drop("heads", "near", "links")

    labels = sizes.select("doc_id", "block").join(groups.withColumnRenamed("node", "doc_id"), "doc_id").distinct()
    labels = labels.select("block", F.lit(1).alias("kind"), F.col("doc_id").alias("owner"), F.col("component").alias("other"), F.lit(None).cast("binary").alias("data"))
    asked = blocks.each(ask(blocks.owners), "owner int, block int, keys binary, counts binary")
    told = asked.groupBy("owner").applyInArrow(tell_frequency, REPLY)
    rare = blocks.answer(told.unionByName(labels), rare_first(blocks.owners), "shingle long, doc_id long, block int, n long, label long, place long")
    # Tables between the steps: sides of a join that are read from them can be split where a group of copies makes a shingle frequent.
    alone = F.count("*") == 1  # what is known of a document's set holds for one row
    folds = sizes.where(F.col("doc_id") != NULL_ID).groupBy("doc_id").agg(F.when(alone, F.first("folds")).alias("folds"), alone.alias("alone"))

    def of_several(rows: DataFrame, name: str) -> DataFrame:
        """Rows whose shingle more than one group has."""
        several = rows.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle")
        return keep(rows.join(keep(several, f"{name}-shared"), "shingle", "left_semi"), name)

    rare = of_several(keep(rare, "prefixes"), "several")
    drop("prefixes", "several-shared")
    one = rare.groupBy("shingle", "label").agg(F.min_by(F.struct("doc_id", "block", "n", "place"), F.xxhash64("shingle", "doc_id")).alias("h"))
    one = keep(one.select("shingle", "label", "h.*").join(folds, "doc_id", "left"), "one")
    linked = keep(verified(blocks, keep(meeting(one), "pairs")), "linked")
    stars = lambda g: g.select(F.col("node").alias("a"), F.col("component").alias("b"))
    groups = components(stars(groups).unionByName(linked), tables, "met-groups")
    drop("one", "pairs", "linked", "near-groups")
    rest = rare.drop("label").join(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("label")), "doc_id", "left")
    rest = of_several(keep(rest.withColumn("label", F.coalesce("label", "doc_id")), "labelled"), "rest")
    drop("several", "labelled", "rest-shared")
    rest = keep(rest.join(folds, "doc_id", "left"), "folded")
    drop("rest")
    linked = keep(verified(blocks, keep(product(rest), "pairs")), "linked")
    groups = components(stars(groups).unionByName(linked), tables, "groups")
    drop("folded", "pairs", "linked", "met-groups")
    blocks.drop()

    out = sizes.select("doc_id", "n").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    plain = lambda c: F.nullif(c, F.lit(NULL_ID))
    return out.select(plain(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), plain(F.coalesce("component", "doc_id")).alias("component_id"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return join_documents(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: md5(array_to_string(w[i:i + 4], ' ')))) AS x FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(a, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
