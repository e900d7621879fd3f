"""Removing repeated byte strings by column-wise construction of a collection's BWT and LCP.

Every WINDOW-byte string of a document that also starts in a document with a smaller id is
removed; matches never cross documents and are judged on the input.

1. Each window is routed by the least hash of the GRAM-byte strings within it. Neighbouring
   windows with one such hash form a segment, so equal windows always have equal routes. Blocks
   ask the owner of a route whether other documents have it; only then its segments travel.
2. A route that very many documents share is split: its windows are routed one by one by their
   own hash, each once from a block, so no group of copies or common passage meets in one task.
3. The owner of a bucket takes the distinct segments with the least id that has each, and builds
   the collection BWT with longest common prefixes of all that share their route: in each round, every segment that
   is long enough inserts its next symbol from the right, and the two sequences are read and written
   from front to back. A bucket's segments are in collections of about COLLECTION_BYTES, those of
   one route in one; of a segment only what lies between the first and the last window that may occur
   twice in the bucket, by its hash, is in one. Runs of common prefixes of WINDOW or more are equal windows; their least id
   goes back to the blocks. So the collections decide every window that two different segments
   share; a segment whose windows occur nowhere else is a collection of one text, whose windows all have the
   least id that has it.
4. A block marks the windows whose least id is smaller than the document's.

The sequences of a collection are bounded by its size, so they stay in memory: a file for each on
the shared store would be thousands of small ones a task, and executors' own folders are not used.

Edge cases: a null text counts as empty; texts shorter than WINDOW have no windows; rows with the
same doc_id never remove each other's bytes, and repeated rows are each returned; a null doc_id
counts as larger than all others; a text above a block's size is a block of its own, whole; columns
other than doc_id and text are left out; of equal windows the least doc_id keeps its own, so ties
do not arise.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.blocks import NULL_ID, Blocks, grouped, mixed, texts_of
from tessella.llm.runtime import ship, table

WINDOW = 50
GRAM = 20
LONGEST_RUN = WINDOW - GRAM + 1  # windows in a segment: as many as one least hash can rule, so few texts prolong the rounds
SHARED_BY = 1500  # documents from which on a route is split
COLLECTION_BYTES = 1 << 19
AT_ONCE = 1 << 15  # positions hashed at once: their arrays stay in a core's cache


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size bytes from each position on, made from hashes of halves."""
    made, length = {1: data.astype(np.uint64) + np.uint64(1)}, 1
    odd = 0x9E3779B97F4A7C15
    while length * 2 <= size:
        h = made[length]
        made[length * 2] = h[: len(h) - length] * np.uint64(pow(odd, length, 1 << 64)) + h[length:]
        length *= 2
    out, have = made[length], length
    for n in sorted((k for k in made if k < length), reverse=True):
        if size - have >= n:
            tail = made[n][have : have + len(data) - have - n + 1]
            out = out[: len(tail)] * np.uint64(pow(odd, n, 1 << 64)) + tail
            have += n
    return mixed(out)


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of width values from each position on."""
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[: len(h) - have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if have < width else h


class Segments:
    """A block's documents, and its segments: start, windows, route, document."""

    def __init__(self, table: pa.Table):
        self.ids, texts = texts_of(table)
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.buffer = b"".join(texts)
        data = np.frombuffer(self.buffer, dtype=np.uint8)
        starts, lengths, routes = [], [], []
        room = np.ones(len(data), dtype=bool)
        for end, size in zip(self.ends.tolist(), self.sizes.tolist(), strict=True):
            room[end - min(size, WINDOW - 1) : end] = False
        for at in range(0, len(data) - WINDOW + 1, AT_ONCE):
            part = data[at : at + AT_ONCE + WINDOW - 1]
            least = least_of(gram_hashes(part, GRAM), WINDOW - GRAM + 1)
            fits = room[at : at + len(least)]
            # Where a document ends, positions without room for a window lie between it and the next.
            change = np.r_[True, (least[1:] != least[:-1]) | (fits[1:] != fits[:-1])]
            head = np.flatnonzero(change)
            size = np.diff(np.r_[head, len(least)])
            keep = fits[head]
            head, size = head[keep], size[keep]
            times = -(-size // LONGEST_RUN)
            part_of = np.repeat(np.arange(len(head)), times)
            nth = np.arange(len(part_of)) - np.repeat(np.cumsum(times) - times, times)
            starts.append(head[part_of] + nth * LONGEST_RUN + at)
            lengths.append(np.minimum(size[part_of] - nth * LONGEST_RUN, LONGEST_RUN))
            routes.append(least[head[part_of]])
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
        self.start, self.length, self.route = cat(starts, np.int64), cat(lengths, np.int64), cat(routes, np.uint64)
        self.doc = np.searchsorted(self.ends, self.start, side="right")

    def keys(self, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (owner, 32 bits of route) in order, how many ids have each (255 at most), and each segment's index in them."""
        combined = (self.route >> np.uint64(32)) % np.uint64(owners) << np.uint64(32) | self.route & np.uint64(0xFFFFFFFF)
        order = np.argsort(combined, kind="stable")
        distinct, at = grouped(combined[order])
        index = np.empty(len(order), dtype=np.int64)
        index[order] = np.repeat(np.arange(len(distinct)), np.diff(at))
        # Segments are in the order of their documents, and these in the order of their ids: within a key, ids rise.
        doc = self.ids[self.doc[order]]
        new = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, dtype=bool)
        new[at[:-1]] = True
        count = np.add.reduceat(new.astype(np.int64), at[:-1]) if len(distinct) else np.zeros(0, dtype=np.int64)
        return distinct, np.minimum(count, 255), index


def ask(owners: int):
    def step(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py() if table.num_rows else 0
        distinct, count, _ = Segments(table).keys(owners)
        own, at = grouped((distinct >> np.uint64(32)).astype(np.int64))
        low, count = distinct.astype(np.uint32), count.astype(np.uint8)
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


def tell_shared(limit: int):
    """Owner of routes: 0 if one block has it (which knows its own documents), 1 if several have, 2 if it is to be split."""

    def step(table: pa.Table) -> pa.Table:
        blocks, keys, counts = (table.column(c).to_pylist() for c in ("block", "keys", "counts"))
        sizes = [len(k) // 4 for k in keys]
        key = np.frombuffer(b"".join(keys), dtype=np.uint32)
        distinct, index, times = np.unique(key, return_inverse=True, return_counts=True)
        total = np.bincount(index, weights=np.frombuffer(b"".join(counts), dtype=np.uint8), minlength=len(distinct))
        code = np.where(total >= limit, 2, np.where(times > 1, 1, 0)).astype(np.uint8)[index]
        cuts = np.cumsum([0, *sizes])
        return pa.table(
            {
                "block": pa.array(blocks, pa.int32()),
                "kind": pa.array([0] * len(blocks), pa.int32()),
                "owner": table.column("owner").cast(pa.int32()).combine_chunks(),
                "data": pa.array([zlib.compress(code[a:b].tobytes(), 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            }
        )

    return step


def travellers(own: Segments, owners: int, replies: list[bytes]):
    """What a block sends to the buckets: distinct segments and their route's hash, and for each sent occurrence where it is.

    Returns texts, hashes, least ids (by segment) and starts, windows, segment (by occurrence).
    """
    distinct, count, index = own.keys(owners)
    code = np.frombuffer(b"".join(map(zlib.decompress, replies)), dtype=np.uint8) if replies else np.zeros(0, dtype=np.uint8)
    if len(code) != len(distinct):
        raise ValueError(f"{len(code)} replies for {len(distinct)} routes")
    code = np.maximum(code, (count > 1).astype(np.uint8))[index]
    chosen = np.flatnonzero(code)
    split = code[chosen] > 1
    times = np.where(split, own.length[chosen], 1)
    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    starts = np.repeat(own.start[chosen], times) + inner
    lengths = np.repeat(np.where(split, 1, own.length[chosen]), times)
    # A whole segment and a single window of it never meet: a route is either split or not, for all blocks.
    known: dict[bytes, int] = {}
    buffer = own.buffer
    segment = np.array([known.setdefault(buffer[a:b], len(known)) for a, b in zip(starts.tolist(), (starts + lengths + WINDOW - 1).tolist(), strict=True)], dtype=np.int64)
    texts = list(known)
    # Equal texts have equal hashes, so any occurrence tells a text's.
    hashes, alone = np.empty(len(texts), dtype=np.uint64), np.zeros(len(texts), dtype=bool)
    hashes[segment], alone[segment] = np.repeat(own.route[chosen], times), np.repeat(split, times)
    for k in np.flatnonzero(alone).tolist():
        hashes[k] = xxhash.xxh64_intdigest(texts[k])
    least = np.full(len(texts), NULL_ID, dtype=np.int64)
    np.minimum.at(least, segment, own.ids[np.searchsorted(own.ends, starts, side="right")])
    return texts, hashes, least, starts, lengths, segment


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments in the order in which they are sent, the buckets, and where each begins in that order."""
    bucket = (mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own, at = grouped(bucket[order])
    return order, own, at


def of_kind(replies: pa.Table, kind: int) -> list[bytes]:
    rows = sorted((o, d) for k, o, d in zip(*(replies.column(c).to_pylist() for c in ("kind", "owner", "data")), strict=True) if k == kind)
    return [d for _, d in rows]


def send(owners: int, buckets: int):
    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.column("block")[0].as_py() if left.num_rows else 0
        own = Segments(left)
        texts, hashes, least, *_ = travellers(own, owners, of_kind(right, 0))
        order, which, at = by_bucket(hashes, buckets)
        rows = [order[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] if len(order) else []
        return pa.table(
            {
                "bucket": pa.array(which.astype(np.int32)),
                "block": pa.array(np.full(len(rows), block, dtype=np.int32)),
                "texts": pa.array([zlib.compress(b"".join([texts[i] for i in r.tolist()]), 1) for r in rows], pa.binary()),
                "sizes": pa.array([np.array([len(texts[i]) for i in r.tolist()], dtype=np.uint8).tobytes() for r in rows], pa.binary()),
                "hashes": pa.array([hashes[r].astype(np.uint32).tobytes() for r in rows], pa.binary()),
                "least": pa.array([least[r].tobytes() for r in rows], pa.binary()),
            }
        )

    return step


def by_symbol(bwt: np.ndarray) -> np.ndarray:
    """The places of a sequence by symbol, those of one symbol in their order: Arrow counts small integers instead of comparing them."""
    return pc.array_sort_indices(pa.array(bwt)).to_numpy(zero_copy_only=False).view(np.int64)


def collection_bwt(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """BWT (0 for the end mark, else byte + 1) and LCP of all suffixes of a collection, end marks in the order of the texts.

    Round j inserts the suffixes of j + 1 symbols. A suffix that was inserted in the round before
    at p is preceded by c = BWT[p]; the new suffix comes where the stable order of the BWT by
    symbol has p. Its common prefix with the neighbour before it is one more than the least LCP
    between the two neighbours' own places; so is that of the neighbour behind it. Each round reads
    the two sequences from front to back and writes them anew.
    """
    m = len(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data, ends = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum(sizes)

    def symbol(who: np.ndarray, j: int) -> np.ndarray:
        """The j-th symbol from the right, or the end mark."""
        out = np.zeros(len(who), dtype=np.uint8)
        has = sizes[who] > j
        out[has] = data[ends[who[has]] - 1 - j] + np.uint8(1)
        return out

    who = np.arange(m)
    bwt, lcp = symbol(who, 0), np.zeros(m, dtype=np.uint8)
    place = np.arange(m)
    for j in range(int(sizes.max(initial=0))):
        n = len(bwt)
        still = sizes[who] > j
        who, place = who[still], place[still]
        counts = np.bincount(bwt, minlength=256)
        marks = int(counts[0])  # texts that are complete: their end marks are not inserted again
        order = by_symbol(bwt)[marks:]
        fresh = np.zeros(n, dtype=bool)
        fresh[place] = True
        fresh = fresh[order]
        first = np.cumsum(counts[1:-1])
        first = np.r_[0, first][counts[1:] > 0]  # where each symbol's suffixes begin in this order
        touched = fresh.copy()
        touched[1:] |= fresh[:-1]
        touched[first] = False
        # Least LCP between each touched place and the one before it in this order, taken from right to left.
        k = np.flatnonzero(touched)
        here, behind = order[k], order[k - 1]
        turn = np.argsort(here)[::-1]
        value = np.empty(len(k), dtype=np.uint8)
        if len(k):
            bounds = np.empty(2 * len(k), dtype=np.int64)
            bounds[0::2], bounds[1::2] = behind[turn] + 1, here[turn] + 1
            value[turn] = np.minimum.reduceat(np.r_[lcp, np.uint8(0)], bounds)[0::2] + np.uint8(1)
        # Place all in the new order: end marks first, then one suffix for each symbol that has been read.
        total = m + len(order)
        old = np.ones(total, dtype=bool)
        added = np.flatnonzero(fresh)
        old[m + added] = False
        next_bwt, next_lcp = np.empty(total, dtype=np.uint8), np.empty(total, dtype=np.uint8)
        next_bwt[old], next_lcp[old] = bwt, lcp
        number = np.empty(n, dtype=np.int32)
        number[place] = np.arange(len(place), dtype=np.int32)
        place[number[order[added]]] = m + added
        next_bwt[place] = symbol(who, j + 1)
        next_lcp[m + k] = value
        # The first suffix of a symbol has nothing before it; one that was first until now is touched and so has been set.
        next_lcp[m + first] = 0
        bwt, lcp = next_bwt, next_lcp
    return bwt, lcp


def least_ids(texts: list[bytes], ids: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each text, the least id that each of its windows has in the collection."""
    bwt, lcp = collection_bwt(texts)
    m, sizes = len(texts), np.array([len(t) for t in texts], dtype=np.int64)
    order = by_symbol(bwt)
    marks = len(bwt) - np.count_nonzero(bwt)
    step = np.empty(len(bwt), dtype=np.int32)
    step[order] = np.arange(len(bwt), dtype=np.int32) - np.int32(marks - m)
    heads = np.flatnonzero(lcp < window)
    group = np.cumsum(lcp < window) - 1
    held = np.full(len(bwt), NULL_ID, dtype=np.int64)
    who, place, seen = np.arange(m), np.arange(m), []
    for j in range(1, int(sizes.max(initial=0)) + 1):
        still = sizes[who] >= j
        who, place = who[still], step[place[still]]
        if j >= window:
            held[place] = ids[who]
            seen.append((j, who, place))
    least = np.minimum.reduceat(held, heads)
    at = np.cumsum(np.r_[0, np.maximum(sizes - window + 1, 0)])
    out = np.empty(at[-1], dtype=np.int64)
    for j, w, p in seen:
        out[at[w] + sizes[w] - j] = least[group[p]]
    return np.split(out, at[1:-1])


def common(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text its first window that another place of the texts may hold too, and how many windows there are to its last such one (0: none).

    Told by hashes, and equal windows have equal ones: every window that two texts share is among these.
    """
    first, windows = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    if not texts:
        return first, windows
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    room = np.ones(int(ends[-1]), dtype=bool)
    for k in range(1, WINDOW):
        room[ends - k] = False
    at = np.flatnonzero(room)
    h = gram_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), WINDOW)[at]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = at[twice]
    who, heads = grouped(np.searchsorted(ends, at, side="right"))
    first[who] = at[heads[:-1]] - (ends - sizes)[who]
    windows[who] = at[heads[1:] - 1] - at[heads[:-1]] + 1
    return first, windows


def reply(least: np.ndarray, varied: np.ndarray, windows: list[np.ndarray]) -> bytes:
    """One id for each segment; where it varies, one for each of its windows behind them all."""
    return zlib.compress(b"".join([np.int64(len(least)).tobytes(), least.tobytes(), varied.tobytes(), *(w.tobytes() for w in windows)]), 1)


def replied(data: bytes, windows: np.ndarray) -> np.ndarray:
    """The least id of every window of the segments, of which the first in windows have been answered here."""
    data = zlib.decompress(data)
    n = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
    least = np.frombuffer(data, dtype=np.int64, count=n, offset=8)
    varied = np.frombuffer(data, dtype=bool, count=n, offset=8 + 8 * n)
    out = np.repeat(least, windows[:n])
    out[np.repeat(varied, windows[:n])] = np.frombuffer(data, dtype=np.int64, offset=8 + 9 * n)
    return out


def meet(buckets: int):
    """Owner of a bucket: the least id of every window of every segment that was sent."""

    def step(table: pa.Table) -> pa.Table:
        found: dict[bytes, int] = {}
        sent, routes = [], []
        for packed, sizes, h in zip(*(table.column(c).to_pylist() for c in ("texts", "sizes", "hashes")), strict=True):
            data, cuts = zlib.decompress(packed), np.cumsum(np.r_[0, np.frombuffer(sizes, dtype=np.uint8).astype(np.int64)]).tolist()
            sent.append(np.array([found.setdefault(data[a:b], len(found)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], dtype=np.int64))
            routes.append(np.frombuffer(h, dtype=np.uint32))
        texts = list(found)
        hashed = np.zeros(len(texts), dtype=np.uint64)
        least = np.full(len(texts), NULL_ID, dtype=np.int64)
        for mine, h, ids in zip(sent, routes, table.column("least").to_pylist(), strict=True):
            hashed[mine] = h
            np.minimum.at(least, mine, np.frombuffer(ids, dtype=np.int64))
        # Equal windows have equal hashes, so texts of one hash go to one collection; a text alone with its hash shares no window with another.
        _, same, times = np.unique(hashed, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times[same] > 1) if len(texts) else np.zeros(0, dtype=np.int64)
        first, windows = common([texts[k] for k in shared.tolist()])
        shared, first, windows = shared[windows > 0], first[windows > 0], windows[windows > 0]
        parts = max(1, -(-int((windows + WINDOW - 1).sum()) // COLLECTION_BYTES))
        part = (mixed(hashed[shared]) % np.uint64(parts)).astype(np.int64)
        # Most texts have one id for all their windows.
        top, varied, answers = least.copy(), np.zeros(len(texts), dtype=bool), {}
        for p in range(parts):
            some = np.flatnonzero(part == p)
            if len(some):
                taken = list(zip(shared[some].tolist(), first[some].tolist(), windows[some].tolist(), strict=True))
                for (k, a, n), ids in zip(taken, least_ids([texts[k][a : a + n + WINDOW - 1] for k, a, n in taken], least[shared[some]]), strict=True):
                    if (ids != least[k]).any():
                        answers[k] = np.full(len(texts[k]) - WINDOW + 1, least[k], dtype=np.int64)
                        answers[k][a : a + n] = ids
                        top[k] = answers[k].min()
                        varied[k] = (answers[k] != top[k]).any()
        return pa.table(
            {
                "block": table.column("block").cast(pa.int32()).combine_chunks(),
                "kind": pa.array([1] * len(sent), pa.int32()),
                "owner": table.column("bucket").cast(pa.int32()).combine_chunks(),
                "data": pa.array([reply(top[mine], varied[mine], [answers[k] for k in mine[varied[mine]].tolist()]) for mine in sent], pa.binary()),
            }
        )

    return step


def remove(owners: int, buckets: int, texts_too: bool):
    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Segments(left)
        texts, hashes, _, starts, lengths, segment = travellers(own, owners, of_kind(right, 0))
        order, _, cuts = by_bucket(hashes, buckets)
        windows = np.array([len(t) - WINDOW + 1 for t in texts], dtype=np.int64)
        answers = of_kind(right, 1)
        if len(answers) != len(cuts) - 1:
            raise ValueError(f"{len(answers)} replies for {len(cuts) - 1} buckets")
        parts = [replied(x, windows[order[a:]]) for x, a in zip(answers, cuts[:-1].tolist(), strict=True)]
        got = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        begin = np.empty(len(texts), dtype=np.int64)
        begin[order] = np.cumsum(np.r_[0, windows[order][:-1]]) if len(order) else begin
        inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.repeat(starts, lengths) + inner
        least = got[np.repeat(begin[segment], lengths) + inner]
        marked = at[least < own.ids[np.searchsorted(own.ends, at, side="right")]]
        size = len(own.buffer)
        depth = np.zeros(size + WINDOW + 1, dtype=np.int32)
        starting = np.zeros(size + 1, dtype=bool)
        starting[marked] = True  # a position starts one window
        depth[: size + 1] += starting
        depth[WINDOW : size + WINDOW + 1] -= starting
        gone = np.cumsum(depth)[:size] > 0
        data = np.frombuffer(own.buffer, dtype=np.uint8)
        rows = []
        for i, end in enumerate(own.ends.tolist()):
            g = gone[end - own.sizes[i] : end]
            kept = data[end - own.sizes[i] : end][~g].tobytes()
            spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + (len(g) > 0 and g[0]))
            rows.append((None if own.ids[i] == NULL_ID else int(own.ids[i]), len(g), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if texts_too else None))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    return step


def drop_repeats(docs: DataFrame, texts_too: bool = True, shared_by: int = SHARED_BY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (texts_too) the kept bytes of each document."""
    ship(docs.sparkSession)
    blocks = Blocks(docs.select("doc_id", "text"))
    owners = buckets = blocks.owners
    asked = blocks.each(ask(owners), "owner int, block int, keys binary, counts binary")
    reply = "block int, kind int, owner int, data binary"
    shared = asked.groupBy("owner").applyInArrow(tell_shared(shared_by), reply)
    sent = blocks.answer(shared, send(owners, buckets), "bucket int, block int, texts binary, sizes binary, hashes binary, least binary")
    least = sent.groupBy("bucket").applyInArrow(meet(buckets), reply)
    made = blocks.answer(shared.unionByName(least), remove(owners, buckets, texts_too), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return made if texts_too else made.drop("kept")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole document that repeat a document with a smaller id."""
    return drop_repeats(table(spark, sf_dir, "documents"), texts_too=False)


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
v AS (SELECT doc_id, unnest(list_transform(range(0, greatest(0, length(h) // 2 - 49)), lambda i: {'i': i, 's': md5(substr(h, 2 * i + 1, 100))})) AS z FROM d),
w AS (SELECT doc_id, z.i AS i, z.s AS s FROM v),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
g AS (SELECT w.doc_id, i FROM w JOIN f USING (s) WHERE f.least < w.doc_id),
r AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM g),
x AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r),
p AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM x GROUP BY ALL),
q AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM p),
t AS (SELECT q.doc_id, string_agg(substr(h, 2 * upto + 1, 2 * (a - upto)), '' ORDER BY k) AS head, max(b) AS tail, count(*) AS n_spans, sum(b - a) AS n_removed
      FROM q JOIN d USING (doc_id) GROUP BY q.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
