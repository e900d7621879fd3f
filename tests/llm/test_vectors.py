import hashlib
import math
import random

import numpy as np
import pytest

from tessella.llm import centroids, codebooks, hamming, vectors

ROWS = "vec_id long, embedding array<float>, label int, cluster string, code string, node long, id string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    """(vec_id, vector, label) rows, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, l, "x", "x", 1, "x") for i, v, l in rows], ROWS)


def single(v):
    return [float(np.float32(x)) for x in v]


def d2(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def lloyd(points, book, rounds):
    near = lambda v: min(range(len(book)), key=lambda j: (d2(v, book[j]), j))
    for _ in range(rounds):
        own = [near(v) for v in points]
        sums = {j: [v for v, o in zip(points, own, strict=True) if o == j] for j in set(own)}
        book = [[sum(x) // len(sums[j]) for x in zip(*sums[j], strict=True)] if j in sums else c for j, c in enumerate(book)]
    return book, [near(v) for v in points]


def brute_clusters(rows, dims, k, rounds, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    book, own = lloyd([v for _, v in kept], [v for _, v in order[:k]], rounds)
    dist = [d2(v, book[o]) for (_, v), o in zip(kept, own, strict=True)]
    each = {j: sum(d for d, o in zip(dist, own, strict=True) if o == j) for j in set(own)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in book]
    return sorted(((i, o, d, each[o], sum(dist), digest[o]) for (i, _), o, d in zip(kept, own, dist, strict=True)), key=str)


def some_rows(r, dims, n):
    """Vectors with ties: few different components, many repeats."""
    return [(i, single(r.choice([-0.5, -0.25, 0.0, 0.25, 0.3, 1.0]) if r.random() < 0.7 else r.gauss(0, 1) for _ in range(dims)), r.choice([None, 0, 1, 7])) for i in range(n)]


@pytest.mark.parametrize(("seed", "dims", "k", "rounds"), [(1, 2, 3, 4), (2, 8, 8, 6), (3, 64, 8, 3)])
def test_clusters_equal_brute_force(spark, seed, dims, k, rounds):
    r = random.Random(seed)
    rows = some_rows(r, dims, 90)
    bad = [None, [], [0.0] * (dims + 1), [NAN] * dims, [INF] + [0.0] * (dims - 1), [None] + [0.0] * (dims - 1)]
    rows += [(100 + i, v, 0) for i, v in enumerate(bad)] + [rows[0], rows[0], (None, rows[1][1], 1)]
    got = centroids.cluster(frame(spark, rows), k=k, rounds=rounds, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_clusters(rows, dims, k, rounds)


def test_clusters_of_few_none_and_very_large_vectors(spark):
    few = [(1, [1.0, 0.0], 0), (2, [0.0, -1.0], 0)]
    assert sorted(tuple(x) for x in centroids.cluster(frame(spark, few), dims=2).collect()) == brute_clusters(few, 2, 8, 10)
    assert centroids.cluster(frame(spark, []), dims=2).count() == 0
    large = [(i, single([3e38 * (-1) ** i, float(i)]), 0) for i in range(6)] + [(9, single([2e9, -2e9]), 0), (10, single([2e9 + 300, -2e9]), 0)]
    got = {x.vec_id: x for x in centroids.cluster(frame(spark, large), k=4, rounds=3, dims=2).collect()}
    expected = brute_clusters(large, 2, 4, 3)
    assert sorted((i, got[i].cluster, got[i].centroid_sha256) for i in got) == sorted((i, o, h) for i, o, _, _, _, h in expected)
    assert all(got[i].distance == (d if d < 1 << 63 else None) for i, _, d, _, _, _ in expected)


def test_shortlist_holds_every_nearest_centroid():
    r = np.random.default_rng(4)
    base = r.integers(-(1 << 20), 1 << 20, (8, 64))
    c = np.concatenate([base, base, base + r.integers(-1, 2, (8, 64))])  # equal and nearly equal ones
    x = base[r.integers(0, 8, 4000)] + r.integers(-3, 4, (4000, 64))
    exact = np.stack([vectors.squared(x, np.broadcast_to(e, x.shape)) for e in c], axis=1)
    listed = centroids.shortlist(x, c)
    assert listed[exact == exact.min(axis=1, keepdims=True)].all() and listed.mean() < 0.5
    assert (centroids.nearest(x, c) == exact.argmin(axis=1)).all()


def test_limbs_make_the_value():
    for v in (0, -1, 1, (1 << 62) - 1, 1 << 62, -(1 << 62) - 1, 3**200, -(3**200)):
        parts = vectors.limbs(v)
        assert sum(p << vectors.LIMB * i for i, p in enumerate(parts)) == v and all(-(1 << 63) <= p < 1 << 63 for p in parts)


def brute_codes(rows, parts, entries, rounds, scale=4096):
    kept = [(i, [math.floor(scale * x) for x in v], lab, v) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    dims = len(order[0][1]) if order else 0
    width, codes, errors, books = dims // parts, [""] * len(kept), [0] * len(kept), []
    fits = [len(v) == dims for _, v, _, _ in kept]
    for p in range(parts):
        cut = lambda v, p=p: v[p * width : (p + 1) * width]
        points = [cut(v) for (_, v, _, _), f in zip(kept, fits, strict=True) if f]
        book, own = lloyd(points, [cut(v) for _, v, _, _ in [x for x in order if len(x[1]) == dims][:entries]], rounds)
        books += [str(x) for e in book for x in e]
        own, points = iter(own), iter(points)
        for i, f in enumerate(fits):
            if f:
                o = next(own)
                codes[i] += f"{o:02x}"
                errors[i] += d2(next(points), book[o])
    codes = [c if f else None for c, f in zip(codes, fits, strict=True)]
    errors = [e if f else None for e, f in zip(errors, fits, strict=True)]
    total = {lab: sum(e for (_, _, o, _), e in zip(kept, errors, strict=True) if o == lab and e is not None) for _, _, lab, _ in kept}
    digest = hashlib.sha256(",".join(books).encode()).hexdigest()
    return sorted(((k[0], c, e, total[k[2]], digest) for k, c, e in zip(kept, codes, errors, strict=True)), key=str)


@pytest.mark.parametrize(("seed", "dims", "parts", "entries", "rounds"), [(1, 8, 4, 3, 5), (2, 16, 8, 16, 6), (3, 4, 1, 5, 3), (4, 8, 8, 1, 2)])
def test_codes_equal_brute_force(spark, seed, dims, parts, entries, rounds, monkeypatch):
    monkeypatch.setattr(codebooks, "CHUNK", 16)
    r = random.Random(seed)
    rows = some_rows(r, dims, 70)
    rows += [(100, None, 0), (101, [NAN] * dims, 0), (102, [-INF] * dims, 0), (103, [None] * dims, 0), (104, [1.0] * (dims + 1), 1), (0, rows[5][1], None), rows[3], (None, rows[4][1], 7)]
    got = codebooks.compress(frame(spark, rows), parts=parts, entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_codes(rows, parts, entries, rounds)


def test_codes_of_none_of_few_and_of_very_large_vectors(spark):
    assert codebooks.compress(frame(spark, [])).count() == 0
    few = [(2, [1.0, 0.5], None), (1, [0.0, 2.0], None)]
    assert sorted(tuple(x) for x in codebooks.compress(frame(spark, few), parts=2).collect()) == brute_codes(few, 2, 16, 6)
    odd = codebooks.compress(frame(spark, [(1, [1.0, 2.0, 3.0], 0)]), parts=2).collect()
    assert [(x.vec_id, x.code, x.error, x.label_error) for x in odd] == [(1, None, None, None)]
    large = [(i, single([3e37 * i, float(i), 1e6 * i * i, -2.0]), 0) for i in range(-4, 5)]
    got = {x.vec_id: (x.code, x.error, x.codebooks_sha256) for x in codebooks.compress(frame(spark, large), parts=2, entries=3, rounds=4).collect()}
    assert got == {i: (c, e if e < 1 << 63 else None, h) for i, c, e, _, h in brute_codes(large, 2, 3, 4)}


def test_only_violated_parts_are_rescanned(spark):
    r = np.random.default_rng(5)
    middles = r.normal(0, 10, (4, 16))
    rows = [(i, single(middles[i % 4] + r.normal(0, 0.1, 16)), 0) for i in range(400)]
    scans = []
    got = codebooks.compress(frame(spark, rows), parts=2, entries=4, rounds=5, scans=scans).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_codes(rows, 2, 4, 5)
    assert scans[0] == 800 and sum(scans[1:]) < 100


def brute_links(rows, threshold=0.9):
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    x = np.array([v if g else [0.0] * 64 for (_, v, _), g in zip(rows, good, strict=True)], dtype=np.float64)
    size = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.where(size > 0, size, 1)[:, None] / np.where(size > 0, size, 1)[None, :] >= threshold
    near &= np.array(good)[:, None] & np.array(good)[None, :]
    np.fill_diagonal(near, False)
    return near


def near_rows(r, groups, spread):
    """Groups of near copies around random directions, at cosines of about 1 / (1 + spread ** 2)."""
    out = []
    for size in groups:
        base = r.normal(0, 1, 64)
        base /= np.linalg.norm(base)
        for _ in range(size):
            noise = r.normal(0, 1, 64)
            out.append(single((base + spread * noise / np.linalg.norm(noise)) * r.uniform(0.5, 3)))
    return [(int(i), out[i], int(i) % 5) for i in r.permutation(len(out))]


def component_of(near, ids):
    least = np.array([np.inf if i is None else i for i in ids], dtype=float)
    while True:
        after = np.minimum(least, np.where(near, least[None, :], np.inf).min(axis=1))
        if (after == least).all():
            return [None if v == np.inf else int(v) for v in least]
        least = after


@pytest.mark.parametrize(("run", "spread"), [(512, 0.15), (8, 0.15), (8, 0.24)])
def test_links_equal_brute_force(spark, run, spread, monkeypatch):
    monkeypatch.setattr(hamming, "RUN", run)
    monkeypatch.setattr(hamming, "PIECE", 64)
    monkeypatch.setattr(hamming, "PEELS", 2)
    r = np.random.default_rng(11)
    rows = near_rows(r, [60, 40, 12, 5, 3, 2, 2, *[1] * 100], spread)
    rows += [(1000, None, 0), (1001, [0.0] * 64, 0), (1002, [NAN] * 64, 0), (1003, [None] * 64, 0)]
    rows += [(2000 + i, rows[0][1], 0) for i in range(30)] + [rows[1], rows[1], (None, rows[2][1], 1), (None, single(r.normal(0, 1, 64)), 1)]
    near = brute_links(rows)
    expected = sorted(((i, int(n), c, i == c) for (i, _, _), n, c in zip(rows, near.sum(axis=1), component_of(near, [i for i, _, _ in rows]), strict=True)), key=str)
    got = sorted((tuple(x) for x in hamming.near_duplicates(frame(spark, rows)).collect()), key=str)
    if spread < 0.2:
        assert got == expected
    else:  # pairs near the threshold: none below it, and nearly all above it
        most = {}
        for i, n, _, _ in expected:
            most.setdefault(i, []).append(n)
        assert all(n <= max(most[i]) for i, n, _, _ in got)
        assert sum(n for _, n, _, _ in got) >= 0.9 * sum(n for _, n, _, _ in expected)


def test_links_of_no_rows_and_of_unusable_ones(spark):
    assert hamming.near_duplicates(frame(spark, [])).count() == 0
    bad = hamming.near_duplicates(frame(spark, [(1, None, 0), (2, [0.0, 0.0], 0), (None, [NAN, 1.0], 0)])).collect()
    assert sorted((tuple(x) for x in bad), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]
    mixed = hamming.near_duplicates(frame(spark, [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [2.0, 0.0, 0.0], 0)])).collect()
    assert sorted(tuple(x) for x in mixed) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_peeling_a_hot_key_takes_rows_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(hamming, "RUN", 32)
    sizes = []
    monkeypatch.setattr(hamming, "in_blocks", lambda rows, *a, old=hamming.in_blocks: (sizes.append(rows.count()), old(rows, *a))[1])
    rows = near_rows(np.random.default_rng(3), [500, *[1] * 50], 0.1)
    got = hamming.near_duplicates(frame(spark, rows)).collect()
    assert sorted(x.n_links for x in got) == [0] * 50 + [499] * 500
    assert not sizes  # no key was left to be compared block by block
