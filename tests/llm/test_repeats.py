import hashlib
import random

import pytest

from tessella.llm import blocks, suffix_dedup


def brute(rows, window=50):
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for i in range(len(t) - window + 1):
            first.setdefault(t[i : i + window], d)
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            f = first[t[i : i + window]]
            if f is not None and (d is None or f < d):
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(t, gone, strict=True) if not x)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("trial", range(12))
def test_bwt_and_common_prefixes(trial):
    r = random.Random(trial)
    texts = [bytes(r.choice(b"ab" if trial % 2 else b"abcd") for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 9))]
    suffixes = sorted((([c + 1 for c in t[k:]] + [0], i, k) for i, t in enumerate(texts) for k in range(len(t) + 1)), key=lambda x: x[:2])
    bwt, lcp = suffix_dedup.collection_bwt(texts)
    assert bwt.tolist() == [texts[i][k - 1] + 1 if k else 0 for _, i, k in suffixes]
    for (a, _, _), (b, _, _), n in zip(suffixes, suffixes[1:], lcp.tolist()[1:], strict=False):
        own = next(x for x in range(len(a)) if x >= len(b) or a[x] != b[x] or a[x] == 0)
        assert n == own


@pytest.mark.parametrize(("block_bytes", "shared_by"), [(6 << 20, 1500), (700, 1500), (2000, 3)])
def test_equals_brute_force(spark, docs, monkeypatch, block_bytes, shared_by):
    monkeypatch.setattr(blocks.Blocks.__init__, "__defaults__", (block_bytes,))
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(2, 7))) for _ in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = text(25), text(60)
    rows = [(1, base), (2, base), (3, base[:150] + "X" + base[150:]), (4, text(5) + passage + text(7)), (5, passage + text(9)), (6, passage), (7, None), (8, ""), (9, "a" * 400), (10, "a" * 130 + "b" * 60), (6, passage), (None, base), (None, text(20)), (11, text(300) + base + passage)]
    rows += [(20 + i, text(4) + passage[: 30 + 9 * i] + text(4)) for i in range(12)]
    got = suffix_dedup.drop_repeats(docs(rows, extra=["block", "kept"]))
    assert sorted([(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()], key=str) == brute([(d, (t or "").encode()) for d, t in rows])
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in got.collect())


def test_no_rows(docs):
    assert suffix_dedup.drop_repeats(docs([])).count() == 0


def test_windows_that_segments_share_are_decided_by_a_collection(docs, monkeypatch):
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = text(120)
    rows = [(1, text(90) + passage), (2, passage + text(80)), (3, text(30) + passage[10:100] + text(30)), (4, text(200)), (5, text(10) + passage)]
    decided = set()

    def spy(texts, ids, window=50, old=suffix_dedup.least_ids):
        out = old(texts, ids, window)
        decided.update(t[i : i + window] for t, found in zip(texts, out, strict=True) for i in range(len(found)))
        return out

    monkeypatch.setattr(suffix_dedup, "least_ids", spy)
    import pyarrow as pa

    # One block's steps in this process.
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows]), "block": pa.array([0] * len(rows), pa.int32())})
    told = suffix_dedup.tell_shared(1500)(suffix_dedup.ask(1)(table))
    sent = suffix_dedup.send(1, 1)(table, told)
    answers = suffix_dedup.meet(1)(sent)
    made = suffix_dedup.remove(1, 1, False)(table, pa.concat_tables([told, answers]))
    got = sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in made.to_pylist())
    assert got == brute([(i, t.encode()) for i, t in rows])
    segments, *_ = suffix_dedup.travellers(suffix_dedup.Segments(table), 1, suffix_dedup.of_kind(told, 0))
    within = {}
    for n, x in enumerate(segments):
        for k in range(len(x) - 49):
            within.setdefault(x[k : k + 50], set()).add(n)
    several = {w for w, at in within.items() if len(at) > 1}
    assert several and several <= decided


def test_segments_that_share_a_route_but_no_window_need_no_construction(monkeypatch):
    import pyarrow as pa

    r = random.Random(2)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    gram, passage = text(30), text(90)
    rows = [(i, text(40) + gram + text(40)) for i in range(40)]
    taken = []
    monkeypatch.setattr(suffix_dedup, "least_ids", lambda texts, ids, old=suffix_dedup.least_ids: taken.extend(texts) or old(texts, ids))

    def run(rows):
        table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows]), "block": pa.array([0] * len(rows), pa.int32())})
        told = suffix_dedup.tell_shared(1500)(suffix_dedup.ask(1)(table))
        made = suffix_dedup.remove(1, 1, False)(table, pa.concat_tables([told, suffix_dedup.meet(1)(suffix_dedup.send(1, 1)(table, told))]))
        assert sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in made.to_pylist()) == sorted(brute([(i, t.encode()) for i, t in rows]))

    run(rows)
    assert not taken
    run([*rows, (90, text(40) + passage), (91, passage + text(40)), (92, text(10) + passage[:60] + text(10))])
    assert taken and all(t in passage.encode() for t in taken)


def test_a_text_above_a_blocks_size(docs, monkeypatch):
    monkeypatch.setattr(blocks.Blocks.__init__, "__defaults__", (500,))
    r = random.Random(3)
    text = "".join(r.choice("abc d") for _ in range(5000))
    rows = [(1, text[1000:3000]), (2, text), (3, text[:80])]
    got = suffix_dedup.drop_repeats(docs(rows, extra=["n_bytes", "a.b"]))
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()) == brute([(d, t.encode()) for d, t in rows])


def test_rows_equal_in_all_are_spread_over_blocks(spark):
    from tessella.llm.blocks import Blocks, StoredBlocks

    same = spark.createDataFrame([(None, "a" * 2000)] * 600, "doc_id long, text string").repartition(16)
    for blocks in (Blocks(same, 60_000), StoredBlocks(same, 20_000)):
        sizes = [r["count"] for r in blocks.rows.groupBy("block").count().collect()]
        assert sum(sizes) == 600 and len(sizes) >= 8 and max(sizes) < 200
    different = spark.range(2000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "rpad(string(id), 500, 'x') AS text").coalesce(1)
    sizes = [r["count"] for r in Blocks(different, 150_000).rows.groupBy("block").count().collect()]
    assert len(sizes) == 7 and max(sizes) < 500
