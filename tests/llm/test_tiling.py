import random
import re
import time

import pytest

from tessella.llm import tiling


def slow_tile(text, item, least):
    """The longest common stretch of unmarked tokens, again and again until it is shorter than least."""
    text, item, tiles, covered = list(text), list(item), 0, 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and item[p + n] is not None and text[t + n] is not None and text[t + n] >= 0:
                    n += 1
                best = min(best, (-n, p, t))
        n, p, t = -best[0], *best[1:]
        if n < least:
            return tiles, covered
        item[p : p + n], text[t : t + n] = [None] * n, [None] * n
        tiles, covered = tiles + 1, covered + n


@pytest.mark.parametrize("least", [2, 3, 5])
def test_tiles_until_none_is_left(least):
    r = random.Random(least)
    for _ in range(150):
        item = [r.randrange(r.choice((2, 4, 30))) for _ in range(r.randint(1, 30))]
        text = []
        for _ in range(r.randint(1, 5)):
            at = r.randrange(len(item))
            text += [*item[at : at + r.randint(1, 14)], *r.choice(([], [-1], [0]))]
        assert tiling.tile(text, item, least) == slow_tile(text, item, least)
    for _ in range(100):  # short quotes that overlap
        item, text = list(range(20)), []
        for _ in range(6):
            at = r.randrange(16)
            text += [*item[at : at + r.randint(least, 2 * least - 1)], -1]
        assert tiling.tile(text, item, least) == slow_tile(text, item, least)


def test_the_free_head_of_a_covered_match_counts(spark, docs):
    w = [f"w{i}" for i in range(20)]
    text = " and ".join(" ".join(x) for x in (w[0:8], w[5:14], w[5:14]))
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    leaks = tiling.find_leaks(docs([(1, text)], extra=["leaks"]), bench).first().leaks
    assert [tuple(x) for x in leaks] == [(1, 2, 14, 20, 0.7)]


def brute_leaks(text, items, least=5, threshold=0.5):
    words = re.findall(r"\w+", (text or "").lower())
    out = []
    for number, body in items:
        item = re.findall(r"\w+", (body or "").lower())
        code = {w: i for i, w in enumerate(dict.fromkeys(item))}
        tiles, covered = slow_tile([code.get(w, -1) for w in words], [code[w] for w in item], least)
        if len(item) >= least and covered >= threshold * len(item):
            out.append((number, tiles, covered, len(item)))
    return sorted(out)


@pytest.mark.parametrize("most_bytes", [0, 1 << 20])
def test_leaks_equal_brute_force(spark, docs, most_bytes):
    r = random.Random(11)
    word = lambda n: [f"w{r.randrange(n)}" for _ in range(r.randint(4, 40))]
    items = [(i, " ".join(word(r.choice((3, 12, 400))))) for i in range(12)] + [(50, "one two"), (51, None)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            w = items[r.randrange(12)][1].split()
            at = r.randrange(len(w))
            parts.append(" ".join(w[at : at + r.randint(3, 30)] * r.choice((1, 1, 2))))
            parts.append(" ".join(word(500)[: r.randint(0, 9)]))
        rows.append((i, r.choice((" ", ", ")).join(parts)))
    rows += [(None, items[0][1]), (70, None), (71, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = tiling.find_leaks(docs(rows, extra=["row", "a.b"]), bench, most_bytes=most_bytes)
    assert [c for c in got.columns if c != "leaks"] == docs(rows, extra=["row", "a.b"]).columns
    assert sorted((str(x.doc_id), [tuple(y)[:4] for y in x.leaks]) for x in got.collect()) == sorted((str(d), brute_leaks(t, items)) for d, t in rows)


def test_equal_tokens_take_no_time():
    began = time.time()
    assert tiling.tile([1] * 16_000, [1] * 400, 5) == (1, 400)
    assert time.time() - began < 10
