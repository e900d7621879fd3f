import os
import random
import re

import pytest

from tessella.llm import components, jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingle_set(t))
    least = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if least[b] < least[a] and any(s and 100 * len(s & u) >= 80 * len(s | u) for s in sets[a] for u in sets[b]):
                    least[a], changed = least[b], True
    return sorted((d, len(shingle_set(t)), least[d]) for d, t in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, docs, seed, monkeypatch):
    monkeypatch.setattr(jaccard.StoredBlocks.__init__, "__defaults__", (3000,))
    monkeypatch.setattr(jaccard, "SEEDS", 1)  # leaves work for the second step
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeÉñ") for _ in range(r.randint(2, 5))) for _ in range(200)]
    rows, passage = [], [r.choice(words) for _ in range(30)]
    for g in range(12):
        base = [r.choice(words) for _ in range(r.choice([3, 5, 6, 9, 40, 80, 200]))] + (passage if g % 3 == 0 else [])
        for _ in range(r.choice([1, 2, 6])):
            w = base[:]
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows), (" " if r.random() < 0.5 else "\n").join(w).upper() if r.random() < 0.2 else " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "Solo"), (904, "solo"), (905, "a b"), (905, "a b")]
    got = jaccard.join_documents(docs(rows, extra=["n", "block", "key"]))
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == brute(rows)


def test_null_ids_and_no_rows(docs):
    text = "one two three four five six"
    got = jaccard.join_documents(docs([(None, text), (None, text), (3, text), (4, text)])).collect()
    assert sorted(((x.doc_id, x.component_id) for x in got), key=str) == [(3, 3), (4, 3), (None, None), (None, None)]
    assert jaccard.join_documents(docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == [(i, 0) for i in range(41)] + [(100 + i, 100) for i in range(30)]


def test_template_pages_make_pairs_in_proportion(spark, docs, monkeypatch):
    r = random.Random(8)
    sentences = [" ".join(f"s{k}w{i}" for i in range(11)) for k in range(30)]
    made = []
    monkeypatch.setattr(jaccard, "verified", lambda blocks, pairs, old=jaccard.verified: (made.append(pairs.count()), old(blocks, pairs))[1])
    for n in (300, 600):
        rows = [(i, " ".join(r.sample(sentences, 8))) for i in range(n)]
        made.clear()
        got = jaccard.join_documents(docs(rows))
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == brute(rows)
        assert made[0] <= jaccard.SEEDS * n  # one head for each least hash
        assert sum(made[1:]) < n / 10  # of thousands of pairs that share rare shingles


def test_one_id_of_two_texts_of_equal_size(spark, docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, b), (2, a + " z"), (3, b + " y"), (4, c), (5, "w" * 3000 + " a b c d e"), (6, "w" * 3000 + " a b c d e")]
    got = jaccard.join_documents(docs(rows, extra=["a.b", "folds"]))
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == brute(rows)


def test_nothing_is_left_behind_but_what_the_result_reads(spark, docs):
    from tessella.llm.runtime import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    jaccard.join_documents(docs([(i, f"one two three four five six {i % 3}") for i in range(30)])).count()
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before) == ["groups", "profiles"]
