import time
import tracemalloc

import numpy as np
import pytest

from tessella.functions.joining import joined_tree


def whole_matrix_tree(names: list[str], d: np.ndarray) -> str:
    """The whole matrix looked at in each step."""
    nodes, d = list(names), d.astype(float).copy()
    while len(nodes) > 2:
        n, r = len(nodes), d.sum(axis=1)
        q = np.round(d - (r[:, None] + r[None, :]) / max(n - 2, 1), 9)
        q[np.tril_indices(n)] = np.inf
        i, j = np.unravel_index(np.argmin(q), q.shape)
        lift = (d[i, j] + (r[i] - r[j]) / max(n - 2, 1)) / 2
        new = (d[i] + d[j] - d[i, j]) / 2
        label = f"({nodes[i]}:{lift:.6f},{nodes[j]}:{d[i, j] - lift:.6f})"
        keep = [k for k in range(n) if k not in (i, j)]
        grown = np.zeros((len(keep) + 1, len(keep) + 1))
        grown[1:, 1:] = d[np.ix_(keep, keep)]
        grown[0, 1:] = grown[1:, 0] = new[keep]
        nodes, d = [label, *(nodes[k] for k in keep)], grown
    return f"({nodes[0]}:{d[0, 1]:.6f},{nodes[1]}:0.000000);" if len(nodes) == 2 else f"{nodes[0] if nodes else ''};"



def matrix(r, n, kind):
    if kind == "random":
        d = r.uniform(0.1, 1, (n, n))
    elif kind == "ties":
        d = r.integers(1, 5, (n, n)) / 4
    else:
        x = r.normal(0, 1, (n, 5))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    return d


@pytest.mark.parametrize("kind", ["random", "ties", "points"])
def test_same_trees_as_with_the_whole_matrix(kind):
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 5, 17, 60, 120):
        names = [f"t{i}" for i in range(n)]
        d = matrix(r, n, kind)
        assert joined_tree(names, d) == whole_matrix_tree(names, d)


def test_three_thousand_taxa():
    d = matrix(np.random.default_rng(4), 3000, "points")
    began = time.time()
    assert joined_tree([f"t{i}" for i in range(3000)], d).count("(") == 2999
    assert time.time() - began < 120  # on a machine that other work shares


def test_a_tree_needs_little_beside_its_matrix():
    n = 1200
    d = matrix(np.random.default_rng(5), n, "points")
    tracemalloc.start()
    try:
        tree = joined_tree([f"t{i}" for i in range(n)], d)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # Its copy of the matrix takes 8 bytes a cell.
    assert tree.count("(") == n - 1 and peak < 16 * n * n
