"""Neighbour joining with a bound for each row: a step looks only at rows that may hold the best pair.

Needs the matrix, 8 bytes a cell, and little beside it. A row's bound is its least distance less the share of the node there
when it was last looked at; what it may have lost since is no more than the sum of the largest growth of a share in each step.
"""

from __future__ import annotations

import numpy as np

FIRST, CELLS = 8, 1 << 17  # rows looked at first, cells at once
CLOSE = 2e-9  # distances are told apart by nine decimals
FULL = 7 / 8


class Rows:
    """Distances of nodes, infinite where no pair is, and for each row a lower bound of its distances less the shares."""

    def __init__(self, d: np.ndarray, share: np.ndarray):
        np.fill_diagonal(d, np.inf)
        self.d, self.share = d, share
        self.live = np.ones(len(d), dtype=bool)
        self.low = np.full(len(d), -np.inf)

    def shared(self, share: np.ndarray) -> None:
        """Shares have changed: no distance less a share has lost more than the largest growth."""
        self.low -= (share - self.share)[self.live].max()
        self.share = share

    def replaced(self, i: int, j: int, new: np.ndarray) -> None:
        """Node i is now the new one, j is gone."""
        self.live[j] = False
        new = np.where(self.live, new, np.inf)
        new[i] = np.inf
        self.d[i], self.d[:, i] = new, new
        self.d[j], self.d[:, j] = np.inf, np.inf
        self.low[i], self.low[j] = -np.inf, np.inf

    def joined(self, i: int) -> None:
        """The distances to a new node count in the bounds of all rows, by its share."""
        np.minimum(self.low, self.d[i] - self.share[i], out=self.low)
        self.low[i] = -np.inf

    def compact(self) -> np.ndarray:
        """Only the live nodes, moved up in the same matrix; returns which they were."""
        kept = np.flatnonzero(self.live)
        for to, row in enumerate(kept.tolist()):
            self.d[to, : len(kept)] = self.d[row, kept]
        self.d, self.share, self.low = self.d[: len(kept), : len(kept)], self.share[kept], self.low[kept]
        self.live = np.ones(len(kept), dtype=bool)
        return kept


def closest(rows: Rows, place: np.ndarray) -> tuple[int, int]:
    """The pair of least distance relative to both shares; of equal ones that whose places come first."""
    share = rows.share
    key = np.where(rows.live, rows.low - share, np.inf)
    order = np.argsort(key)
    key, at, width, best, found = key[order], 0, FIRST, np.inf, []
    most = max(FIRST, CELLS // len(order))
    while at < len(order) and key[at] <= best + CLOSE and key[at] < np.inf:
        i = order[at : at + width]
        i = i[: np.searchsorted(key[at : at + width], best + CLOSE, side="right")]
        dist = rows.d[i]
        less = dist - share
        rows.low[i] = less.min(axis=1)
        less -= share[i][:, None]
        best = min(best, less.min())
        r, c = np.nonzero(less <= best + CLOSE)
        if len(r):
            q = np.round(dist[r, c] - (share[i][r] + share[c]), 9)
            r, c = r[q == q.min()], c[q == q.min()]
            ends = np.sort(place[np.stack([i[r], c], axis=1)], axis=1)
            k = np.lexsort((ends[:, 1], ends[:, 0]))[0]
            one, other = sorted((int(i[r[k]]), int(c[k])), key=lambda x: place[x])
            found.append((q.min(), ends[k, 0], ends[k, 1], one, other))
        at, width = at + len(i), min(2 * width, most)
    return min(found)[3:]


def joined_tree(names: list[str], d: np.ndarray, own: bool = False) -> str:
    """Newick text by neighbour joining; ties go to the pair named first, a joined pair standing before all others. own: d may be written over."""
    n = len(names)
    if n < 2:
        return f"{names[0] if n else ''};"
    d = d if own else np.array(d, dtype=np.float64)
    np.fill_diagonal(d, 0.0)
    labels = list(names)
    total, place = d.sum(axis=1), np.arange(n)
    live = n
    rows = Rows(d, total / max(n - 2, 1))
    for step in range(n - 2):
        if live < len(rows.d) * FULL:
            kept = rows.compact()
            labels, total, place = [labels[k] for k in kept], total[kept], place[kept]
        i, j = closest(rows, place)
        between = rows.d[i, j]
        lift = (between + (total[i] - total[j]) / max(live - 2, 1)) / 2
        other = rows.live.copy()
        other[[i, j]] = False
        di, dj = rows.d[i][other], rows.d[j][other]
        new = np.zeros(len(other))
        new[other] = (di + dj - between) / 2
        total[other] += new[other] - di - dj
        total[i] = new[other].sum()
        labels[i] = f"({labels[i]}:{lift:.6f},{labels[j]}:{between - lift:.6f})"
        rows.replaced(i, j, new)
        place[i], live = -1 - step, live - 1
        # The new node's share has no earlier one to have grown from: its distances are counted by themselves.
        share = np.where(rows.live, total / max(live - 2, 1), 0.0)
        rows.share[i] = share[i]
        rows.shared(share)
        rows.joined(i)
    a, b = sorted(np.flatnonzero(rows.live).tolist(), key=lambda k: place[k])
    return f"({labels[a]}:{rows.d[a, b]:.6f},{labels[b]}:0.000000);"
