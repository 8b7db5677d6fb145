"""The best rows of short weighted queries over a block of rows, all scored in full.

A question has some thirty terms, and most of its cost are those of many rows: they are held as columns and added whole, the
others are added where they occur. Terms are added in ascending order in double precision, so that a row's score is the same
in any block, and nothing has to be scored again.
"""

from __future__ import annotations

import numpy as np

#: Share of the rows from which a term's list is held as a column, the most columns, and rows in a group of which only the best score is compared.
FREQUENT, MOST_COLUMNS, GROUP = 1 / 3, 64, 32


def in_order(x: np.ndarray, n: int) -> np.ndarray:
    """Stable places in ascending order of integers from 0 to below ``n``: 16 bits at a time, which numpy sorts by digits."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, max(n - 1, 1).bit_length(), 16):
        order = order[np.argsort(((x[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


class BlockScores:
    """An inverted index over rows. ``ids``: distinct; ``ptr``: where each row's postings begin; ``term``: their terms;
    ``part``: what a term gives a row, times a query's weight."""

    def __init__(self, ids: np.ndarray, ptr: np.ndarray, term: np.ndarray, part: np.ndarray, terms: int):
        n, up = len(ids), np.argsort(ids)
        self.ids, place = ids[up], np.empty(n, np.int64)
        place[up] = np.arange(n)
        row = np.repeat(place, np.diff(ptr))
        order = in_order(term, terms)
        self.list_row, self.list_part = row[order], part[order]
        df = np.bincount(term, minlength=terms)
        self.list_ptr = np.concatenate([[0], np.cumsum(df)])
        often = np.flatnonzero(df > max(n * FREQUENT, 8))
        often = often[np.argsort(-df[often], kind="stable")[:MOST_COLUMNS]]
        self.padded = -(-n // GROUP) * GROUP
        self.columns: dict[int, np.ndarray] = {}
        for t in often.tolist():
            at = slice(self.list_ptr[t], self.list_ptr[t + 1])
            self.columns[t] = np.zeros(self.padded)
            self.columns[t][self.list_row[at]] = self.list_part[at]
        self._product = np.empty(self.padded)

    def best(self, term: np.ndarray, weight: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows that have one of the terms, which are added in their order; ties by id. Rows below
        ``least`` need not be listed."""
        score = np.zeros(self.padded)
        lo, hi = self.list_ptr[term].tolist(), self.list_ptr[term + 1].tolist()
        for t, w, a, b in zip(term.tolist(), weight.tolist(), lo, hi, strict=True):
            if (column := self.columns.get(t)) is not None:
                score += np.multiply(column, w, out=self._product)
            else:
                score[self.list_row[a:b]] += self.list_part[a:b] * w
        groups = score.reshape(GROUP, -1).max(0)
        if least <= 0 and len(groups) > k:
            least = np.partition(groups, len(groups) - k)[len(groups) - k]  # k rows reach it
        at = np.flatnonzero(score >= least) if least > 0 else np.flatnonzero(score)
        at = at[np.argsort(-score[at], kind="stable")[:k]]
        return self.ids[at], score[at]
