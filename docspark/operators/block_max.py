"""The best rows of many weighted queries over a block of rows, by block-max WAND, a block at a time.

Rows lie in blocks of BLOCK. The lists of rare terms are walked in full; for each frequent term only the greatest impact in
a block is added, as its upper bound. Blocks are the pivots: a query visits those with the highest bounds first, the k-th
best score so far is its threshold, and of the other blocks only those whose bound passes it are scored. Queries go through
in batches, so that a batch's blocks can be scored by one matrix product; a batch scores the blocks that any of its queries
has to. Every row that is left within rounding of the threshold is scored again in double precision, in one fixed order of
terms.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BLOCK = 32
#: Share of the rows from which a term's list is held as a column, and the most columns.
FREQUENT, MOST_COLUMNS = 1 / 8, 384
#: Queries of a batch at most, and from which (of few queries: earlier) it ends where what they have in common changes; blocks each visits first,
#: the share of blocks from which all are scored (picking them out costs a copy), and how far single precision may be off.
BATCH, LEAST_BATCH, FIRST, MOST_PICKED, SLACK = 64, 32, 4, 0.6, 1e-4


class BlockMax:
    """An inverted index over rows, ready for queries. ``ptr``: where each row's postings begin; ``term``: their terms, in
    ascending order in a row; ``impact``: what a term gives a row, times a query's weight."""

    def __init__(self, ids: np.ndarray, ptr: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        self.ids, self.ptr, self.term, self.impact = ids, ptr, term, impact
        n = self.n = len(ids)
        row = np.repeat(np.arange(n), np.diff(ptr))
        df = np.bincount(term, minlength=terms)
        often = np.flatnonzero(df > max(n * FREQUENT, 8))
        often = np.sort(often[np.argsort(-df[often], kind="stable")[:MOST_COLUMNS]])
        self.column = np.full(terms, -1, dtype=np.int64)
        self.column[often] = np.arange(len(often))
        self.blocks = -(-n // BLOCK)
        self.padded = self.blocks * BLOCK
        self.dense = np.zeros((self.padded, len(often)), dtype=np.float32)
        col = self.column[term]
        frequent = col >= 0
        self.dense[row[frequent], col[frequent]] = impact[frequent]
        self.bound = self.dense.reshape(self.blocks, BLOCK, len(often)).max(1)
        rare = np.flatnonzero(~frequent)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.list_row, self.list_impact = row[rare].astype(np.int32), impact[rare].astype(np.float32)
        self.list_ptr = np.concatenate([[0], np.cumsum(np.where(self.column >= 0, 0, df))])
        self._asked, self._weight = np.zeros(terms, dtype=bool), np.zeros(terms)  # terms of the query that is scored exactly
        self.possible = self.passed = self.scored = 0  # pairs of query and block: all, not ruled out, scored

    def exact_scores(self, rows: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The rows' scores in double precision, terms in ascending order."""
        lo, ends = self.ptr[rows], np.cumsum(self.ptr[rows + 1] - self.ptr[rows])
        own = np.concatenate([self.term[a:b] for a, b in zip(lo.tolist(), self.ptr[rows + 1].tolist(), strict=True)])
        self._asked[term], self._weight[term] = True, weight
        hit = np.flatnonzero(self._asked[own])
        at = np.searchsorted(ends, hit, side="right")
        part = self._weight[own[hit]] * self.impact[hit + (lo - np.concatenate([[0], ends[:-1]]))[at]]
        self._asked[term] = False
        return np.bincount(at, part, len(rows))  # adds in the order of the postings

    def exact(self, row: int, term: np.ndarray, weight: np.ndarray) -> float:
        return float(self.exact_scores(np.array([row]), term, weight)[0])

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], best: list[list[tuple[float, int]]], k: int, groups: Sequence | None = None) -> None:
        """Merge this block's rows into each query's k best (-score, id), ties by id, none with score 0.

        ``queries``: terms and their weights; ``groups``: what queries of one batch have in common.
        """
        begin, least = 0, min(LEAST_BATCH, len(queries) // 8)
        for at in range(1, len(queries) + 1):
            if at == len(queries) or at - begin == BATCH or (at - begin >= least and groups is not None and groups[at] != groups[begin]):
                self._batch(queries[begin:at], best[begin:at], k)
                begin = at

    def known(self, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A query's terms as this index numbers them, in ascending order, and their weights."""
        return term, weight

    def _light(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Each row's score from the rare terms' lists."""
        lo, hi = self.list_ptr[term], self.list_ptr[term + 1]
        if not len(term):
            return np.zeros(self.padded)
        spans = list(map(slice, lo.tolist(), hi.tolist()))
        part = np.concatenate([self.list_impact[s] for s in spans])
        part *= np.repeat(weight.astype(np.float32), hi - lo)
        return np.bincount(np.concatenate([self.list_row[s] for s in spans]), part, self.padded)

    def _batch(self, queries: list[tuple[np.ndarray, np.ndarray]], best: list[list[tuple[float, int]]], k: int) -> None:
        queries = [self.known(*q) for q in queries]
        size, blocks = len(queries), self.blocks
        heavy = np.zeros((size, self.dense.shape[1]), dtype=np.float32)
        light = np.empty((size, self.padded), dtype=np.float32)
        theta = np.zeros(size)
        for i, (term, w) in enumerate(queries):
            c = self.column[term]
            often = c >= 0
            heavy[i, c[often]] = w[often]
            light[i] = self._light(term[~often], w[~often])
            if len(best[i]) == k:
                theta[i] = -best[i][-1][0]
        bounds = (heavy @ self.bound.T + light.reshape(size, blocks, BLOCK).max(2)) * (1 + SLACK)
        slack = lambda x: x - SLACK * np.abs(x)  # noqa: E731  below by more than what single precision rounds
        # the blocks with the highest bounds first: they give thresholds where there are none
        visit = max(FIRST, -(-2 * k // BLOCK))
        first = np.argpartition(-bounds, min(visit, blocks - 1), axis=1)[:, :visit]
        rows = first[:, :, None] * BLOCK + np.arange(BLOCK)
        for i in range(size):
            r = rows[i].ravel()
            score = light[i, r] + self.dense[r] @ heavy[i]
            if len(score) >= k:
                theta[i] = max(theta[i], slack(np.partition(score, len(score) - k)[len(score) - k]))
        need = bounds > slack(theta)[:, None]
        chosen = np.flatnonzero(need.any(0))
        if len(chosen) > MOST_PICKED * blocks:
            chosen = np.arange(blocks)
        self.possible, self.passed, self.scored = self.possible + need.size, self.passed + int(need.sum()), self.scored + size * len(chosen)
        if not len(chosen):
            return
        whole = len(chosen) == blocks
        rows = None if whole else (chosen[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        score = heavy @ (self.dense if whole else self.dense[rows]).T
        score += light if whole else light[:, rows]
        for i, (term, w) in enumerate(queries):
            at = np.flatnonzero(score[i] > slack(theta[i]))
            if len(at) > k:
                own = score[i, at]
                at = at[own >= slack(np.partition(own, len(own) - k)[len(own) - k])]
            found = at if whole else rows[at]
            found = found[found < self.n]
            if not len(found):
                continue
            exact = self.exact_scores(found, term, w)
            hits = [(-s, d) for s, d in zip(exact.tolist(), self.ids[found].tolist(), strict=True) if s > 0]
            if hits:
                best[i][:] = sorted(best[i] + hits)[:k]
