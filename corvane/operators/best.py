"""The best rows of many questions, as a task meets them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Best:
    """The best candidates of each question, as many as its pool, ties to smaller ids; twice the pool are held at most."""

    def __init__(self, pools: Sequence[int]):
        self.pools, self.held = pools, [(np.zeros(0, np.int64), np.zeros(0))] * len(pools)
        #: What a candidate must reach to be among a question's best so far.
        self.least = np.full(len(pools), -np.inf)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        pool = self.pools[q]
        near = scores >= self.least[q]
        ids, scores = ids[near], scores[near]
        if len(ids) > 2 * pool:
            least = scores[np.argpartition(-scores, pool - 1)[:pool]].min()
            ids, scores = self._cut(q, ids[scores >= least], scores[scores >= least])
        ids, scores = np.concatenate((self.held[q][0], ids)), np.concatenate((self.held[q][1], scores))
        if len(ids) > 2 * pool:
            ids, scores = self._cut(q, ids, scores)
        self.held[q] = ids, scores

    def _cut(self, q: int, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores))[: self.pools[q]]
        self.least[q] = max(self.least[q], scores[order[-1]])
        return ids[order], scores[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Question, id and score of what is held."""
        n = [len(i) for i, _ in self.held]
        ids, scores = zip(*self.held, strict=True)
        return np.repeat(np.arange(len(n), dtype=np.int32), n), np.concatenate(ids), np.concatenate(scores)
