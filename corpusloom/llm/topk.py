"""The k best candidates of many searches at once, kept while a task reads its candidates in blocks."""

from __future__ import annotations

import numpy as np

LOW = -(1 << 62)  # no candidate
NULL_ID = (1 << 63) - 1  # stands for a null id: the last of equal scores


class Running:
    """Scores and ids of the k best candidates per search, best first; of equal scores the smaller id."""

    def __init__(self, searches: int, k: int):
        self.k = k
        self.score = np.full((searches, k), LOW, np.int64)
        self.id = np.full((searches, k), NULL_ID, np.int64)

    def floor(self) -> np.ndarray:
        """What a candidate must reach; an equal score may still win by its id."""
        return self.score[:, -1]

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """One row of scores per search, LOW or less where a candidate does not count; one id per column."""
        if not scores.size:
            return
        floor = self.floor()
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        row, column = np.nonzero((scores >= floor[:, None]) & (scores > LOW))
        if not len(row):
            return
        met = np.unique(row)
        rows = np.concatenate([row, np.repeat(met, self.k)])
        values = np.concatenate([scores[row, column].astype(np.int64), self.score[met].ravel()])
        names = np.concatenate([ids[column], self.id[met].ravel()])
        order = np.lexsort((names, -values, rows))
        rows = rows[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        order, rows, nth = order[nth < self.k], rows[nth < self.k], nth[nth < self.k]
        self.score[rows, nth] = values[order]
        self.id[rows, nth] = names[order]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Search, id and score of everything kept."""
        row, nth = np.nonzero(self.score > LOW)
        return row, self.id[row, nth], self.score[row, nth]
