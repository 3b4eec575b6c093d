"""A run-length compressed Burrows-Wheeler index over rows of equal width, for long matches."""

import numpy as np


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of a two-dimensional array of keys."""
    flat = keys.ravel()
    order = np.argsort(flat)
    ordered = flat[order]
    rank = np.empty(len(flat), np.uint64)
    rank[order] = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1]))).astype(np.uint64)
    return rank.reshape(keys.shape)


def _behind(ranks: np.ndarray, step: int) -> np.ndarray:
    """Ranks of what stands ``step`` to the right, 0 past the end."""
    out = np.zeros_like(ranks)
    if step < ranks.shape[1]:
        out[:, : ranks.shape[1] - step] = ranks[:, step:]
    return out


class RunIndex:
    """Of rows of bytes other than 0: their suffixes sorted to the row's end, equal ones by row.

    Kept are the runs of the transform (start, byte, where the run's first entry maps to), and
    samples where runs or groups of suffixes with the same ``length`` bytes end: the smallest
    owner of such a group (``length``: over 8). Rows are walked from their end by last-to-first mapping over runs.
    """

    def __init__(self, rows: np.ndarray, owners: np.ndarray, valid: np.ndarray, length: int):
        n, width = rows.shape
        self.n, self.width, self.length = n, width, length
        wide = np.zeros((n, width + 9), np.uint8)
        wide[:, :width] = rows
        key = np.zeros((n, width + 1), np.uint64)
        for k in range(8):
            key = key << np.uint64(8) | wide[:, k : k + width + 1].astype(np.uint64)
        ranks, depth, group = _ranks(key), 8, None
        while depth <= width:
            if depth < length <= 2 * depth:  # the order by exactly ``length`` bytes
                group = ranks << np.uint64(32) | _behind(ranks, length - depth)
            ranks = _ranks(ranks << np.uint64(32) | _behind(ranks, depth))
            depth *= 2
        row = np.repeat(np.arange(n, dtype=np.uint64), width + 1)
        order = np.argsort(ranks.ravel() << np.uint64(32) | row)
        group = group.ravel()[order]
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        least = np.where(valid, owners[:, None], np.iinfo(np.int64).max).ravel()[order]
        # bytes before each suffix; the row's first has the end mark, which is below all bytes
        before = np.zeros((n, width + 1), np.int16)
        before[:, 1:] = rows.astype(np.int16) + 1
        last = before.ravel()[order]
        self.starts = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
        self.bytes = last[self.starts]
        sizes = np.diff(np.append(self.starts, len(last)))
        by_byte = np.argsort(self.bytes, kind="stable")
        self.to = np.empty(len(sizes), np.int64)
        self.to[by_byte] = np.concatenate(([0], np.cumsum(sizes[by_byte])[:-1]))
        self.heads, self.least = heads, np.minimum.reduceat(least, heads)

    def owners(self, columns: int) -> np.ndarray:
        """For the first ``columns`` positions of each row: the smallest owner of the same ``length`` bytes at a valid position."""
        out = np.empty((self.n, columns), np.int64)
        at = np.arange(self.n)  # the rows' empty suffixes precede all others
        for column in range(self.width - 1, -1, -1):
            run = np.searchsorted(self.starts, at, "right") - 1
            at = self.to[run] + at - self.starts[run]
            if column < columns:
                out[:, column] = self.least[np.searchsorted(self.heads, at, "right") - 1]
        return out
