"""Name similarities of whole batches of pairs, and the best candidates of a batch of names by falling bounds.

Names are rows of a code point matrix. Loops run over letter positions, for all pairs of a slice at once; slices
hold names of like length and stay within a budget of cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

CELLS = 4 << 20
_BUCKETS = 64
_PAD_LEFT, _PAD_RIGHT = -1, -2
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _points(names: Sequence[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, padded to the longest name, and the lengths."""
    lengths = np.array([len(n) for n in names], np.int64)
    table = np.full((len(names), int(lengths.max(initial=0))), pad, np.int64)
    table[np.arange(table.shape[1])[None, :] < lengths[:, None]] = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4")
    return table, lengths


def _slices(size: np.ndarray) -> list[np.ndarray]:
    """Rows in the order of the cells they need, cut so that each slice stays within ``CELLS``."""
    order = np.argsort(size, kind="stable")
    made, at = [], 0
    while at < len(order):
        count = len(order) - at
        while count > 1 and count * size[order[at + count - 1]] > CELLS:
            count = (count + 1) // 2
        made.append(order[at: at + count])
        at += count
    return made


def _edits(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, swaps: bool) -> np.ndarray:
    """Edit distance of each row, with swaps of letters (and edits between them) as one edit if asked."""
    pairs, rows, cols = len(a), a.shape[1], b.shape[1]
    far = rows + cols + 1
    grid = np.full((pairs, rows + 2, cols + 2), far, np.int64)  # row and column 0 stay far, 1 is the empty name
    grid[:, 1:, 1] = np.arange(rows + 1)
    grid[:, 1, 1:] = np.arange(cols + 1)
    place, each = np.arange(1, cols + 1), np.arange(pairs)[:, None]
    last_row = np.zeros((pairs, cols), np.int64)
    for i in range(1, rows + 1):
        same = a[:, i - 1, None] == b
        best = np.minimum(grid[:, i, 1:-1] + ~same, grid[:, i, 2:] + 1)
        if swaps:
            hit = np.maximum.accumulate(np.where(same, place, 0), axis=1)
            last_col = np.concatenate([np.zeros((pairs, 1), np.int64), hit[:, :-1]], axis=1)
            best = np.minimum(best, grid[each, last_row, last_col] + (i - last_row - 1) + 1 + (place - last_col - 1))
            last_row = np.where(same, i, last_row)
        # a letter left out costs one more than the cell to the left: a running minimum along the row
        run = np.concatenate([np.full((pairs, 1), i), best - place], axis=1)
        grid[:, i + 1, 2:] = np.minimum.accumulate(run, axis=1)[:, 1:] + place
    return grid[np.arange(pairs), la + 1, lb + 1]


def _edit_similarity(pairs: Pairs, swaps: bool) -> np.ndarray:
    _, la, _, lb = pairs
    longest = np.maximum(la, lb)
    return np.where(longest == 0, 1.0, 1.0 - _edits(*pairs, swaps) / np.maximum(longest, 1))


def _jaro(pairs: Pairs) -> np.ndarray:
    a, la, b, lb = pairs
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)[:, None]
    spots = np.arange(b.shape[1])[None, :]
    used, hit = np.zeros(b.shape, bool), np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        fits = (b == a[:, i, None]) & ~used & (spots >= i - reach) & (spots <= i + reach)
        if fits.size:
            hit[:, i] = fits.any(axis=1)
            used[hit[:, i], fits.argmax(axis=1)[hit[:, i]]] = True
    m = hit.sum(axis=1)
    left, right = np.zeros((len(a), int(m.max(initial=0))), np.int64), np.zeros((len(a), int(m.max(initial=0))), np.int64)
    for letters, flags, table in ((a, hit, left), (b, used, right)):
        row, at = np.nonzero(flags)
        table[row, (np.cumsum(flags, axis=1) - 1)[row, at]] = letters[row, at]
    swaps = (left != right).sum(axis=1) // 2
    some = np.maximum(m, 1)
    score = (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - swaps) / some) / 3
    return np.where((la == 0) & (lb == 0), 1.0, np.where(m == 0, 0.0, score))


def _prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the first four letters agree from the start."""
    width = min(4, a.shape[1], b.shape[1])
    return np.cumprod(a[:, :width] == b[:, :width], axis=1).sum(axis=1) if width else np.zeros(len(a), np.int64)


def _lifted(base: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return np.where(base > 0.7, base + prefix * 0.1 * (1 - base), base)


KERNELS: dict[str, Callable[[Pairs], np.ndarray]] = {
    "lev": lambda pairs: _edit_similarity(pairs, False),
    "dam_lev": lambda pairs: _edit_similarity(pairs, True),
    "jaro": _jaro,
    "jaro_win": lambda pairs: _lifted(_jaro(pairs), _prefix(pairs[0], pairs[2])),
}


def similarities(left: Sequence[str], right: Sequence[str], method: str) -> np.ndarray:
    """Similarity of each pair; equal pairs are scored once."""
    if not len(left):
        return np.zeros(0)
    number: dict[tuple[str, str], int] = {}
    at = np.array([number.setdefault(pair, len(number)) for pair in zip(left, right, strict=True)])
    names = list(number)
    return _scored([x for x, _ in names], [y for _, y in names], method)[at]


def _scored(left: Sequence[str], right: Sequence[str], method: str) -> np.ndarray:
    scores = np.empty(len(left))
    lengths = np.array([[len(x), len(y)] for x, y in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    for rows in _slices((lengths[:, 0] + 2) * (lengths[:, 1] + 2)):
        scores[rows] = KERNELS[method]((*_points([left[i] for i in rows], _PAD_LEFT), *_points([right[i] for i in rows], _PAD_RIGHT)))
    return scores


class Candidates:
    """Candidates with their letter counts, which bound every similarity from above."""

    def __init__(self, names: Sequence[str], method: str):
        self.names, self.method = sorted(names, reverse=True), method  # of equal scores the larger string comes first
        self.counts, self.lengths = self._counts(self.names)
        self.heads = np.array([[ord(c) for c in n[:4].ljust(4, "\0")] for n in self.names], np.int64).reshape(-1, 4)
        self.scored = 0

    @staticmethod
    def _counts(names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        points, lengths = _points(names, 0)
        row, at = np.nonzero(np.arange(points.shape[1])[None, :] < lengths[:, None])
        cells = row * _BUCKETS + points[row, at] % _BUCKETS
        return np.bincount(cells, minlength=len(names) * _BUCKETS).reshape(len(names), _BUCKETS).astype(np.int32), lengths

    def bounds(self, names: Sequence[str]) -> np.ndarray:
        """(names, candidates): a similarity is at most this, as it needs letters in common."""
        counts, lengths = self._counts(names)
        common = np.zeros((len(names), len(self.names)))
        for k in np.flatnonzero(counts.any(axis=0)).tolist():
            common += np.minimum(counts[:, k, None], self.counts[None, :, k])
        la, lb = lengths[:, None], self.lengths[None, :]
        if self.method in ("lev", "dam_lev"):
            most = np.where(np.maximum(la, lb) == 0, 1.0, common / np.maximum(np.maximum(la, lb), 1))
        else:
            most = np.where(common > 0, (common / np.maximum(la, 1) + common / np.maximum(lb, 1) + 1) / 3, ((la == 0) & (lb == 0)) * 1.0)
            if self.method == "jaro_win":
                heads = np.array([[ord(c) for c in n[:4].ljust(4, "\1")] for n in names], np.int64).reshape(-1, 4)
                prefix = np.cumprod(heads[:, None, :] == self.heads[None, :, :], axis=2).sum(axis=2)
                most = _lifted(most, prefix)
        return most + 1e-9

    def best(self, names: Sequence[str], n: int) -> list[list[tuple[float, str]]]:
        """The ``n`` best (score, candidate) of each name; only candidates whose bound reaches the nth score are scored."""
        found: list[list[tuple[float, str]]] = []
        step = max(1, CELLS // max(1, len(self.names)))
        for a in range(0, len(names), step):
            found += self._best(names[a: a + step], n)
        return found

    def _best(self, names: Sequence[str], n: int) -> list[list[tuple[float, str]]]:
        count = len(self.names)
        if not count:
            return [[] for _ in names]
        bounds = self.bounds(names)
        order = np.argsort(-bounds, axis=1, kind="stable")
        scores = np.full(bounds.shape, -np.inf)
        least = np.full(len(names), -np.inf)
        done, width = 0, max(n, 4)
        open_names = np.arange(len(names))
        while len(open_names) and done < count:
            chosen = order[open_names, done: done + width]
            row, at = np.nonzero(np.take_along_axis(bounds[open_names], chosen, axis=1) >= least[open_names, None])
            row, at = open_names[row], chosen[row, at]
            self.scored += len(row)
            scores[row, at] = _scored([names[i] for i in row], [self.names[j] for j in at], self.method)
            done += chosen.shape[1]
            if done >= n:
                least[open_names] = -np.partition(-scores[open_names], n - 1, axis=1)[:, n - 1]
            if done < count:
                following = bounds[open_names, order[open_names, done]]
                open_names = open_names[following >= least[open_names]]
            width *= 2
        top = np.argsort(-scores, axis=1, kind="stable")[:, :n]
        return [[(float(scores[i, j]), self.names[j]) for j in top[i] if scores[i, j] > -np.inf] for i in range(len(names))]
