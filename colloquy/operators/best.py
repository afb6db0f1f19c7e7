"""The k best of many queries, kept by a task over the rows that it reads one part after the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Numbers of a part's matrix of scores, 8 bytes each.
MOST_SCORES = 1 << 21


class Best:
    """The k best names of each of m queries by score rounded to six digits, ties to the smaller name."""

    def __init__(self, m: int, k: int):
        self.k, self.held, self.floor = k, [(np.zeros(0), None)] * m, np.full(m, -np.inf)

    def add(self, names: np.ndarray, scores: np.ndarray, first: int = 0, above: float | None = None) -> None:
        """Scores of the queries from `first` on, a row each, with a column for each name; only those over `above` count."""
        k, floor = self.k, self.floor[first : first + len(scores)].copy()
        fresh = np.isneginf(floor)
        if scores.shape[1] > k and fresh.any():  # the k-th best of this part alone
            floor[fresh] = np.partition(scores[fresh], -k, axis=1)[:, -k]
        seen = scores >= (floor - 1e-6)[:, None]
        if above is not None:
            seen &= scores > above
        at, col = np.nonzero(seen)
        if not len(at):
            return
        value = np.round(scores[at, col], 6)
        ends = np.append(np.flatnonzero(np.diff(at)) + 1, len(at))
        for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
            j = first + at[a]
            old, old_names = self.held[j]
            s, n = value[a:b], names[col[a:b]]
            if above is not None:
                s, n = s[s > above], n[s > above]
            if old_names is not None:
                s, n = np.append(old, s), np.append(old_names, n)
            order = np.lexsort((n, -s))[:k]
            self.held[j] = s[order], n[order]
            if len(order) == k:
                self.floor[j] = s[order[-1]]

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the query, scores, names) of the queries that have any."""
        for j, (s, n) in enumerate(self.held):
            if n is not None and len(n):
                yield j, s, n


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    return x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)


class Nearest:
    """The k nearest by cosine to queries (arrays of any lengths, or none); 0 for vectors that do not fit a query.

    Scores are taken in parts of MOST_SCORES numbers, however many vectors and queries there are.
    """

    def __init__(self, queries: list, k: int):
        by_length: dict[int, list[int]] = {}
        for j, q in enumerate(queries):
            by_length.setdefault(len(q) if q is not None else 0, []).append(j)
        self.order = [j for js in by_length.values() for j in js]
        self.sides = [(d, unit(np.array([queries[j] for j in js], float)) if d else np.zeros((len(js), 0))) for d, js in by_length.items()]
        self.best = Best(len(queries), k)

    def add(self, names: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Vectors one after the other in `flat`, each of its own size."""
        starts, first = np.cumsum(sizes) - sizes, 0
        for d, side in self.sides:
            fit = np.flatnonzero(sizes == d) if d else np.zeros(0, np.int64)
            for a in range(0, len(names), 2048):
                part = fit[(fit >= a) & (fit < a + 2048)]
                v = np.nan_to_num(unit(flat[starts[part][:, None] + np.arange(d)])) if len(part) else None
                width = max(1, MOST_SCORES // 2048)
                for q in range(0, len(side), width):
                    some = side[q : q + width]
                    scores = np.zeros((len(some), min(2048, len(names) - a)))
                    if v is not None:
                        scores[:, part - a] = some @ v.T
                    self.best.add(names[a : a + 2048], scores, first + q)
            first += len(side)

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for j, s, n in self.best.rows():
            yield self.order[j], s, n


class Weighted:
    """The k best by inner product with sparse queries, given as three arrays: query, term, weight; only scores over 0 count."""

    def __init__(self, m: int, terms: int, query: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int):
        self.m, self.terms, self.best = m, terms, Best(m, k)
        self.width = max(1, MOST_SCORES // max(terms, 1))
        self.rows_of = max(1, min(1024, MOST_SCORES // max(terms, 1)))
        order = np.argsort(query, kind="stable")
        self.query, self.term, self.weight = query[order], term[order], weight[order]
        self.only = self._side(0) if m <= self.width else None

    def _side(self, q: int) -> np.ndarray:
        a, b = np.searchsorted(self.query, [q, q + self.width])
        side = np.zeros((min(self.width, self.m - q), self.terms))
        np.add.at(side, (self.query[a:b] - q, self.term[a:b]), self.weight[a:b])
        return side

    def add(self, names: np.ndarray, at: np.ndarray, x: np.ndarray, sizes: np.ndarray) -> None:
        """Sparse rows one after the other, each of its own size: the terms' numbers and values."""
        ends = np.cumsum(sizes)
        for q in range(0, self.m, self.width):
            side = self.only if self.only is not None else self._side(q)
            for a in range(0, len(names), self.rows_of):
                n = min(self.rows_of, len(names) - a)
                low, high = (ends[a - 1] if a else 0), ends[a + n - 1]
                rows = np.zeros((n, self.terms))
                rows[np.repeat(np.arange(n), sizes[a : a + n]), at[low:high]] = x[low:high]
                self.best.add(names[a : a + n], side @ rows.T, q, 0.0)

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        return self.best.rows()
