"""Searches among histograms on Arrow batches: the kernels of gated, in-order and greedy matching.

Dot products of counts are whole numbers, so that a matrix product gives them without an error, in any order of its sums.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and columns of a block of a matrix of all pairs.
ROWS, COLUMNS = 256, 2048
#: More than the rounding error of a product of two unit vectors.
SLACK = 1e-12


def numbers(table: pa.Table, column: str, kind: type = np.float64) -> np.ndarray:
    return table[column].to_numpy().astype(kind)


def histograms(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """A matrix of each column of histograms: lists of one length as they are, maps over the keys of all columns; what is missing or null is 0."""
    arrays = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in columns]
    flat = []
    for array in arrays:
        if not pa.types.is_map(array.type):
            array = array.cast(pa.list_(array.type.value_type))
        ends = array.offsets.to_numpy()
        keys, values = (array.keys, array.items) if pa.types.is_map(array.type) else (None, array.values)
        cut = lambda x: x.slice(ends[0], ends[-1] - ends[0])  # noqa: B023, E731
        flat.append((np.diff(ends), keys and cut(keys), pc.fill_null(cut(values).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)))
    names = pa.concat_arrays([k for _, k, _ in flat]).unique() if flat[0][1] is not None else None
    width = len(names) if names is not None else max((int(n.max()) for n, _, _ in flat if len(n)), default=0)
    out = []
    for n, keys, values in flat:
        at = pc.index_in(keys, value_set=names).to_numpy(zero_copy_only=False) if names is not None else np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        dense = np.zeros((len(n), width))
        dense[np.repeat(np.arange(len(n)), n), at] = values
        out.append(dense)
    return out


def norms(h: np.ndarray) -> np.ndarray:
    return np.sqrt((h * h).sum(axis=1))


def cosines(dot: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """dot / norm; 0 for norms of zero."""
    return np.divide(dot, norm, out=np.zeros(np.broadcast(dot, norm).shape), where=norm > 0)


def _window(size: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """For each size the smallest and the largest whole number whose ratio to it is from low to high, by the same division that a row's gate does."""
    first, last = np.floor(low * size) - 1, np.ceil(high * size) + 1
    for _ in range(4):
        first += first / size < low
        last -= last / size > high
    return first, last


def nearest(near_a: np.ndarray, size_a: np.ndarray, h_a: np.ndarray, near_b: np.ndarray, size_b: np.ndarray, order_b: np.ndarray, h_b: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of b, cosine) of the most similar b for each a, the first in order among equals; row -1 where no b is within one in each column of near and from low to high times the size.

    Sizes are positive whole numbers. Of equal b's the first alone is compared. The b's near a cell are sorted by size, so those within the ratio lie side by side; a product of unit vectors finds
    those that can be the best, which are then worked out exactly.
    """
    at, best, first = np.full(len(size_a), -1), np.zeros(len(size_a)), np.full(len(size_a), np.inf)
    by = np.lexsort((order_b, *h_b.T, *near_b.T, size_b))
    same = (size_b[by][1:] == size_b[by][:-1]) & (near_b[by][1:] == near_b[by][:-1]).all(axis=1) & (h_b[by][1:] == h_b[by][:-1]).all(axis=1)
    by = by[np.concatenate(([True], ~same))] if len(by) else by
    near_b, size_b, order_b, h_b = near_b[by], size_b[by], order_b[by].astype(np.float64), h_b[by]
    norm_a, norm_b = norms(h_a), norms(h_b)
    unit_a, unit_b = cosines(h_a, norm_a[:, None]), cosines(h_b, norm_b[:, None])
    least, most = _window(size_a, low, high)
    cells, which = np.unique(near_a, axis=0, return_inverse=True)
    by_cell = np.lexsort((size_a, which.ravel()))
    ends = np.searchsorted(which.ravel()[by_cell], np.arange(len(cells) + 1))
    for cell, start, end in zip(cells, ends[:-1], ends[1:]):
        cols = np.flatnonzero((np.abs(near_b - cell) <= 1).all(axis=1))
        if not len(cols):
            continue
        turned = np.ascontiguousarray(unit_b[cols].T)
        for s in range(start, end, ROWS):
            rows = by_cell[s : min(s + ROWS, end)]
            lo, hi = np.searchsorted(size_b[cols], least[rows], "left"), np.searchsorted(size_b[cols], most[rows], "right")
            top = np.full(len(rows), -np.inf)
            for c in range(lo.min(), hi.max(), COLUMNS):
                d = min(c + COLUMNS, hi.max())
                score = unit_a[rows] @ turned[:, c:d]
                if c < lo.max() or d > hi.min():
                    place = np.arange(c, d)
                    score[(place < lo[:, None]) | (place >= hi[:, None])] = -np.inf
                top = np.maximum(top, score.max(axis=1))
                r, x = np.nonzero((score >= (top - SLACK)[:, None]) & (top > -np.inf)[:, None])
                if not len(r):
                    continue
                a, b = rows[r], cols[x + c]
                exact = cosines((h_a[a] * h_b[b]).sum(axis=1), norm_a[a] * norm_b[b])
                rank = np.lexsort((order_b[b], -exact, a))
                rank = rank[np.concatenate(([True], a[rank][1:] != a[rank][:-1]))]
                a, b, exact = a[rank], b[rank], exact[rank]
                better = (at[a] < 0) | (exact > best[a]) | ((exact == best[a]) & (order_b[b] < first[a]))
                a, b = a[better], b[better]
                at[a], best[a], first[a] = by[b], exact[better], order_b[b]
    return at, best


def in_order(h_a: np.ndarray, h_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, cosine): each a in turn takes the most similar b that is free, the first among equals, if that reaches least."""
    norm_a, norm_b, free, found = norms(h_a), norms(h_b), np.arange(len(h_b)), []
    for s in range(0, len(h_a), ROWS // 4):
        if not len(free):
            break
        rows = np.arange(s, min(s + ROWS // 4, len(h_a)))
        score = cosines(h_a[rows] @ h_b[free].T, norm_a[rows][:, None] * norm_b[free])
        taken = []
        for r, row in zip(score, rows):
            x = int(r.argmax())
            if r[x] >= least and r[x] > -np.inf:
                found.append((row, free[x], r[x]))
                score[:, x] = -np.inf
                taken.append(x)
        free = np.delete(free, taken)
    a, b, cosine = zip(*found) if found else ((), (), ())
    return np.array(a, dtype=int), np.array(b, dtype=int), np.array(cosine, dtype=float)


#: Candidates that a row keeps of a class; it works out more when these are taken.
_KEPT = 16


def greedy(h_a: np.ndarray, x_a: np.ndarray, h_b: np.ndarray, x_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance): one-to-one matches in ascending (distance, row of a, row of b); x holds two numbers a row.

    Distances are 0.6 (1 - cosine) + 0.2 d + 0.2 e, to nine digits, d and e being the relative differences of the two numbers. Rows of equal numbers are a class: what two classes differ by is
    the least that their rows can, so a row works out its distances to a class only when nothing nearer is left anywhere. A heap holds each row's nearest free candidate of every class that it
    has looked at, and the bound of the next one. Memory grows with the rows, not with their pairs.
    """
    norm_a, norm_b = norms(h_a), norms(h_b)
    kinds_a, at_a = np.unique(x_a, axis=0, return_inverse=True)
    kinds_b, at_b = np.unique(x_b, axis=0, return_inverse=True)
    at_a, at_b = at_a.ravel(), at_b.ravel()
    d, e = (cosines(np.abs(u[:, None] - v), np.abs(u)[:, None] + np.abs(v)) for u, v in zip(kinds_a.T, kinds_b.T))
    bound = np.floor((0.2 * d + 0.2 * e) * 1e9).astype(np.int64) - 2
    turn = np.argsort(bound, axis=1, kind="stable")
    bounds, turns = np.take_along_axis(bound, turn, axis=1).tolist(), turn.tolist()
    members = [np.flatnonzero(at_b == c) for c in range(len(kinds_b))]
    free_a, free_b = np.ones(len(h_a), dtype=bool), np.ones(len(h_b), dtype=bool)
    heap, lists = [], {}

    def ranks(rows: np.ndarray, kind: int, c: int) -> np.ndarray:
        """Distances, in units of 1e-9, of rows to the free members of a class, each with its place in the low 31 bits."""
        cols = members[c]
        cosine = cosines(h_a[rows] @ h_b[cols].T, norm_a[rows][:, None] * norm_b[cols])
        distance = 0.6 * (1 - cosine) + 0.2 * d[kind, c] + 0.2 * e[kind, c]
        return (np.floor(distance * 1e9 + 0.5).astype(np.int64) << 31) | cols

    def push(i: int, c: int) -> None:
        """The next free candidate of a row's list."""
        found = lists[i, c]
        while found[0]:
            rank = found[0].pop()
            if free_b[rank & 0x7FFFFFFF]:
                heapq.heappush(heap, (rank >> 31, i, rank & 0x7FFFFFFF, c))
                return
        if found[1]:
            look(np.array([i]), at_a[i], c)

    def look(rows: np.ndarray, kind: int, c: int) -> None:
        members[c] = members[c][free_b[members[c]]]
        if not len(members[c]):
            return
        more = len(members[c]) > _KEPT
        rank = ranks(rows, kind, c)
        if more:
            rank = np.partition(rank, _KEPT - 1, axis=1)[:, :_KEPT]
        for i, found in zip(rows.tolist(), np.sort(rank, axis=1)[:, ::-1].tolist()):
            lists[i, c] = (found, more)
            push(i, c)

    for kind in range(len(kinds_a)):
        rows = np.flatnonzero(at_a == kind)
        for s in range(0, len(rows), ROWS):
            look(rows[s : s + ROWS], kind, turns[kind][0])
        if len(kinds_b) > 1:
            for i in rows.tolist():
                heapq.heappush(heap, (bounds[kind][1], i, -1, 1))
    out, most = [], min(len(h_a), len(h_b))
    while heap and len(out) < most:
        rank, i, j, c = heapq.heappop(heap)
        if not free_a[i]:
            continue
        if j < 0:
            kind = at_a[i]
            if c + 1 < len(kinds_b):
                heapq.heappush(heap, (bounds[kind][c + 1], i, -1, c + 1))
            look(np.array([i]), kind, turns[kind][c])
        elif free_b[j]:
            free_a[i] = free_b[j] = False
            out.append((i, j, rank))
        else:
            push(i, c)
    found = np.array(out, dtype=np.int64).reshape(-1, 3)
    i, j, rank = found.T
    above = cosines((h_a[i] * h_b[j]).sum(axis=1), norm_a[i] * norm_b[j]) > 1
    near = above & (rank == 0)  # a cosine that was rounded above 1 leaves a negative zero, in SQL too
    return i, j, np.where(near, -0.0, rank / 1e9)
