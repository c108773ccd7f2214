"""A tile of the matrix of a long pattern and a long text: its sides, its best cells and walks through it.

Two neighbouring cells differ by at least -gap and at most match + gap, so a
tile is filled by differences, a byte each, a diagonal at a time. Differences
alone don't tell where a score would fall below 0 and an alignment begin anew:
every CHECK diagonals the scores themselves are made from them, and where a
cell could come that low, or where a side of the tile is, that part is filled by its
scores (edges_of) and the rest by differences again. Where cells are looked for
or walked through, the differences along every BLOCK-th row and column are kept,
and only blocks that are needed are filled anew.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import as_strided

from .kernels import _first_k, code_points, edges_of, striped_best, stripes, trace_back
from .scoring import Scoring

#: Diagonals between two looks at the scores, the side of a block, and bytes of symbols that are compared at once.
CHECK, BLOCK, ROOM = 256, 1024, 1 << 21


def _differ(side: np.ndarray, corner: int, gap: int, kind: type) -> np.ndarray:
    """The differences along a row or column after its corner, gap added."""
    return (np.diff(side, prepend=np.int32(corner)) + gap).astype(kind)


def _summed(differences: np.ndarray, corner: int, gap: int) -> np.ndarray:
    """The scores again."""
    return np.cumsum(differences, dtype=np.int32) - gap * np.arange(1, len(differences) + 1, dtype=np.int32) + np.int32(corner)


def _top(scores: np.ndarray, k: int) -> list[int]:
    some = np.sort(np.partition(scores, len(scores) - k)[len(scores) - k :] if len(scores) > k else scores)[::-1]
    return some[some > 0].tolist()


class Tile:
    """The cells of a pattern and a text after the column before them, with its corner, and the row above.

    bottom and right are its last row and column, peaks the scores of up to k different cells, and
    no cell has more than `high`. With keep, cells can be looked for (best) and walked through (walk).
    """

    def __init__(self, pattern: str, text: str, left: np.ndarray, above: np.ndarray, scoring: Scoring, k: int, keep: bool = False) -> None:
        self.pattern, self.text, self.left, self.above, self.scoring, self.k = pattern, text, left.astype(np.int32), above.astype(np.int32), scoring, k
        self.points = code_points(pattern), code_points(text)
        self.by_differences = scoring.matrix is None and scoring.match + 2 * scoring.gap < 256
        self.floor = scoring.gap * CHECK
        p, t = self.points
        if max(int(p.max()), int(t.max())) < 256:
            self.codes = p.astype(np.uint8), t.astype(np.uint8)
        else:
            known, codes = np.unique(np.concatenate((p, t)), return_inverse=True)
            codes = codes.astype(np.uint8 if len(known) <= 256 else np.uint32)
            self.codes = codes[: len(p)], codes[len(p) :]
        kind = np.uint8 if self.by_differences else np.int32
        self.kept = (np.zeros((len(p) // BLOCK, len(t)), kind), np.zeros((len(t) // BLOCK, len(p)), kind)) if keep else None
        self.bottom, self.right, self.peaks, self.high = self._solved(0, 0, self.left, self.above, BLOCK)

    def _solved(self, x: int, y: int, left: np.ndarray, above: np.ndarray, peel: int) -> tuple[np.ndarray, np.ndarray, list[int], int]:
        """(last row, last column, peaks, high) of the part that begins at row x and column y: by differences, or cut where they don't serve."""
        m, n = len(left) - 1, len(above)
        if self.by_differences and min(m, n) > BLOCK:
            found = self._filled(x, y, left, above)
            if found is not None:
                return found
        if m <= BLOCK and n <= BLOCK or self.kept is None and (min(m, n) <= BLOCK or not self.by_differences):
            return self._exact(x, y, left, above)
        low = not self.by_differences or min(int(left.min()), int(above.min())) < self.floor
        if not low:
            a, b = (-(-m // (2 * BLOCK)) * BLOCK, 0) if m >= n else (0, -(-n // (2 * BLOCK)) * BLOCK)
        else:
            peel = peel if self.kept is None else BLOCK
            # a side is low where it is beyond the corner, which the other side's strip takes away
            high = [not (s[peel:] < self.floor).any() for s in (above, left[1:])]
            a, b = (peel if high[0] <= high[1] else 0), (peel if high[1] <= high[0] else 0)
            if self.kept is not None:
                a, b = a if n > peel else peel, b if m > peel else peel
        rows, columns = ([(0, c), (c, size)] if 0 < c < size else [(0, size)] for c, size in ((a, m), (b, n)))
        rights, peaks, high = [], [], 0
        for i0, i1 in rows:
            before, row = left[i0 : i1 + 1], []
            for j0, j1 in columns:
                if low and self.kept is None and ((i1, j1) != (m, n) or i0 == j0 == 0):
                    bottom, right, some, most = self._exact(x + i0, y + j0, before, above[j0:j1])
                else:
                    bottom, right, some, most = self._solved(x + i0, y + j0, before, above[j0:j1], 2 * peel if low else peel)
                before = np.append(above[j1 - 1 : j1], right)
                row.append(bottom)
                peaks += some
                high = max(high, most)
            rights.append(right)
            above = np.concatenate(row)
        return above, np.concatenate(rights), sorted(peaks, reverse=True)[: self.k], high

    def _exact(self, x: int, y: int, left: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], int]:
        """The same by scores; a block's last row and column are kept."""
        m, n, gap = len(left) - 1, len(above), self.scoring.gap
        bottom, right, peaks = edges_of(self.points[0][x : x + m], self.points[1][y : y + n], left, above, self.scoring, self.k)
        if self.kept is not None:
            rows, columns = self.kept
            if m == BLOCK:
                rows[x // BLOCK, y : y + n] = _differ(bottom, left[-1], gap, rows.dtype)
            if n == BLOCK:
                columns[y // BLOCK, x : x + m] = _differ(right, above[-1], gap, rows.dtype)
        return bottom, right, peaks, max(peaks, default=0)

    def _filled(self, x: int, y: int, left: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], int] | None:
        """The same by differences; None where a cell could be 0.

        With u the difference of the cell to the left from the one above that, and w that of the cell above
        from the one to its left, gap added to both, the cell is z = max(match or mismatch + 2 gap, u, w) - 2 gap
        more than the one before it on the diagonal; z - w and z - u are what it hands on.
        A cell is at most gap less than the one to its left or above it, so none is more than
        CHECK * gap below all scores that were looked at, or above them.
        """
        scoring, gap, m, n = self.scoring, self.scoring.gap, len(left) - 1, len(above)
        if min(int(left.min()), int(above.min())) < self.floor:
            return None
        p, t = self.codes[0][x : x + m], self.codes[1][y : y + n]
        tops, sides = _differ(above, left[0], gap, np.uint8).tolist(), _differ(left[1:], left[0], gap, np.uint8).tolist()
        other = np.uint8(max(0, scoring.mismatch + 2 * gap))
        equal = np.uint8(scoring.match + 2 * gap - int(other))
        some = max(1, min(CHECK // 4, ROOM // m))
        back = np.zeros(n + 2 * some + m, t.dtype)
        back[some : some + n] = t[::-1]
        sheet, z = np.empty(some * m, np.uint8), np.empty(m, np.uint8)
        held = [np.zeros((2, m + 1), np.uint8) for _ in range(2)]  # u by row, and w a row on
        bottom, right = np.empty(n, np.uint8), np.empty(m, np.uint8)
        last = m + n - 1
        if self.kept is not None:
            along, down = np.empty((last, m // BLOCK), np.uint8), np.empty((last, -(-m // BLOCK)), np.uint8)
        looked, highs = 0, []
        maximum, subtract = np.maximum, np.subtract
        for d in range(0, last, some):
            e = min(d + some, last)
            lo, hi = max(0, d - n + 1), min(m, e)
            size = hi - lo
            met = sheet[: (e - d) * size].reshape(e - d, size)
            texts = as_strided(back[some + n - 1 - d + lo :], (e - d, size), (-back.itemsize, back.itemsize))
            np.equal(p[lo:hi], texts, out=met.view(bool))
            met *= equal
            met += other
            cells = z[:size]
            views = [(h[0, lo:hi], h[1, lo:hi], h[::-1, lo:hi], as_strided(h[0, lo:], (2, size), (m + 2, 1)), h[0], h[1]) for h in held]
            old, new = views if d % 2 == 0 else views[::-1]
            for at, row in zip(range(d, e), met, strict=True):
                if at < n:
                    old[5][0] = tops[at]
                if at < m:
                    old[4][at] = sides[at]
                maximum(old[0], old[1], cells)
                maximum(cells, row, cells)
                subtract(cells, old[2], new[3])
                if at >= m - 1:
                    bottom[at - m + 1] = new[5][m]
                if at >= n - 1:
                    right[at - n + 1] = new[4][at - n + 1]
                if self.kept is not None:
                    along[at] = new[5][BLOCK::BLOCK]
                    some_u = new[4][(at + 1) % BLOCK : m : BLOCK]
                    down[at, : len(some_u)] = some_u
                old, new = new, old
            if e - looked + some > CHECK:
                looked = e
                lo, hi = max(0, e - n), min(m, e)
                begun = int(above[e - 1]) + int(old[4][0]) - gap if e <= n else int(above[-1]) + int(right[: lo + 1].sum(dtype=np.int64)) - gap * (lo + 1)
                steps = np.cumsum(old[4][lo + 1 : hi].astype(np.int16) - old[5][lo + 1 : hi], dtype=np.int32)
                least, most = (begun + min(0, int(steps.min())), begun + max(0, int(steps.max()))) if len(steps) else (begun, begun)
                if least < self.floor:
                    return None
                highs.append(most)
        if self.kept is not None:
            rows, columns = self.kept
            for q in range(m // BLOCK):
                first = (q + 1) * BLOCK - 1
                rows[x // BLOCK + q, y : y + n] = along[first : first + n, q]
            line = np.arange(m)
            for q in range(n // BLOCK):
                columns[y // BLOCK + q, x : x + m] = down[line + (q + 1) * BLOCK - 1, line // BLOCK]
        bottom, right = _summed(bottom, left[-1], gap), _summed(right, above[-1], gap)
        ends = np.append(bottom, right[:-1])
        peaks = max(_top(ends, self.k), sorted(highs, reverse=True)[: self.k], key=lambda some: (len(some), some[-1:]))
        return bottom, right, peaks, max(int(ends.max()), *highs, 0) + self.floor

    def _last(self, side: int, q: int) -> np.ndarray:
        """The scores of the last row (side 0) or column (1) of blocks; those before the first one are the tile's own sides."""
        ends = self.above if side == 0 else self.left[1:]
        if q < 0:
            return ends
        if q >= len(self.kept[side]):
            return self.bottom if side == 0 else self.right
        at = (q + 1) * BLOCK - 1
        return _summed(self.kept[side][q], self.left[at + 1] if side == 0 else self.above[at], self.scoring.gap)

    def _block(self, i: int, j: int) -> tuple[slice, slice, np.ndarray, np.ndarray]:
        """(rows, columns, column before them with its corner, row above) of a block."""
        rows, columns = (slice(c * BLOCK, min((c + 1) * BLOCK, len(s))) for c, s in ((i, self.pattern), (j, self.text)))
        above, left = self._last(0, i - 1), self._last(1, j - 1)
        corner = above[columns.start - 1] if j else self.left[rows.start]
        return rows, columns, np.append(np.int32(corner), left[rows]), above[columns]

    def best(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, columns, scores) of the k best cells from `least` on."""
        gap, sizes = self.scoring.gap, [np.diff(np.append(np.arange(0, len(s), BLOCK), len(s))) for s in self.points]
        most = [np.array([np.maximum.reduceat(self._last(side, q), np.arange(0, len(s), BLOCK)) for q in range(len(other))]) for side, s, other in ((0, self.points[1], sizes[0]), (1, self.points[0], sizes[1]))]
        bound = np.minimum(most[0] + gap * (sizes[0][:, None] - 1), most[1].T + gap * (sizes[1][None, :] - 1))
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        for n in np.argsort(-bound, axis=None, kind="stable").tolist():
            i, j = divmod(n, bound.shape[1])
            if bound[i, j] < least:
                break
            rows, columns, left, above = self._block(i, j)
            parts = stripes(self.points[0][rows], self.points[1][columns], np.zeros(1, np.int64), self.scoring, left, above)
            x, y, v = striped_best(parts, np.zeros(columns.stop - columns.start, np.int64), self.k, least=least)
            found = [np.concatenate(c) for c in zip(found, (x + rows.start, y + columns.start, v), strict=True)]
            found = list(_first_k(*found, np.zeros(len(found[0]), np.int64), self.k, False))
            if len(found[2]) == self.k:
                least = max(least, int(found[2][-1]))
        return tuple(found)

    def walk(self, x: int, y: int, known: dict[tuple[int, int], tuple]) -> tuple[int, int, str, str]:
        """What trace_back tells of a tile, from block to block; known: the walks through blocks so far, by their cell."""
        p, s = [], []
        while True:
            if (x, y) not in known:
                rows, columns, left, above = self._block(x // BLOCK, y // BLOCK)
                i, j, ap, as_ = trace_back(self.pattern[rows], self.text[columns], x - rows.start, y - columns.start, self.scoring, left=left, above=above)
                known[x, y] = rows.start + i - 1, columns.start + j - 1, ap, as_, i == 0 or j == 0
            x, y, ap, as_, going = known[x, y]
            p.append(ap)
            s.append(as_)
            if not going or x < 0 or y < 0:
                return x + 1, y + 1, "".join(reversed(p)), "".join(reversed(s))
