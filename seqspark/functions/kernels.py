"""Array kernels: fill the score matrix of one pattern against many texts at once, pick cells, walk back.

Texts lie end to end in one array of code points. Within a row of the matrix the
gap from the left is a running maximum, since a gap costs the same per
character; a step of the baseline at each text's start keeps it from running
on into the next text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .scoring import Pairs, Scoring

#: Cells of a matrix that are held at once, about, and rows that a walk back keeps at each depth.
STRIPE_CELLS, KEPT_ROWS = 1 << 20, 16
#: Lengths of runs of symbols that are counted, each twice the one before, and bits of their hashes.
GRAMS, GRAM_BITS = (2, 4, 8), 16


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def fill(pattern: np.ndarray, text: np.ndarray, starts: np.ndarray, scoring: Scoring, left: np.ndarray | None = None, above: np.ndarray | None = None, pairs: Pairs | None = None) -> np.ndarray:
    """Scores, a row for each pattern character; starts: where each text begins.

    left: the column before a single text, with its corner. above: the row before
    the first, where the pattern is a stripe of a longer one; pairs: what scoring.pairs(text) gives, where it is known.
    """
    n, m = len(text), len(pattern)
    out = np.empty((m, n), np.int32)
    pairs = scoring.pairs(text) if pairs is None else pairs
    first = np.zeros(n, bool)
    first[starts] = True
    above = np.zeros(n, np.int32) if above is None else above
    most = scoring.most * m + (int(above.max()) if n else 0) + (0 if left is None else int(left.max()))
    step = most + scoring.gap + 1
    wide = n * scoring.gap + (len(starts) + 1) * step >= 1 << 30
    base = np.arange(n, dtype=np.int64) * scoring.gap + np.cumsum(first) * step
    base = base if wide else base.astype(np.int32)
    diag, t, run = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n, base.dtype)
    gap = np.int32(scoring.gap)
    for i, code in enumerate(pattern.tolist()):
        diag[1:] = above[:-1]
        diag[starts] = 0 if left is None else left[i]
        np.subtract(above, gap, out=t)
        np.maximum(t, 0, out=t)
        diag += pairs[code]
        np.maximum(t, diag, out=t)
        if left is not None and n:
            t[0] = max(t[0], left[i + 1] - scoring.gap)
        np.add(t, base, out=run)
        np.maximum.accumulate(run, out=run)
        run -= base
        out[i] = run
        above = out[i]
    return out


def stripes(pattern: np.ndarray, text: np.ndarray, starts: np.ndarray, scoring: Scoring, left: np.ndarray | None = None, above: np.ndarray | None = None, cells: int = STRIPE_CELLS, pairs: Pairs | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, its scores) of stripes of at most about `cells` cells, each filled from the last row of the one before; memory doesn't grow with the pattern.

    A stripe may be written to once it is told.
    """
    rows = max(1, cells // max(len(text), 1))
    pairs = scoring.pairs(text) if pairs is None else pairs
    for at in range(0, len(pattern), rows):
        h = fill(pattern[at : at + rows], text, starts, scoring, None if left is None else left[at:], above, pairs)
        above = h[-1].copy()
        yield at, h


def _edges(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each run of equal values begins, its length)."""
    edge = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(segment) else np.zeros(0, np.int64)
    return edge, np.diff(np.append(edge, len(segment)))


def best_cells(h: np.ndarray, segment: np.ndarray, k: int, ties: bool = False, least: int | np.ndarray = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, scores) of the k best positive cells of each segment by score, then column, then row; with ties also all equal to the k-th.

    Segments lie one after the other. Only columns that reach the k-th best
    column of their segment are looked at, and cells from `least` on (for all, or for each column).
    """
    top = h.max(axis=0)
    if not (top >= least).any():
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, h.dtype)
    edge, size = _edges(segment)
    if k == 1 and len(edge):
        bound = np.maximum.reduceat(top, edge)
    else:
        bound = np.array([np.partition(top[a : a + n], n - k)[n - k] if n > k else 1 for a, n in zip(edge.tolist(), size.tolist(), strict=True)], np.int64)
    least = np.maximum(np.maximum(np.repeat(bound, size), 1), least)
    columns = np.flatnonzero(top >= least)
    x, y = np.nonzero(h[:, columns] >= least[columns])
    y = columns[y]
    return _first_k(x, y, h[x, y], segment[y], k, ties)


def _first_k(x: np.ndarray, y: np.ndarray, score: np.ndarray, segment: np.ndarray, k: int, ties: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.lexsort((x, y, -score, segment))
    x, y, score, segment = x[by], y[by], score[by], segment[by]
    edge, size = _edges(segment)
    keep = np.arange(len(y)) - np.repeat(edge, size) < k
    if ties and len(y):
        keep |= score == np.repeat(score[np.minimum(edge + k, edge + size) - 1], size)
    return x[keep], y[keep], score[keep]


def striped_best(parts: Iterator[tuple[int, np.ndarray]], segment: np.ndarray, k: int, ties: bool = False, least: int = 1, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_cells of a matrix that comes in stripes; skip: columns that don't count. Later stripes are searched from the k-th best so far on."""
    held: tuple[np.ndarray, ...] | None = None
    floor: int | np.ndarray = least
    for at, h in parts:
        if skip is not None:
            h[:, skip] = 0
        x, y, score = best_cells(h, segment, k, ties, floor)
        if not len(x):
            continue
        new = (x + at, y, score)
        if held is not None:
            x, y, score = (np.concatenate(c) for c in zip(held, new, strict=True))
            new = _first_k(x, y, score, segment[y], k, ties)
        held = new
        edge, size = _edges(segment[held[1]])
        kth = np.where(size >= k, held[2][np.minimum(edge + k, edge + size) - 1], least)
        reached = np.full(int(segment[-1]) + 1, least, np.int64)
        reached[segment[held[1][edge]]] = np.maximum(kth, least)
        floor = reached[segment]
    if held is None:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.int32)
    return held


class Grams:
    """Hashes of the runs of 2, 4 and 8 symbols that end at each place of a text, made when they are asked for."""

    def __init__(self, text: np.ndarray) -> None:
        self.text = text
        self._sums: dict[int, np.ndarray] = {1: text.astype(np.uint32)}
        self._slots: dict[int, np.ndarray] = {}

    def _sum(self, q: int) -> np.ndarray:
        if q not in self._sums:
            half = self._sum(q // 2)
            ends = half * np.uint32(0x9E3779B1)
            ends ^= ends >> np.uint32(15)
            ends[q // 2 :] += half[: -(q // 2)]
            self._sums[q] = ends
        return self._sums[q]

    def hashes(self, q: int) -> np.ndarray:
        """A hash of 32 bits of each run of q symbols, by the place where it begins."""
        return self._sum(q)[q - 1 :]

    def slots(self, q: int) -> np.ndarray:
        """A hash of GRAM_BITS bits for each place; those of the first q - 1 places are of shorter runs."""
        if q not in self._slots:
            self._slots[q] = ((self._sum(q) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - GRAM_BITS)).astype(np.uint16)
        return self._slots[q]


class Seeds:
    """The places of a long pattern's runs of symbols: finds the best cells of short texts without filling all of its rows.

    What Bound says of a pattern's runs holds for a text's, as both sides of an
    alignment score alike: one of score s holds at least n of the text's runs of q
    symbols. So it holds one of any that leave out fewer than n; the rarest are
    taken, and rows as far from their places in the pattern as an alignment spans.
    """

    #: Places of the rarest run that tell a score to begin with.
    FIRST = 8

    def __init__(self, pattern: np.ndarray, scoring: Scoring) -> None:
        self.pattern, self.scoring = pattern, scoring
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def serve(pattern: np.ndarray, scoring: Scoring) -> bool:
        return len(pattern) >= 1 << 14 and scoring.matrix is None and scoring.mismatch < 0

    def _places(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the runs of q symbols, ascending, where each begins)."""
        if q not in self.known:
            hashes = Grams(self.pattern).hashes(q)
            order = np.argsort(hashes, kind="stable").astype(np.int32)
            self.known[q] = (hashes[order], order)
        return self.known[q]

    def _needed(self, least: int, n: int, q: int) -> int:
        """How many of a text's runs of q symbols an alignment of score `least` or more holds at least."""
        s = self.scoring
        a = np.arange(-(-least // s.match), n + 1)
        return int((a - (q - 1) * (1 + (s.match * a - least) // min(s.gap, -s.mismatch))).min())

    def _near(self, text: np.ndarray, places: np.ndarray, q: int, k: int, skip: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The k best cells from `least` on in the rows around some places; None where there are too many."""
        reach, places = self.scoring.reach(len(text)), np.sort(places).astype(np.int64)
        lo, hi = np.maximum(places - reach, 0), np.minimum(places + q + reach, len(self.pattern))
        opens = np.append(True, lo[1:] > hi[:-1])
        lo, hi = lo[opens], hi[np.append(opens[1:], True)]
        size = hi - lo
        begins = size.cumsum() - size
        if int(size.sum()) * len(text) > 4 * STRIPE_CELLS:
            return None
        rows = np.arange(size.sum()) + np.repeat(lo - begins, size)
        h = fill(text, self.pattern[rows], begins, self.scoring)
        h[:skip] = 0
        x, y, v = best_cells(h.T, np.zeros(len(text), np.int64), k, False, least)
        return rows[x], y, v

    def best(self, text: np.ndarray, k: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(rows, columns, scores) of the k best cells of a text, columns from skip on; None where runs tell too little, and all rows must be filled."""
        n, grams, least, begun = len(text), Grams(text), 0, None
        for q in sorted(GRAMS, reverse=True):
            if n < q:
                continue
            hashes, order = self._places(q)
            met = grams.hashes(q)
            lo, hi = np.searchsorted(hashes, met, "left"), np.searchsorted(hashes, met, "right")
            often = hi - lo
            sure = []
            if begun is None and often.any():
                rarest = int(np.argmin(np.where(often, often, len(self.pattern) + 1)))
                sure = [rarest] if often[rarest] <= self.FIRST else []
                begun = self._near(text, order[lo[rarest] : hi[rarest]][: self.FIRST], q, k, skip, 1)
                if begun is None or len(begun[0]) < k:
                    return None
                least = int(begun[2][-1])
            need = self._needed(least, n, q) if begun is not None else 0
            if need < 1:
                continue
            some = np.argsort(often, kind="stable")[: len(met) - need + 1]
            if 4 * int(often[some].sum()) * self.scoring.reach(n) > len(self.pattern):
                continue
            if some.tolist() == sure:
                return begun
            return self._near(text, np.concatenate([order[lo[g] : hi[g]] for g in some.tolist()]), q, k, skip, least)
        return None


class Bound:
    """Tells which columns of a text can hold a cell of a least score of one pattern; never lets one go that does.

    An alignment of score s matches a symbols in r runs, and each break between
    two runs costs at least c, the cheaper of a gap and a mismatch: s is at most
    match * a - c * (r - 1). At least a - (q - 1) * r of the runs of q symbols
    in its stretch are therefore runs of the pattern, and the stretch is at most
    (match * m - s) / gap longer than the pattern. Scores of a matrix aren't bounded.
    """

    def __init__(self, pattern: np.ndarray, scoring: Scoring) -> None:
        self.m, self.scoring = len(pattern), scoring
        self.cheapest = 0 if scoring.matrix is not None else min(scoring.gap, -scoring.mismatch)
        self.tables: dict[int, np.ndarray] = {}
        if self.cheapest:
            grams = Grams(pattern)
            for q in GRAMS:
                if self.m >= q:
                    self.tables[q] = np.zeros(1 << GRAM_BITS, np.int8)
                    self.tables[q][grams.slots(q)[q - 1 :]] = 1
        self._known: tuple[int, dict[int, int]] = (0, {})

    def needed(self, least: int) -> dict[int, int]:
        """How many runs of q symbols of the pattern an alignment of score `least` or more holds at least, where that is any."""
        if self._known[0] != least:
            s = self.scoring
            a = np.arange(-(-least // s.match), self.m + 1)
            found = {}
            for q in self.tables:
                n = int((a - (q - 1) * (1 + (s.match * a - least) // self.cheapest)).min()) if len(a) else self.m
                if n > 0:
                    found[q] = n
            self._known = (least, found)
        return self._known[1]

    def columns(self, grams: Grams, least: int) -> np.ndarray | None:
        """Whether each column can hold a cell of score `least` or more; None where nothing is known of any."""
        needed = self.needed(least)
        if not needed:
            return None
        span = self.m + max(0, self.scoring.match * self.m - least) // self.scoring.gap
        live = None
        for q, n in sorted(needed.items(), reverse=True):
            met = np.cumsum(self.tables[q][grams.slots(q)], dtype=np.int32)
            met[span:] -= met[:-span].copy()
            live = met >= n if live is None else live & (met >= n)
        return live


def with_reach(columns: np.ndarray, begins: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, where each piece of them begins): ascending columns, with as many before each as an alignment spans inside its text, which begins at begins."""
    lo = np.maximum(columns - reach + 1, begins)
    opens = np.append(True, lo[1:] > columns[:-1])
    lo, hi = lo[opens], columns[np.append(opens[1:], True)]
    size = hi - lo + 1
    at = size.cumsum() - size
    return np.arange(size.sum()) + np.repeat(lo - at, size), at


def bounded_best(pattern: np.ndarray, bound: Bound, grams: Grams, first: np.ndarray, segment: np.ndarray, k: int, scoring: Scoring, least: int, skip: np.ndarray | None, pairs: Pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """What striped_best finds from `least` on in texts that begin at first, and how many columns were filled for it: few where the bound leaves few."""
    text = grams.text
    live = bound.columns(grams, least)
    if live is not None:
        if skip is not None:
            live &= ~skip
        columns = np.flatnonzero(live)
        if not len(columns):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.int32), 0
        if 4 * len(columns) < len(text):
            some, begins = with_reach(columns, first[segment[columns]], scoring.reach(len(pattern)))
            if 2 * len(some) < len(text):
                x, y, score = striped_best(stripes(pattern, text[some], begins, scoring), segment[some], k, False, least, None if skip is None else skip[some])
                return x, some[y], score, len(some)
    return *striped_best(stripes(pattern, text, first, scoring, pairs=pairs), segment, k, False, least, skip), len(text)


def walk(h: np.ndarray, pattern: str, text: str, x: int, y: int, scoring: Scoring, origin: int = 0) -> tuple[int, int, str, str]:
    """(first row, first column, aligned pattern, aligned text) of the alignment that ends in a cell of a text beginning at column origin."""
    p, s = [], []
    left_first = scoring.tie_order == "diag_left_up"
    while x >= 0 and y >= origin and h[x, y] > 0:
        v = int(h[x, y])
        corner = int(h[x - 1, y - 1]) if x and y > origin else 0
        a, b = pattern[x], text[y - origin]
        if v == corner + scoring.pair(a, b):
            p.append(a)
            s.append(b)
            x, y = x - 1, y - 1
            continue
        from_left = y > origin and v == int(h[x, y - 1]) - scoring.gap
        from_up = x > 0 and v == int(h[x - 1, y]) - scoring.gap
        if from_left and (left_first or not from_up):
            p.append("-")
            s.append(b)
            y -= 1
        else:
            p.append(a)
            s.append("-")
            x -= 1
    return x + 1, y - origin + 1, "".join(reversed(p)), "".join(reversed(s))


def walk_many(h: np.ndarray, pattern: np.ndarray, text: np.ndarray, origin: np.ndarray, x: np.ndarray, y: np.ndarray, scoring: Scoring) -> tuple[list[int], list[int], list[str], list[str]]:
    """walk() of many cells of one matrix side by side, a step of all at a time, for scoring by equality; origin: where each cell's text begins."""
    out: tuple[list, ...] = ([], [], [], [])
    some = max(1, STRIPE_CELLS // (2 * scoring.reach(len(pattern))))
    for a in range(0, len(x), some):
        for column, values in zip(out, _walk_some(h, pattern, text, origin[a : a + some], x[a : a + some], y[a : a + some], scoring), strict=True):
            column += values
    return out


def _walk_some(h: np.ndarray, pattern: np.ndarray, text: np.ndarray, origin: np.ndarray, x: np.ndarray, y: np.ndarray, scoring: Scoring) -> tuple[list[int], list[int], list[str], list[str]]:
    x, y, gap, dash = x.astype(np.int64), y.astype(np.int64), scoring.gap, np.uint32(ord("-"))
    left_first = scoring.tie_order == "diag_left_up"
    going, steps = np.arange(len(x)), []
    while True:
        going = going[(x[going] >= 0) & (y[going] >= origin[going])]
        i, j = x[going], y[going]
        v = h[i, j]
        if not (v > 0).all():
            going, i, j, v = (c[v > 0] for c in (going, i, j, v))
        if not len(going):
            break
        inside, below = j > origin[going], i > 0
        a, b = pattern[i], text[j]
        diag = v == np.where(inside & below, h[i - 1, j - 1], 0) + np.where(a == b, scoring.match, scoring.mismatch)
        left = ~diag & inside & (v == h[i, j - 1] - gap)
        if not left_first:
            left &= ~(below & (v == h[i - 1, j] - gap))
        steps.append((going, np.where(left, dash, a), np.where(diag | left, b, dash)))
        x[going] -= ~left
        y[going] -= diag | left
    held = np.zeros((2, len(x), len(steps)), np.uint32)
    size = np.zeros(len(x), np.int64)
    for n, (at, a, b) in enumerate(steps, 1):
        held[0, at, -n], held[1, at, -n] = a, b
        size[at] = n
    strings = [[row[len(steps) - n :].tobytes().decode("utf-32-le") for row, n in zip(side, size.tolist(), strict=True)] for side in held]
    return (x + 1).tolist(), (y - origin + 1).tolist(), *strings


def edges_of(pattern: np.ndarray, text: np.ndarray, left: np.ndarray, above: np.ndarray, scoring: Scoring, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(last row, last column, scores of up to k different cells, one of them the best) of a tile, from the column before it, with its corner, and the row above it.

    By equality it is filled a diagonal at a time, where no cell waits for its neighbour; a cell
    on the diagonal d is held with gap * d added, so that gaps cost nothing.
    """
    m, n, gap = len(pattern), len(text), scoring.gap
    if scoring.matrix is not None or m < 2 or n < 2:
        right, peaks = [], []
        for _, h in stripes(pattern, text, np.zeros(1, np.int64), scoring, left, above):
            right.append(h[:, -1].copy())
            peaks += h.max(axis=1).tolist()
        return h[-1].copy(), np.concatenate(right), [v for v in sorted(peaks, reverse=True)[:k] if v > 0]
    if max(int(pattern.max()), int(text.max())) < 256:
        pattern, text = pattern.astype(np.uint8), text.astype(np.uint8)
    back = text[::-1].copy()
    top = np.append(left[:1], above).astype(np.int32) + gap * np.arange(n + 1, dtype=np.int32)
    side = left.astype(np.int32) + gap * np.arange(m + 1, dtype=np.int32)
    older, old, new, met = (np.zeros(m + 1, np.int32) for _ in range(4))
    same = np.empty(m, bool)
    bottom, right, peaks = np.empty(n, np.int32), np.empty(m, np.int32), np.zeros(m + n + 1, np.int32)
    equal, other = np.int32(scoring.match - scoring.mismatch), np.int32(scoring.mismatch + 2 * gap)
    older[0], old[0], old[1] = top[0], top[1], side[1]
    for d in range(2, m + n + 1):
        lo, hi = max(1, d - n), min(m, d - 1)
        size, cur = hi - lo + 1, new[lo : hi + 1]
        s = met[:size]
        np.equal(pattern[lo - 1 : hi], back[n - d + lo : n - d + hi + 1], out=same[:size])
        np.multiply(same[:size], equal, out=s)
        s += older[lo - 1 : hi]
        s += other
        np.maximum(old[lo : hi + 1], old[lo - 1 : hi], out=cur)
        np.maximum(cur, s, out=cur)
        np.maximum(cur, np.int32(gap * d), out=cur)
        peaks[d] = cur.max() - gap * d
        if d > n:
            right[lo - 1] = cur[0] - gap * d
        if d > m:
            bottom[d - m - 1] = cur[-1] - gap * d
        if d <= n:
            new[0] = top[d]
        if d <= m:
            new[d] = side[d]
        older, old, new = old, new, older
    some = np.sort(peaks)[::-1][:k]
    return bottom, right, some[some > 0].tolist()


def trace_back(pattern: str, text: str, x: int, y: int, scoring: Scoring, cells: int = STRIPE_CELLS, left: np.ndarray | None = None, above: np.ndarray | None = None) -> tuple[int, int, str, str]:
    """walk() without the whole matrix: (first row, first column, aligned pattern, aligned text) of the alignment that ends in a cell.

    Rows are filled downwards once and a few of them are kept; between two of
    them the same is done again, from the last to the first, until a block of at
    most about `cells` cells is filled whole and walked through. Columns that the
    walk has left behind, or can't reach, are not filled again. Memory grows with
    the columns times a logarithm of the rows. With left and above, as edges_of
    takes them, it walks through a tile, and a first row or column of 0 tells that
    it may go on in the next.
    """
    codes, points = code_points(pattern), code_points(text)
    p, s = [], []
    left_first = scoring.tie_order == "diag_left_up"
    at = [x, y, False]  # the cell, and whether the alignment has begun there
    first = np.zeros(1, np.int64)

    def through(lo: int, h: np.ndarray, above: np.ndarray, off: int) -> None:
        """Walks from the cell up to row lo, in a block whose columns begin at off."""
        x, y = at[0], at[1]
        held = np.zeros((len(h) + 1, h.shape[1] + 1), np.int32)
        held[0, 1:], held[1:, 1:] = above, h
        if left is not None:
            held[:, 0] = left[lo : lo + len(held)]
        while x >= lo and y >= off:
            i, j = x - lo, y - off
            v = int(held[i + 1, j + 1])
            if v <= 0:
                at[2] = True
                break
            a, b = pattern[x], text[y]
            if v == int(held[i, j]) + scoring.pair(a, b):
                p.append(a)
                s.append(b)
                x, y = x - 1, y - 1
                continue
            from_left = v == int(held[i + 1, j]) - scoring.gap
            from_up = v == int(held[i, j + 1]) - scoring.gap
            if from_left and (left_first or not from_up):
                p.append("-")
                s.append(b)
                y -= 1
            else:
                p.append(a)
                s.append("-")
                x -= 1
        at[0], at[1] = x, y
        at[2] |= x < 0 or y < off

    def go(lo: int, hi: int, above: np.ndarray, off: int) -> None:
        """Rows lo to hi - 1, the cell in the last of them; above is the row before them, its first column off."""
        begin = max(off, at[1] - 2 * scoring.reach(hi) + 1) if left is None else 0
        above = above[begin - off : at[1] - off + 1]
        n = at[1] - begin + 1
        if (hi - lo) * n <= cells or hi - lo == 1:
            through(lo, fill(codes[lo:hi], points[begin : at[1] + 1], first, scoring, None if left is None else left[lo:], above), above, begin)
            return
        step = -(-(hi - lo) // KEPT_ROWS)
        cuts, kept, row = list(range(lo, hi, step)), [above], above
        pairs = scoring.pairs(points[begin : at[1] + 1])
        rows = max(1, cells // n)
        for a, b in zip(cuts, cuts[1:], strict=False):
            for r in range(a, b, rows):
                row = fill(codes[r : min(r + rows, b)], points[begin : begin + n], first, scoring, None if left is None else left[r:], row, pairs)[-1].copy()
            kept.append(row)
        del pairs
        while cuts and not at[2]:
            a, row = cuts.pop(), kept.pop()
            go(a, at[0] + 1, row, begin)

    go(0, x + 1, np.zeros(y + 1, np.int32) if above is None else above[: y + 1], 0)
    return at[0] + 1, at[1] + 1, "".join(reversed(p)), "".join(reversed(s))
