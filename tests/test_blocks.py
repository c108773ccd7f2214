"""Tiles of long matrices, filled by differences, against fills and walks of whole ones."""

from __future__ import annotations

import random

import numpy as np
import pytest

from seqspark.functions import blocks
from seqspark.functions.blocks import Tile
from seqspark.functions.kernels import best_cells, code_points, edges_of, fill, trace_back, walk
from seqspark.functions.scoring import Scoring
from seqspark.operators import tiles


def names(n: int, step: int = 1) -> str:
    return "\n".join(f"Supplier#{i:09}" for i in range(n)[::step])


def whole(p: str, t: str, scoring: Scoring) -> np.ndarray:
    """All cells, with a row and a column of zeros before them."""
    return np.pad(fill(code_points(p), code_points(t), np.zeros(1, np.int64), scoring), ((1, 0), (1, 0)))


@pytest.mark.parametrize("scoring", [Scoring(), Scoring(2, -1, 1, tie_order="diag_up_left"), Scoring(5, -20, 1), Scoring(alphabet="AB", matrix=((3, -1), (-2, 2)))])
def test_tiles_equal_the_whole_matrix(monkeypatch, scoring):
    """Sides, bounds, best cells and walks of parts of any place and size, where scores are high, low, or fall from one to the other."""
    for name, value in (("BLOCK", 16), ("CHECK", 8), ("ROOM", 600)):
        monkeypatch.setattr(blocks, name, value)
    rng = random.Random(4)
    w = "".join(rng.choice("ABCé漢") for _ in range(300))
    kin = "".join(c if rng.random() < 0.9 else rng.choice("ABDx") for c in w)
    served = []
    of = Tile._filled
    monkeypatch.setattr(Tile, "_filled", lambda *a: served.append(of(*a)) or served[-1])
    for p, t in ((names(15), names(17, -1)), (w, kin[:150] + "Q" * 40 + kin[150:]), (w, w[::-1])):
        held = whole(p, t, scoring)
        for a, b in ((0, 0), (0, 40), (37, 0), (20, 25), (130, 110)):
            c, d = rng.randint(a + 100, len(p)), rng.randint(b + 100, len(t))
            h = held[a + 1 : c + 1, b + 1 : d + 1]
            top = np.sort(h.ravel())[::-1]
            for keep in (False, True):
                tile = Tile(p[a:c], t[b:d], held[a : c + 1, b], held[a, b + 1 : d + 1], scoring, 3, keep)
                assert (tile.bottom == h[-1]).all() and (tile.right == h[:, -1]).all()
                assert tile.high >= top[0] and len(tile.peaks) <= 3 and all(x <= y for x, y in zip(tile.peaks, top, strict=False))
            for least in (1, max(1, int(top[2])), int(top[0]) + 1):
                got, want = tile.best(least), best_cells(h, np.zeros(d - b, np.int64), 3, least=least)
                assert [x.tolist() for x in got] == [x.tolist() for x in want]
            known: dict = {}
            for x, y in [(c - a - 1, d - b - 1), *((rng.randrange(c - a), rng.randrange(d - b)) for _ in range(4))]:
                assert tile.walk(x, y, known) == trace_back(p[a:c], t[b:d], x, y, scoring, left=held[a : c + 1, b], above=held[a, b + 1 : d + 1])
    told = [x is not None for x in served]
    assert not told if scoring.matrix else any(told) and not all(told)


def test_few_cells_are_filled_by_scores(monkeypatch):
    """Of a tile of names, only those along the matrix's own sides; with all cells, a matrix of 10^12 doesn't end."""
    p, t = names(640)[:12_000], names(640, -1)[:12_000]
    seen = []
    monkeypatch.setattr(blocks, "edges_of", lambda a, b, *rest: seen.append(len(a) * len(b)) or edges_of(a, b, *rest))
    zero = np.zeros(12_001, np.int32)
    tile = Tile(p, t, zero, zero[1:], Scoring(), 5)
    assert sum(seen) < 0.2 * 12_000**2
    bottom, right, _ = edges_of(code_points(p), code_points(t), zero, zero[1:], Scoring(), 5)
    assert (tile.bottom == bottom).all() and (tile.right == right).all()
    seen.clear()
    tile = Tile(p, t, zero + 5000, zero[1:] + 5000, Scoring(), 5)
    assert not seen and tile.high >= tile.bottom.max() > 5000


def test_long_names_in_tiles(spark, monkeypatch):
    """Tiles that are filled by differences, met and walked through by Spark's tasks."""
    monkeypatch.setattr(tiles, "TILE", 1200)
    p, t = names(200), names(190, -1)
    seqs, patterns = spark.createDataFrame([(7, t)], "seq_id long, seq string"), spark.createDataFrame([(1, p)], "pattern_id long, seq string")
    h = whole(p, t, Scoring())[1:, 1:]
    want = {(int(v), int(x), int(y), *walk(h, p, t, int(x), int(y), Scoring())) for x, y, v in zip(*best_cells(h, np.zeros(len(t), np.int64), 4), strict=True)}
    got = tiles.align_long(seqs, patterns, 4, Scoring()).collect()
    assert {(r.score, r.x_end, r.y_end, r.x_start, r.y_start, r.aligned_p, r.aligned_s) for r in got} == want
