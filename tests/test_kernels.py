from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqspark.functions.kernels import Bound, Grams, Seeds, best_cells, bounded_best, code_points, fill, striped_best, stripes, trace_back, walk
from seqspark.functions.scoring import Scoring

S = Scoring()
words = st.text("ACGTN", min_size=1, max_size=24)


def plain(p: str, s: str, scoring: Scoring = S) -> list[list[int]]:
    h = [[0] * (len(s) + 1) for _ in range(len(p) + 1)]
    for i, a in enumerate(p, 1):
        for j, b in enumerate(s, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (scoring.match if a == b else scoring.mismatch), h[i - 1][j] - scoring.gap, h[i][j - 1] - scoring.gap)
    return [row[1:] for row in h[1:]]


def one(p: str, s: str, scoring: Scoring = S) -> np.ndarray:
    return fill(code_points(p), code_points(s), np.zeros(1, np.int64), scoring)


def rescore(ap: str, as_: str) -> int:
    return sum(-2 if "-" in (a, b) else 3 if a == b else -3 for a, b in zip(ap, as_, strict=True))


def test_known_matrix():
    h = one("GGTTGACTA", "TGTTACGG")
    assert h[0].tolist() == [0, 3, 1, 0, 0, 0, 3, 3]
    assert h[6].tolist() == [0, 2, 1, 3, 8, 13, 11, 9]
    assert h.max() == 13
    assert walk(h, "GGTTGACTA", "TGTTACGG", 6, 5, S)[2:] == ("GTTGAC", "GTT-AC")


def test_long_known_alignment():
    # a 78-column alignment with gaps on both sides; its strings without gaps score the same again
    p = "TGCATGA---TATTGA--AAAAATATCACCAAATAAAAAACG-C-CT-TAGTA-AGTATTTTTCAGCTTTTCATTCTG"
    s = "TGTACGACCCTA-AGACTAAAAATGTTA-CAAA-AGAAAATGACTCTAAAG-AGGGT-TTTTTCA-C-TTACATT-TG"
    assert rescore(p, s) == 89
    assert one(p.replace("-", ""), s.replace("-", "")).max() == 89


def test_extremes():
    assert one("ACGTACGT", "ACGTACGT").max() == 24
    assert one("AAAA", "CCCC").max() == 0
    assert one("N", "N").max() == 3
    assert one("A", "a").max() == 0


@given(words, words)
@settings(max_examples=150, deadline=None)
def test_matches_plain_recurrence(p, s):
    assert one(p, s).tolist() == plain(p, s)


@given(words, words)
@settings(max_examples=60, deadline=None)
def test_score_is_symmetric(p, s):
    assert one(p, s).max() == one(s, p).max()


@given(words, st.lists(words, min_size=1, max_size=5))
@settings(max_examples=80, deadline=None)
def test_texts_end_to_end_do_not_touch(p, texts):
    sizes = np.array(list(map(len, texts)))
    h = fill(code_points(p), code_points("".join(texts)), sizes.cumsum() - sizes, S)
    for t, a, b in zip(texts, sizes.cumsum() - sizes, sizes.cumsum(), strict=True):
        assert h[:, a:b].tolist() == plain(p, t)


@given(words, words, words)
@settings(max_examples=80, deadline=None)
def test_goes_on_from_a_column(p, s, t):
    whole = one(p, s + t)
    left = np.concatenate(([0], one(p, s)[:, -1]))
    assert fill(code_points(p), code_points(t), np.zeros(1, np.int64), S, left).tolist() == whole[:, len(s) :].tolist()


@given(words, words, st.sampled_from(["diag_left_up", "diag_up_left"]), st.integers(1, 4))
@settings(max_examples=100, deadline=None)
def test_alignments_rescore(p, s, order, k):
    scoring = Scoring(tie_order=order)
    h = one(p, s, scoring)
    x, y, v = best_cells(h, np.zeros(len(s), np.int64), k)
    cells = sorted((-int(h[i, j]), j, i) for i in range(len(p)) for j in range(len(s)) if h[i, j] > 0)[:k]
    assert [(-a, b, c) for a, b, c in zip(v.tolist(), y.tolist(), x.tolist(), strict=True)] == cells
    for i, j, score in zip(x.tolist(), y.tolist(), v.tolist(), strict=True):
        a, b, ap, as_ = walk(h, p, s, i, j, scoring)
        assert rescore(ap, as_) == score
        assert ap.replace("-", "") == p[a : i + 1] and as_.replace("-", "") == s[b : j + 1]


@given(words, st.text("ACGT", min_size=1, max_size=120))
@settings(max_examples=60, deadline=None)
def test_reach_bounds_the_span(p, s):
    h = one(p, s)
    if h.max() > 0:
        x, y, _ = best_cells(h, np.zeros(len(s), np.int64), 3)
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            assert j - walk(h, p, s, i, j, S)[1] + 1 <= S.reach(len(p))


def test_ties_are_kept_on_demand():
    h = one("A", "ABAB")
    assert len(best_cells(h, np.zeros(4, np.int64), 1)[0]) == 1
    assert len(best_cells(h, np.zeros(4, np.int64), 1, ties=True)[0]) == 2


@pytest.mark.parametrize("bad", [{"gap": 0}, {"match": 0}, {"mismatch": 1}, {"tie_order": "left"}])
def test_scoring_is_checked(bad):
    with pytest.raises(ValueError):
        Scoring(**bad)


@given(words, words, st.integers(1, 200), st.booleans(), st.sampled_from(["diag_left_up", "diag_up_left"]))
@settings(max_examples=150, deadline=None)
def test_stripes_and_walks_in_linear_space_equal_the_whole_matrix(p, s, cells, ties, order):
    scoring = Scoring(tie_order=order)
    s = s + p[2:] + s
    h, first = one(p, s, scoring), np.zeros(1, np.int64)
    parts = list(stripes(code_points(p), code_points(s), first, scoring, cells=cells))
    assert np.concatenate([x for _, x in parts]).tolist() == h.tolist()
    segment = np.zeros(len(s), np.int64)
    for k in (1, 4):
        found = [x.tolist() for x in best_cells(h, segment, k, ties)]
        assert [x.tolist() for x in striped_best(iter([(a, x.copy()) for a, x in parts]), segment, k, ties)] == found
        for x, y, _ in zip(*found, strict=True):
            assert trace_back(p, s, x, y, scoring, cells) == walk(h, p, s, x, y, scoring)


@settings(max_examples=300, deadline=None)
@given(st.text("ACG", min_size=1, max_size=20), st.lists(st.text("ACG", min_size=1, max_size=60), min_size=1, max_size=6), st.integers(1, 60), st.integers(0, 4), st.sampled_from([S, Scoring(1, -3, 5), Scoring(5, -1, 1), Scoring(2, 0, 3), Scoring(matrix=tuple(tuple(4 if i == j else -1 for j in range(5)) for i in range(5)))]), st.randoms())
def test_the_bound_lets_no_cell_go(p, texts, least, halo, scoring, rng):
    texts = [t[: len(t) // 2] + p[rng.randrange(len(p)) :] + t[len(t) // 2 :] if rng.random() < 0.5 else t for t in texts]  # pieces of the pattern among the rest
    coded, text = code_points(p), code_points("".join(texts))
    size = np.array(list(map(len, texts)))
    first, segment = size.cumsum() - size, np.repeat(np.arange(len(texts)), size)
    skip = np.arange(len(text)) - first[segment] < halo
    h = fill(coded, text, first, scoring)
    live = Bound(coded, scoring).columns(Grams(text), least)
    assert live is None or not (h[:, ~live] >= least).any()
    want = striped_best(stripes(coded, text, first, scoring), segment, 3, least=least, skip=skip)
    *got, filled = bounded_best(coded, Bound(coded, scoring), Grams(text), first, segment, 3, scoring, least, skip, scoring.pairs(text))
    assert [a.tolist() for a in got] == [a.tolist() for a in want] and filled <= len(text)


@pytest.mark.parametrize(("letters", "m"), [("abcdefghijklmnopqrstuvwxyz ", 12), ("ACGT", 400)])
def test_few_columns_are_filled_where_hits_are_close(letters, m):
    rng = np.random.default_rng(5)
    p, s = ("".join(rng.choice(list(letters), n)) for n in (m, 200_000))
    s = s[:120_000] + p[: m // 2] + "#" + p[m // 2 :] + s[120_000:]
    coded, text, first = code_points(p), code_points(s), np.zeros(1, np.int64)
    x, y, score, filled = bounded_best(coded, Bound(coded, S), Grams(text), first, np.zeros(len(text), np.int64), 5, S, 3 * m - 6, None, S.pairs(text))
    assert (x[0], y[0], score[0]) == (m - 1, 120_000 + m, 3 * m - 2) and filled < 0.02 * len(text)


def test_a_stripe_goes_on_from_a_column_and_a_row():
    rng = np.random.default_rng(5)
    p, s = (rng.integers(65, 69, n).astype(np.uint32) for n in (40, 90))
    h = fill(p, s, np.zeros(1, np.int64), S)
    left = np.concatenate(([0], h[:, 29])).astype(np.int32)
    right = np.concatenate([x for _, x in stripes(p, s[30:], np.zeros(1, np.int64), S, left, cells=200)])
    assert (right == h[:, 30:]).all()


LONG = """
import random, resource, sys
import numpy as np
from seqspark.functions.kernels import code_points, striped_best, stripes, trace_back
from seqspark.functions.scoring import Scoring
rng = random.Random(2)
make = lambda n: "".join(rng.choices("ACGT", k=n))
p = make(30_000)
s = make(9_000) + p[4_000:20_000] + make(5_000)
S = Scoring()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
x, y, v = striped_best(stripes(code_points(p), code_points(s), np.zeros(1, np.int64), S), np.zeros(len(s), np.int64), 1)
i, j, a, b = trace_back(p, s, int(x[0]), int(y[0]), S)
score = sum(-2 if "-" in c else 3 if c[0] == c[1] else -3 for c in zip(a, b))
print(int(v[0]), score, a.replace("-", "") == p[i : x[0] + 1], b.replace("-", "") == s[j : y[0] + 1], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_thirty_thousand_by_thirty_thousand_in_bounded_memory():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", LONG], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert int(out[0]) == int(out[1]) > 48_000 and out[2:4] == ["True", "True"]
    assert int(out[4]) < 500  # MB; the matrix itself would be 3.6 GB


def test_seeds_find_all_best_cells():
    """Short texts find the same cells in a long pattern by its runs as by all of its rows, and whole ones fill few of them."""
    rng = random.Random(2)
    told = 0
    for n in range(200):
        scoring, symbols = (S, Scoring(2, -1, 1), Scoring(5, -4, 3))[n % 3], "ABCDEFGHIJ"[: 4 if n % 2 else 10]
        p = "".join(rng.choice(symbols) for _ in range(3000))
        at = rng.randrange(2900)
        t = list(p[at : at + rng.randrange(4, 40)])
        for _ in range(n % 4):
            t[rng.randrange(len(t))] = rng.choice(symbols)
        k, skip = rng.choice((1, 1, 2, 5)), rng.choice((0, 0, 3))
        codes, text = code_points(p), code_points("".join(t))
        got = Seeds(codes, scoring).best(text, k, skip)
        if got is not None:
            told += 1
            h = fill(codes, text, np.zeros(1, np.int64), scoring)
            h[:, :skip] = 0
            assert all((a == b).all() for a, b in zip(got, best_cells(h, np.zeros(len(text), np.int64), k), strict=True))
    assert told > 50
    names = "\n".join(f"Supplier#{n:09}" for n in range(2000))
    seeds, filled = Seeds(code_points(names), S), []
    near = seeds._near
    seeds._near = lambda text, places, *rest: filled.append(len(places)) or near(text, places, *rest)
    x, y, v = seeds.best(code_points("Supplier#000001234"), 1)
    assert (x.tolist(), y.tolist(), v.tolist()) == ([1234 * 19 + 17], [17], [54]) and sum(filled) <= 2
