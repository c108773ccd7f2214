from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from seqspark.llm import neardup, ngramjoin

from .conftest import words


def shingles(text, width=5):
    w = (text or "").encode().lower().split() if (text or "").isascii() else (text or "").split()
    w = [x if isinstance(x, bytes) else x.encode() for x in w]
    return {b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, percent=80):
    sets, parent, holders = [shingles(t) for _, t in rows], list(range(len(rows))), defaultdict(list)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        both = defaultdict(int)
        for g in s:
            for j in holders[g]:
                both[j] += 1
            holders[g].append(k)
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[top(k)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(s), least.get(top(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def told(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        k = rng.randrange(len(w) + 1)
        w[k : k + rng.randint(0, 2)] = words(rng, rng.randint(0, 2)).split()
    return " ".join(w)


def corpus(seed):
    """Documents at all similarities around 0.8, chains of edits, shared passages, short texts and copies."""
    rng = random.Random(seed)
    base = [words(rng, rng.choice([4, 5, 6, 9, 12, 30, 60, 150])) for _ in range(60)]
    passage = words(rng, 40)
    out = list(base)
    for t in base:
        for _ in range(4):
            out.append(edited(rng, t, rng.randint(0, max(1, len(t.split()) // 20))))
        chain = t
        for _ in range(3):
            chain = edited(rng, chain, 1)
            out.append(chain)
    out += [passage + " " + words(rng, n) for n in (1, 2, 3, 5, 8, 8, 10, 30)] * 2
    out += [base[0].upper(), " ".join(base[1].split()[:-1])]
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("block", [1000, 20])
def test_components_equal_brute_force(spark, block):
    rows = corpus(block)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert told(ngramjoin.join_components(df, block=block)) == brute(rows)


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 800)
    assert told(ngramjoin.join_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_hot_shingles_lose_no_link(spark, monkeypatch):
    rng = random.Random(8)
    notice = words(rng, 30)
    rows = [(i, notice + " " + words(rng, rng.randint(1, 9))) for i in range(150)] + [(200 + i, t) for i, t in corpus(4)]
    monkeypatch.setattr(neardup, "HOT", 0)
    real, found = neardup.hot_shingles, []
    monkeypatch.setattr(neardup, "hot_shingles", lambda marks: found.append(real(marks)) or found[-1])
    monkeypatch.setattr(neardup, "HOT_LEAST", 20)
    assert told(ngramjoin.join_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert len(found[0]) > 5


@pytest.mark.parametrize("sided", [False, True])
def test_prefix_join_joins_what_is_similar(sided):
    rng = random.Random(9)
    for trial in range(40):
        sets, pool = [], rng.sample(range(1000), 60)
        for _ in range(40):
            old = sorted(rng.choice(sets)) if sets and rng.random() < 0.7 else rng.sample(pool, rng.randint(1, 30))
            new = [x for x in old if rng.random() > 0.05] + rng.sample(range(1000), rng.randint(0, 2))
            sets.append(set(new or old))
        side = [rng.randint(0, 1) for _ in sets] if sided else None
        links = ngramjoin.prefix_join(list(range(40)), [np.array(sorted(s), np.uint64) for s in sets], side, 0.8)
        similar = {(i, j) for i in range(40) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and not (side and side[i] == side[j])}
        assert {(max(p), min(p)) for p in links} <= similar

        def groups(pairs):
            parent = list(range(40))
            for a, b in pairs:
                x, y = parent[a], parent[b]
                parent = [y if p == x else p for p in parent]
            return [parent.index(p) for p in parent]

        assert groups(links) == groups(similar), trial


def test_join_awkward(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = told(ngramjoin.join_components(awkward))
    assert [(i, c) for i, _, c in got] == [(i, c) for i, _, c in brute(rows)]
    assert ngramjoin.join_components(nothing).count() == 0
