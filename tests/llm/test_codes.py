from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from seqspark.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, v int, position int, salt int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [int(np.floor(4096 * np.float64(np.float32(x)))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda v, k: tuple(v[k * width : (k + 1) * width])
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, k) for _, v, _ in first] for k in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, k: min(range(len(books[k])), key=lambda e: (apart(p, books[k][e]), e))
    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for k in range(parts):
                held[k][near(cut(v, k), k)].append(cut(v, k))
        books = [[tuple(sum(c) // len(h) for c in zip(*h, strict=True)) if h else books[k][e] for e, h in enumerate(held[k])] for k in range(parts)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], {}
    for i, v, y in kept:
        at = [near(cut(v, k), k) for k in range(parts)]
        error = sum(apart(cut(v, k), books[k][e]) for k, e in enumerate(at))
        out.append((i, "".join(f"{e:02x}" for e in at), error, y))
        total[y] = total.get(y, 0) + error
    return sorted(((i, c, e, total[y], sha) for i, c, e, y in out), key=repr)


def told(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "c", 1, 2, 3, 4) for i, v, y in rows], SCHEMA)


@pytest.mark.parametrize("n", [0, 5, 300])
def test_codes_equal_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([rng.uniform(-0.7, 0.7), 0.25, -0.5]) for _ in range(16)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(7, rows[0][1], 1)] * 3 if n else []
    assert told(codes.compress(frame(spark, rows).repartition(3))) == brute(rows)


def test_awkward_vectors(spark):
    rng = random.Random(1)
    good = [(i, [rng.uniform(-1, 1) for _ in range(8)], i % 3) for i in range(40)]
    odd = [(50, None, 1), (51, [0.1] * 7 + [None], 1), (52, [0.1] * 7 + [float("nan")], 1), (53, [float("inf")] + [0.0] * 7, None), (54, [0.5] * 16, 2), (55, [], 2)]
    nulls = [(None, good[0][1], None), (None, good[1][1], None), (3, good[2][1], None)]
    assert told(codes.compress(frame(spark, good + odd + nulls))) == brute(good + nulls)
    assert codes.compress(frame(spark, odd[:4])).count() == 0
    assert [r.code for r in codes.compress(frame(spark, odd[5:])).collect()] == ["00" * 8]
    with pytest.raises(Exception, match="equal parts"):
        codes.compress(frame(spark, [(1, [0.1] * 9, 1)]))
    with pytest.raises(Exception, match="beyond"):
        codes.compress(frame(spark, [(1, [1e6] * 8, 1)]))


def test_nearest_over_deep_and_flat_tries(monkeypatch):
    rng = np.random.default_rng(3)
    for spread, subtree in ((3, 16), (3, 4096), (4000, 16), (1, 4)):
        monkeypatch.setattr(codes, "SUBTREE", subtree)
        raw = rng.integers(-spread, spread + 1, (3000, 4))
        parts, weight, which = codes.trie(raw)
        assert (parts[which] == raw).all() and weight.sum() == 3000
        assert [tuple(p) for p in parts.tolist()] == sorted(set(map(tuple, raw.tolist())))
        books = rng.integers(-spread, spread + 1, (16, 4))
        label, error = codes.nearest(parts, books)
        all_ = ((parts[:, None, :] - books[None, :, :]) ** 2).sum(axis=2)
        assert (label == all_.argmin(axis=1)).all() and (error == all_.min(axis=1)).all()


def test_many_labels_are_joined(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], rng.choice([None, *range(30)])) for i in range(200)]
    want = brute(rows)
    monkeypatch.setattr(codes, "MOST_SENT", 3)
    assert told(codes.compress(frame(spark, rows))) == want
