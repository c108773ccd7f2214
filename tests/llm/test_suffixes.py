from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqspark.llm import suffixes

from .conftest import collected, words

LAST = (1 << 63) - 1


def brute(rows: list[tuple]) -> list[tuple]:
    """(doc_id, bytes, removed, runs, digest) by a dictionary of all windows."""
    first: dict[bytes, int] = {}
    texts = [(LAST if i is None else i, (t or "").encode(), i) for i, t in rows]
    for i, b, _ in texts:
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, LAST), i)
    out = []
    for i, b, doc in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((doc, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def fixture() -> list[tuple]:
    rng = random.Random(4)
    passage, line = words(rng, 30), "Released under the common licence of this place, v1.\n"
    base = words(rng, 120)
    rows = [(k, words(rng, rng.randint(1, 40)) + (passage if k % 3 == 0 else "") + words(rng, 20)) for k in range(30)]
    rows += [(k, words(rng, 5) + "\n" + line + words(rng, 6)) for k in range(30, 60)]
    rows += [(60 + k, base[: 100 + 40 * k] + words(rng, 3) + base[100 + 40 * k :]) for k in range(8)]
    rows += [(70, base), (71, base), (70, base), (80, "ab" * 300), (81, "ab" * 200), (82, "a" * 49), (83, "a" * 50), (84, "a" * 51), (85, None), (86, ""), (None, base), (None, passage), (87, passage[:55] + "é" * 40), (88, "é" * 60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shard", "bucket", "many"), [(1 << 21, 3 << 20, 256), (700, 900, 256), (700, 900, 3)])
def test_equals_brute_force(spark, monkeypatch, shard, bucket, many):
    monkeypatch.setattr(suffixes, "HOT_TEXTS", many)
    monkeypatch.setattr(suffixes, "WINDOWS", 500)
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixes.dedup(docs, keep_text=False, shard_bytes=shard, bucket_bytes=bucket).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert collected(got) == brute(rows)


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = suffixes.dedup(awkward, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert collected(got) == brute(rows)
    assert suffixes.dedup(nothing, keep_text=False).count() == 0


def test_rows_keep_their_columns(spark, awkward):
    out = suffixes.drop_repeats(awkward)
    assert out.dtypes == awkward.dtypes
    assert out.count() == awkward.count()
    assert collected(out.drop("text", "n_chars")) == collected(awkward.drop("text", "n_chars"))
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0


@given(st.lists(st.text("ab", min_size=60, max_size=90), min_size=1, max_size=4), st.integers(8, 40))
@settings(max_examples=60, deadline=None)
def test_deep_shallow_orders_suffixes(texts, shallow):
    b = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.arange(len(b) - 49)
    order, group = suffixes.deep_shallow(b, starts, 50, shallow // 8 * 8)
    raw = b.tobytes()
    keys = [raw[s : s + 50] for s in starts[order].tolist()]
    assert keys == sorted(keys)
    assert [a == b for a, b in zip(keys, keys[1:], strict=False)] == (group[1:] == group[:-1]).tolist()


@given(st.text("abc", min_size=0, max_size=300), st.integers(1, 3))
@settings(max_examples=80, deadline=None)
def test_stretches_tile_all_windows(text, parts):
    b = np.frombuffer(text.encode(), np.uint8)
    bounds = np.linspace(0, len(b), parts + 1).astype(np.int64)
    _, first, last, doc = suffixes.stretches(b, bounds)
    windows = sorted(w for a, z in zip(first.tolist(), last.tolist(), strict=True) for w in range(a, z + 1))
    assert windows == [w for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) for w in range(lo, hi - 49)]
    assert all(bounds[d] <= a and z + 50 <= bounds[d + 1] for a, z, d in zip(first.tolist(), last.tolist(), doc.tolist(), strict=True))


def test_buckets_do_not_grow_with_a_common_line(spark, monkeypatch):
    """One line in more and more documents: no bucket gathers its contexts."""
    monkeypatch.setattr(suffixes, "HOT_TEXTS", 200)
    rng = random.Random(8)
    line = "Released under the common licence of this place, version one.\n"
    largest = []
    for n in (1000, 2000, 4000):
        docs = spark.createDataFrame([(k, words(rng, 6) + "\n" + line + words(rng, 6)) for k in range(n)], "doc_id long, text string").repartition(4)
        shards = suffixes.make_shards(docs, 20_000).cache()
        buckets = n // 4
        dealt = suffixes._deal_stretches(shards, suffixes._tell_shared(suffixes._tell_anchors(shards, buckets)), buckets)
        largest.append(dealt.groupBy("bucket").agg(F.sum(F.length("bodies")).alias("n")).agg(F.max("n")).first()[0])
    assert max(largest) < 3 * largest[0]
