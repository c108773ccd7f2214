from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from seqspark.llm import resample

from .conftest import SCHEMA, words


def brute(docs, target, percent=10, least=20, longest=1, bins=10_000):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % bins for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    s, t = np.zeros(bins, int), np.zeros(bins, int)
    rows = [(i, *features(x)) for i, x in docs]
    for _, _, f in rows:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, features(x)[1], 1)
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (int(s.sum()) + bins) / ((int(s[b]) + 1) * (int(t.sum()) + bins)))) for b in range(bins)]
    out = []
    for i, n, f in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], math.inf if x[0] is None else x[0], x[2], x[3]))
    rank = {}
    for k, x in enumerate(enough[: percent * len(enough) // 100], 1):
        rank.setdefault(x, []).append(k)
    return sorted(((i, n, f, w, s_, rank[x].pop(0) if rank.get(x := (i, n, f, w, s_)) else None) for i, n, f, w, s_ in out), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_resample_equals_brute_force(spark, longest):
    rng = random.Random(5)
    docs = [(i, words(rng, rng.randint(1, 80)) + rng.choice(["", " Ünïcode-wörds 3x 　 日本", "\x85tail"])) for i in range(400)]
    docs += docs[:15] + [(None, words(rng, 30)), (None, None), (500, ""), (501, ".,-")]
    target = [words(rng, 40) for _ in range(20)] + [None]
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), percent=30, longest=longest)
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=repr) == brute(docs, target, 30, longest=longest)


def test_words_outside_the_dictionary_count(spark):
    rng = random.Random(6)
    docs = [(i, words(rng, 60)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    counts = [{(r.bucket, r.n) for r in resample.bucket_counts(df, 2, 1000, most).collect()} for most in (0, 7, 50_000)]
    assert counts[0] == counts[1] == counts[2]


def test_scan_across_rebuilds():
    w = resample.Words(50)
    rng = random.Random(7)
    for _ in range(5):
        texts = [words(rng, 30) for _ in range(20)] + [None, "", "x" * 5000]
        owner, bucket, n = resample.slab_features(w, texts, 1, 1 << 30)
        assert bucket.tolist() == [zlib.crc32(x.encode()) % (1 << 30) for t in texts for x in (t or "").split()]
        assert n.tolist() == [len((t or "").split()) for t in texts] and len(w.known) <= 50


def test_joined_crc():
    a, b = [b"", b"ab", b"x" * 300, b"\xff"], [b"cd", b"", b"yy", b"z" * 70]
    got = resample.joined_crc(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([zlib.crc32(x) for x in b], np.uint32), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]


def test_numbered_over_partitions(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(9)
    got = resample.numbered(df, [df.k.desc(), df.id.asc()], "t").collect()
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r["rank"])] == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert sorted(r["rank"] for r in got) == list(range(1, 1001))


def test_resample_awkward(spark, awkward, nothing):
    target = spark.createDataFrame([(1, "the and on re st", 0.5)], "item_id long, text string, score double")
    got = resample.resample(awkward, target)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=repr) == brute(rows, ["the and on re st"])
    assert resample.resample(nothing, target).count() == 0
    assert resample.resample(awkward, target.where("false")).count() == len(rows)
    assert resample.resample(awkward, spark.createDataFrame([], SCHEMA)).where("rank IS NOT NULL").count() == resample.resample(awkward, target).where("rank IS NOT NULL").count()
