from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqspark.llm import packing

from .conftest import words


def check(docs, pieces):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted(np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in docs.collect())
    got = [r.asDict() for r in packing.pack(docs).collect()] if pieces is None else pieces
    assert sum(p["length"] for p in got) * 4 == sum(map(len, want))
    for p in got:
        assert len(p["ids"]) == 4 * p["length"]
    by_sequence = {}
    for p in got:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    padded = 0
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= packing.WINDOW
        padded += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padded == 0
    return want, got


def test_every_id_once(spark, awkward):
    want, got = check(awkward, None)
    # documents of one id and text have alike pieces, so whole texts are put together from (start, ids) of distinct ids
    whole = {}
    for p in got:
        whole.setdefault((p["doc_id"], p["doc_tokens"]), {})[p["start"]] = p["ids"]
    for (doc, n), parts in whole.items():
        if doc not in (26, 27, None):
            assert b"".join(v for _, v in sorted(parts.items())) in want
            assert n * 4 == sum(map(len, parts.values()))


def test_sequences_and_crc(spark, awkward):
    pieces = packing.pack(awkward)
    seqs = packing.sequences(pieces).collect()
    assert all(len(s.ids) == 4 * s.n_tokens for s in seqs)
    some = pieces.limit(20).collect()
    crcs = {(r.sequence_id, r.offset): r.ids_crc32 for r in packing.piece_crc(packing.pack(awkward)).collect()}
    assert all(crcs[r.sequence_id, r.offset] == zlib.crc32(r.ids) for r in some)


def test_empty_table_and_small_sources(spark, nothing, awkward):
    assert packing.pack(nothing).count() == 0
    check(awkward, [r.asDict() for r in packing.pack(awkward, least_share=0.6).collect()])


def test_large_and_weighted_sources_keep_their_share_among_many(spark):
    rng = random.Random(4)
    rows = [(k, words(rng, 100), f"s{k % 40}") for k in range(400)] + [(1000 + k, words(rng, 100), "big") for k in range(200)] + [(900 + k, words(rng, 100), "mid") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    for weights, low, high in ((None, 0.25, 0.34), ({"big": 3, "mid": 1}, 0.68, 0.8)):
        pieces = [r.asDict() for r in packing.pack(docs, weights, least_share=0.1).collect()]
        check(docs, pieces)
        held = {}
        for p in pieces:
            big, all_of = held.get(p["sequence_id"], (0, 0))
            held[p["sequence_id"]] = big + p["length"] * (p["doc_id"] >= 1000), all_of + p["length"]
        for k in range(8 if weights is None else 1):
            assert held[k][1] == packing.WINDOW and low < held[k][0] / held[k][1] < high, (weights, k, held[k])


def test_thousands_of_small_sources_are_mixed(spark):
    """Sources lie one after the other in the table; every stretch of sequences still holds each of them, and the large one, in proportion."""
    rows = [(10 * s + k, "word and more of it", f"s{s:04d}") for s in range(5000) for k in range(4)] + [(100_000 + k, "word and more of it", "big") for k in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(3)
    pieces = [r.asDict() for r in packing.pack(docs).collect()]
    check(docs, pieces)
    full = sorted({p["sequence_id"] for p in pieces})[:-8]
    big, small, held = {}, {}, {}
    for p in pieces:
        q = p["sequence_id"]
        held[q] = held.get(q, 0) + p["length"]
        if p["doc_id"] >= 100_000:
            big[q] = big.get(q, 0) + p["length"]
        elif q < full[len(full) // 2]:
            small[p["doc_id"] // 10] = small.get(p["doc_id"] // 10, 0) + p["length"]
    assert len(full) > 20 and all(abs(big[q] / held[q] - 8 / 28) < 0.02 for q in full)
    each = sum(p["doc_tokens"] for p in pieces if p["doc_id"] // 10 == 7 and not p["start"])
    assert len(small) == 5000 and all(0.2 * each <= x <= 0.8 * each for x in small.values())


@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 2_000_000), max_size=8), st.booleans())
@settings(max_examples=60, deadline=None)
def test_schedule_covers_every_token_once(totals, weighed):
    plan = packing.schedule(totals, {s: 1 + k for k, s in enumerate(sorted(totals))} if weighed else None)
    spans = {}
    for s, n in totals.items():
        if not n:
            continue
        at = 0
        while at < n:
            size = min(n - at, 50_000)
            for start, length, sequence, offset in packing.cut(plan[s], at, size):
                spans.setdefault(sequence, []).append((offset, length))
            at += size
    assert sum(n for x in spans.values() for _, n in x) == sum(totals.values())
    for x in spans.values():
        end = 0
        for offset, n in sorted(x):
            assert offset == end
            end += n
        assert end == 4096 or end & (end - 1) == 0


def test_windows_keep_the_mixture_and_carry_deficits():
    plan = packing.turn({"a": 2867, "b": 1024, "c": 205}, 64, 64)
    sums = np.cumsum([plan[s] for s in "abc"], axis=1)
    for row, quota in zip(sums, (2867, 1024, 205), strict=True):
        assert np.abs(row - quota * np.arange(1, 65) / 64).max() < 1.01  # never a granule away from the share
        assert row[-1] == quota
    assert (np.sum([plan[s] for s in "abc"], axis=0) == 64).all()


def test_words_as_the_tokenizer_numbers_texts():
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(5)
    some = [*"abcJE'SsTt  \n\t.,!#$%&|09ÀÉß", "J̌", "ǰ", "日本", "ﬁ", "İ", "'ll", "\x01", "<|endoftext|>", "́", " ", "\x1c", "\x85", "٣", "½", " ", " "]
    texts = [None, "", *("".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(3000))]
    table = packing.WordIds(packing.tokenizer_path())
    for at in range(0, len(texts), 50):
        group = pa.array(["pad", *texts[at : at + 50]], pa.string()).slice(1)
        ids, n = table.texts(group)
        ends = np.cumsum(n)
        for t, a, b in zip(group.to_pylist(), ends - n, ends, strict=True):
            assert ids[a:b].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids
