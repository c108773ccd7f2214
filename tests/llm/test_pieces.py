from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece as spm

from seqspark.llm import pieces


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=pieces.model_path())


@pytest.fixture(scope="module")
def codec():
    return pieces.PieceCodec(pieces.PieceModel(pieces.model_path()))


def test_fuzz_against_the_library(library, codec):
    rng = random.Random(1)
    some = [*"abcdefgh  \n\t▁.,AZ09", "é", "ß", "日本", "🙂", "́", "\0", "  ", "   ", "the", "ing", " the", "<s>", "<0x0A>", "▁"]
    chars, own = sorted(codec.model.chars), codec.model.piece[259:]
    for k in range(6000):
        pool, most = ((some, 40), (chars, 12), (own, 8))[k % 3]
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, most)))
        ids = library.encode(text)
        assert codec.encode(text) == ids, text
        assert codec.both(text)[1] == codec.decode(ids) == library.decode(ids), text


def test_runs_of_spaces_and_long_words(library, codec):
    for n in range(70):
        assert codec.encode(" " * n + "w" + " " * (n % 5)) == library.encode(" " * n + "w" + " " * (n % 5))
    for text in ("ab" * 5000, "x" * 9999, "\n" * 50, "日" * 300):
        assert codec.encode(text) == library.encode(text)


def test_table_is_the_merge_procedure(codec):
    rng = random.Random(2)
    for _ in range(500):
        word = "▁" + "".join(rng.choice("aeinorstlhd") for _ in range(rng.randint(1, 14)))
        assert [codec.model.piece[i] for i in codec.model.by_table(word)] == codec.model.merge(word)


def test_tables(spark, awkward, nothing, library):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want = sorted(((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()) for i, ids in ((i, library.encode(t or "")) for i, t in rows)), key=repr)
    assert sorted(map(tuple, pieces.piece_digests(awkward).collect()), key=repr) == want
    back = pieces.decode_pieces(pieces.encode_pieces(awkward))
    assert sorted((r.text for r in back.collect())) == sorted((t or "").replace("▁", " ") for _, t in rows)
    assert pieces.piece_digests(nothing).count() == 0
