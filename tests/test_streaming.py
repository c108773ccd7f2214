from __future__ import annotations

import random

import pandas as pd
import pytest

from seqspark.operators.align import align, align_hits
from seqspark.streaming.align import align_stream, best_of_stream, latest, run_available


def test_restart_late_and_early_pieces(spark, tmp_path):
    rng = random.Random(3)
    seqs = {k: "".join(rng.choice("ACGT") for _ in range(90)) for k in (1, 2)}
    pieces = [(k, n, s[n * 15 : n * 15 + 15]) for k, s in seqs.items() for n in range(6)]
    patterns = spark.createDataFrame([(0, "ACGTACG"), (1, "TTGA")], "pattern_id long, seq string")
    source = tmp_path / "in"
    source.mkdir()
    # the first run sees pieces out of order with one missing; the second gets it, a repeat and the rest
    batches = [[p for p in pieces if p[1] in (0, 2, 3)], [p for p in pieces if p[1] in (1, 2, 4)] + [(1, 0, "CCCC")], [p for p in pieces if p[1] == 5] + [(2, 9, None)]]
    for n, batch in enumerate(batches):
        pd.DataFrame(batch[::-1], columns=["seq_id", "piece", "text"]).to_parquet(source / f"{n}.parquet")
        stream = spark.readStream.schema("seq_id long, piece long, text string").parquet(str(source))
        out = run_available(align_stream(stream, patterns, k=3), "t", str(tmp_path / "work"))
    keep = ["seq_id", "pattern_id", "rank", "score", "x_end", "y_end"]
    got = sorted(map(tuple, latest(out).select(*keep).collect()))
    whole = align_hits(spark.createDataFrame(list(seqs.items()), "seq_id long, seq string"), patterns, 3, per_pair=True)
    assert got == sorted(map(tuple, whole.select(*keep).collect())) and len(got) == 12


def test_best_over_all_sequences_with_alignments_after_restarts(spark, tmp_path):
    rng = random.Random(4)
    seqs = {k: "".join(rng.choice("ACGT") for _ in range(70 + 9 * k)) for k in range(6)}
    pieces = [(k, n, s[n * 13 : n * 13 + 13]) for k, s in seqs.items() for n in range(-(-len(s) // 13))]
    patterns = spark.createDataFrame([(0, "ACGTACGTTGCA"), (1, "TTGA"), (2, None)], "pattern_id long, seq string")
    source = tmp_path / "in"
    source.mkdir()
    rng.shuffle(pieces)
    for n in range(4):
        pd.DataFrame(pieces[n::4], columns=["seq_id", "piece", "text"]).to_parquet(source / f"{n}.parquet")
        stream = spark.readStream.schema("seq_id long, piece long, text string").parquet(str(source))
        hits = align_stream(stream, patterns, k=4, alignments=True)
        out = run_available(best_of_stream(hits, 4), "t", str(tmp_path / "work"))
    whole = align(spark.createDataFrame(list(seqs.items()), "seq_id long, seq string"), patterns, 4)
    keep = ["pattern_id", "rank", "seq_id", "score", "x_end", "y_end", "x_start", "y_start", "aligned_p", "aligned_s"]
    got = sorted(map(tuple, latest(out).select(*keep).collect()))
    assert got == sorted(map(tuple, whole.select(*keep).collect())) and len(got) == 8


def test_surpassed_cells_are_not_told(spark, tmp_path):
    """What goes into the best of all leaves out cells that k told ones surpass, over restarts and ties, and loses none of the best."""
    rng = random.Random(6)
    seqs = {k: "".join(rng.choice("ACGT") for _ in range(60)) for k in range(40)}
    seqs[38] = seqs[39] = seqs[3]
    pieces = [(k, n, s[n * 20 : n * 20 + 20]) for k, s in seqs.items() for n in range(3)]
    patterns = spark.createDataFrame([(0, "ACGTACGTTGCA"), (1, "TTGA")], "pattern_id long, seq string")
    source = tmp_path / "in"
    source.mkdir()
    rng.shuffle(pieces)
    for n in range(2):
        pd.DataFrame(pieces[n::2], columns=["seq_id", "piece", "text"]).to_parquet(source / f"{n}.parquet")
        stream = spark.readStream.schema("seq_id long, piece long, text string").parquet(str(source))
        out = run_available(best_of_stream(align_stream(stream, patterns, k=4, alignments=True, overall=True), 4), "t", str(tmp_path / "work"))
    keep = ["pattern_id", "rank", "seq_id", "score", "x_end", "y_end", "x_start", "y_start", "aligned_p", "aligned_s"]
    whole = align(spark.createDataFrame(list(seqs.items()), "seq_id long, seq string"), patterns, 4)
    assert sorted(map(tuple, latest(out).select(*keep).collect())) == sorted(map(tuple, whole.select(*keep).collect()))
    told = run_available(align_stream(stream, patterns, k=4, alignments=True, overall=True), "all")
    assert told.count() < 160  # all sequences' k best are 320


def test_a_missing_piece_is_told_and_nothing_dropped(spark, tmp_path):
    import time

    patterns = spark.createDataFrame([(0, "ACGT")], "pattern_id long, seq string")
    source, work = tmp_path / "in", str(tmp_path / "work")
    source.mkdir()
    stream = spark.readStream.schema("seq_id long, piece long, text string").parquet(str(source))

    def run(n, rows):
        pd.DataFrame(rows, columns=["seq_id", "piece", "text"]).to_parquet(source / f"{n}.parquet")
        return run_available(align_stream(stream, patterns, wait_ms=1), "t", work)

    run(0, [(1, 0, "AC"), (1, 2, "AC"), (2, 0, "AC")])
    time.sleep(0.1)
    late = run(1, [(2, 1, "GT")]).where("waits_for IS NOT NULL").collect()
    assert [(r.seq_id, r.waits_for, r.pattern_id) for r in late] == [(1, 1, None)]
    out = run(2, [(1, 1, "GT")])
    assert sorted((r.seq_id, r.score, r.y_end, r.pieces) for r in latest(out).collect()) == [(1, 12, 3, 3), (2, 12, 3, 2)]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of a state has a worker of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
