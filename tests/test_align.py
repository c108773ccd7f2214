from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqspark.functions import kernels, native
from seqspark.functions.kernels import best_cells, code_points, fill, walk
from seqspark.functions.scoring import Scoring
from seqspark.functions.sql import register
from seqspark.operators import align as ops

PATTERNS = [(0, "ACGT"), (1, "GGTTGACTA"), (2, ""), (3, None), (4, "GGTTGACTA")]


def tables(spark, seqs, patterns=PATTERNS):
    return spark.createDataFrame(seqs, "seq_id long, seq string"), spark.createDataFrame(patterns, "pattern_id long, seq string")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def long_seqs():
    rng = random.Random(7)
    return [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((3000, 700, 1, 40))] + [(9, ""), (10, None), (11, "NNNN")]


@pytest.mark.parametrize("per_pair", [False, True])
def test_chunks_do_not_change_hits(spark, long_seqs, per_pair, monkeypatch):
    seqs, patterns = tables(spark, long_seqs)
    keep = ["pattern_id", "rank", "seq_id", "score", "x_end", "y_end"]
    whole = rows(ops.align_hits(seqs, patterns, 4, per_pair=per_pair, core=1 << 20).select(*keep))
    cut = rows(ops.align_hits(seqs, patterns, 4, per_pair=per_pair, core=60).select(*keep))
    assert whole == cut and whole
    for sent, columns in ((1 << 20, 50), (9, 1000)):  # narrow groups, and patterns a block at a time
        monkeypatch.setattr(ops, "SENT_CHARS", sent)
        monkeypatch.setattr(ops, "COLUMNS", columns)
        assert rows(ops.align_hits(seqs, patterns, 4, per_pair=per_pair, core=60).select(*keep)) == whole


def test_alignments_of_chunks(spark, long_seqs):
    seqs, patterns = tables(spark, long_seqs)
    a = rows(ops.align(seqs, patterns, 3, core=1 << 20).drop("chunk_idx"))
    assert rows(ops.align(seqs, patterns, 3, core=64).drop("chunk_idx")) == a
    for r in ops.statistics(ops.align(seqs, patterns, 3)).collect():
        assert 3 * r.n_match - 3 * r.n_mismatch - 2 * r.n_gap == r.score


def test_trace_of_given_hits(spark, long_seqs, monkeypatch):
    seqs, patterns = tables(spark, long_seqs)
    want = rows(ops.align(seqs, patterns, 3, core=64).drop("chunk_idx"))
    hits = ops.align_hits(seqs, patterns, 3, core=64)
    assert rows(ops.trace(hits, seqs, patterns).drop("chunk_idx")) == want
    monkeypatch.setattr(ops, "MOST_SENT", 1)
    assert rows(ops.trace(hits, seqs, patterns).drop("chunk_idx")) == want


def test_no_sequence_is_broadcast_or_joined(spark, long_seqs):
    seqs, patterns = tables(spark, long_seqs)
    plan = ops.align(seqs, patterns, 3)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert len(joins) == 1 and "pattern_id" in joins[0] and "seq_id" not in joins[0]


@pytest.mark.parametrize("k", [1, 2, 7])
@pytest.mark.parametrize("ties", [False, True])
def test_best_cells_equal_a_full_sort(k, ties):
    rng = np.random.default_rng(k)
    for _ in range(30):
        h = rng.integers(0, 6, (4, 40)).astype(np.int32)
        segment = np.sort(rng.integers(0, 5, 40))
        got = list(zip(*(c.tolist() for c in best_cells(h, segment, k, ties)), strict=True))
        want = []
        for s in sorted(set(segment.tolist())):
            cells = sorted((-int(h[x, y]), int(y), x) for x in range(4) for y in np.flatnonzero(segment == s) if h[x, y] > 0)
            bound = cells[k - 1][0] if len(cells) >= k else 0
            want += [(x, y, -v) for n, (v, y, x) in enumerate(cells) if n < k or (ties and v == bound)]
        assert got == want


def test_matrix_and_unknown_symbols(spark):
    matrix = ((5, -4, 0), (-4, 5, 0), (0, 0, -1))
    scoring = Scoring(alphabet="ABN", matrix=matrix, gap=3)

    def plain(p, s):
        h, best = [[0] * (len(s) + 1) for _ in range(len(p) + 1)], 0
        for i, a in enumerate(p, 1):
            for j, b in enumerate(s, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + scoring.pair(a, b), h[i - 1][j] - 3, h[i][j - 1] - 3)
                best = max(best, h[i][j])
        return best

    rng = random.Random(2)
    seqs, patterns = tables(spark, [(i, "".join(rng.choice("ABNZ") for _ in range(30))) for i in range(20)], [(0, "ABBA"), (1, "ZNAB")])
    want = sorted((p.pattern_id, s.seq_id, plain(p.seq, s.seq)) for p in patterns.collect() for s in seqs.collect())
    assert rows(ops.align_hits(seqs, patterns, 1, scoring, per_pair=True, core=8).select("pattern_id", "seq_id", "score")) == want
    pairs = ops.with_patterns(seqs, patterns)
    assert rows(pairs.select("pattern_id", "seq_id", native.best_score(F.col("p"), F.col("seq"), scoring).alias("score"))) == want
    for r in ops.align(seqs, patterns, 2, scoring).collect():
        assert r.score == sum(-3 if "-" in (a, b) else scoring.pair(a, b) for a, b in zip(r.aligned_p, r.aligned_s, strict=True))
    as_n = Scoring(alphabet="ABN", matrix=matrix, gap=3, unknown="as_n")
    read = [(r.seq_id, r.seq.replace("Z", "N")) for r in seqs.collect()]
    clean = tables(spark, read, [(0, "ABBA"), (1, "NNAB")])
    assert rows(ops.align(seqs, patterns, 2, as_n)) == rows(ops.align(*clean, 2, scoring))
    with pytest.raises(Exception, match="outside the alphabet"):
        ops.align_hits(seqs, patterns, 1, Scoring(alphabet="ABN", unknown="error")).collect()
    for bad in ({"matrix": ((1,),)}, {"alphabet": "AA"}, {"unknown": "x"}, {"alphabet": "AB", "unknown": "as_n"}):
        with pytest.raises(ValueError):
            Scoring(**bad)


def test_edge_cases(spark):
    seqs, patterns = tables(spark, [(1, ""), (2, None), (3, "CCC")], [(0, "AAA")])
    assert ops.align_hits(seqs, patterns, 2).count() == 0
    none, nothing = tables(spark, [], [])
    assert ops.align_hits(none, patterns, 1).count() == 0
    assert ops.align_hits(seqs, nothing, 1).count() == 0
    with pytest.raises(ValueError):
        ops.align_hits(seqs, patterns, 0)
    seqs, patterns = tables(spark, [(1, "A")], [(0, "A")])
    assert [(r.score, r.x_end, r.y_end) for r in ops.align_hits(seqs, patterns, 9).collect()] == [(3, 0, 0)]


def test_native_fold_agrees(spark, long_seqs):
    seqs, patterns = tables(spark, [r for r in long_seqs if r[1] is None or len(r[1]) < 100])
    pairs = ops.with_patterns(seqs, patterns)
    fold = pairs.select("pattern_id", "seq_id", native.best_score(F.col("p"), F.col("seq")).alias("score"))
    assert rows(fold.where("score > 0")) == rows(ops.align_hits(seqs, patterns, 1, per_pair=True).select("pattern_id", "seq_id", "score"))


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT align_score('GGTTGACTA', 'TGTTACGG') a, align_score(NULL, 'A') b").first() == (13, 0)
    r = spark.sql("SELECT x.* FROM VALUES ('GGTTGACTA', 'TGTTACGG') t(p, s), LATERAL align(t.p, t.s, 1) x").first()
    assert (r.score, r.aligned_p, r.aligned_s, r.y_end) == (13, "GTTGAC", "GTT-AC", 5)
    assert spark.sql("SELECT count(*) FROM align_hits('ACGT', 'ACGT', 3)").first()[0] == 3
    assert spark.sql("SELECT align_score('ACGT', 'AACGTT', 5, -1, 1) a, align_score('AC', 'AGC', 2, -9, 1) b").first() == (20, 3)
    assert spark.sql("SELECT score FROM align_hits('AC', 'AGC', 1, 2, -9, 1)").first()[0] == 3


def test_sql_functions_take_pairs_side_by_side(spark, monkeypatch):
    """Lists of a batch's pairs, and walks of many cells, are those of pairs taken one by one, in one stripe and in several."""
    from seqspark.functions import sql

    rng = random.Random(4)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.choice((3, 7)))), rng.choice((None, "", "c")) if n % 9 == 0 else "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))) for n in range(200)]
    costs = [pa.array([v] * 100 + [w] * 100) for v, w in ((3, 2), (3, 2), (-3, -1), (2, 1))]
    for cells in (1 << 20, 50):
        monkeypatch.setattr(sql, "STRIPE_CELLS", cells)
        found = sql.pair_lists(*(pa.array(c) for c in zip(*pairs, strict=True)), *costs, True).to_pylist()
        for n, ((p, s), got) in enumerate(zip(pairs, found, strict=True)):
            scoring, want = Scoring(*((3, -3, 2) if n < 100 else (2, -1, 1))), []
            if s:
                h = kernels.fill(kernels.code_points(p), kernels.code_points(s), np.zeros(1, np.int64), scoring)
                for x, y, v in zip(*kernels.best_cells(h, np.zeros(len(s), np.int64), 3 if n < 100 else 2), strict=True):
                    i, j, ap, as_ = kernels.trace_back(p, s, int(x), int(y), scoring)
                    want.append((len(want) + 1, v, i, x, j, y, ap, as_))
            assert [tuple(c.values()) for c in got] == want
    register(spark)
    plan = spark.sql("SELECT h.* FROM VALUES ('AC', 'AGC') t(p, s), LATERAL align_hits(p, s, 1) h")._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "EvalPythonUDTF" not in plan


def test_pairs_are_dealt_out(spark, tmp_path):
    """The pairs of a table that lies in one partition are spread before each row stands there once for each pattern."""
    from seqspark.plans import queries

    spark.range(3000).selectExpr("id p_partkey", "concat('part number ', id) p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0, "PART"), (1, "NUMBER")], "r_regionkey int, r_name string").coalesce(1).write.parquet(f"{tmp_path}/region.parquet")
    for query in (queries.sql_align, queries.sql_align_table):
        out = query(spark, str(tmp_path))
        assert out.count() == 6000 and out.rdd.getNumPartitions() > 1


def test_edges_of_tiles():
    """A tile filled by diagonals hands on the whole matrix's cells, and tells its best one."""
    rng = random.Random(1)
    for scoring in (Scoring(), Scoring(2, -1, 1), Scoring(alphabet="AB", matrix=((3, -1), (-2, 2)))):
        p, t = (kernels.code_points("".join(rng.choice("ABC") for _ in range(n))) for n in (40, 50))
        held = np.zeros((41, 51), np.int32)
        held[1:, 1:] = fill(p, t, np.zeros(1, np.int64), scoring)
        for a, b, c, d in ((0, 0, 40, 50), (7, 0, 20, 50), (5, 9, 6, 30), (0, 20, 30, 21), (13, 17, 40, 31)):
            bottom, right, peaks = kernels.edges_of(p[a:c], t[b:d], held[a : c + 1, b], held[a, b + 1 : d + 1], scoring, 3)
            tile = held[a + 1 : c + 1, b + 1 : d + 1]
            assert (bottom == tile[-1]).all() and (right == tile[:, -1]).all() and max(peaks, default=0) == tile.max()
            assert sorted(peaks, reverse=True) <= sorted(tile.ravel().tolist(), reverse=True)[: len(peaks)]


@pytest.mark.parametrize(("per_pair", "scoring"), [(False, Scoring()), (True, Scoring(2, -1, 1, tie_order="diag_up_left"))])
def test_long_with_long_in_tiles(spark, monkeypatch, per_pair, scoring):
    """Tiles, each a task's work, give the alignments of the whole matrix; short sequences and patterns keep their chunks."""
    from seqspark.operators import tiles

    rng = random.Random(11)
    names = [f"item{n:03}" for n in range(12)]
    seqs, patterns = tables(spark, [(5, ";".join(names[::-1])), (2, "".join(rng.choice("ACGT") for _ in range(90))), (7, "AC"), (8, None)], [(1, ";".join(names)), (3, "ACGTACGGT" * 6), (4, "item"), (6, "")])
    want = rows(ops.align(seqs, patterns, 3, scoring, per_pair).drop("chunk_idx").select("pattern_id", "seq_id", "rank", "score", "x_end", "y_end", "x_start", "y_start", "aligned_p", "aligned_s"))
    monkeypatch.setattr(tiles, "TILE", 30)
    monkeypatch.setattr(tiles, "MOST_TILES", 5)
    got = ops.align(seqs, patterns, 3, scoring, per_pair)
    assert rows(got.select("pattern_id", "seq_id", "rank", "score", "x_end", "y_end", "x_start", "y_start", "aligned_p", "aligned_s")) == want


def test_short_texts_in_a_long_pattern(spark, monkeypatch):
    """Hits by pair of texts that runs find, and of those that they don't, cut into chunks, are those of all rows."""
    rng = random.Random(3)
    p = "".join(rng.choice("ACGTBDEF") for _ in range(20_000))
    seqs, patterns = tables(spark, [(n, p[a : a + 40][:: 1 if n % 3 else -1]) for n, a in enumerate(range(0, 4000, 400))] + [(90, "ZZ"), (91, ""), (92, "AC"), (93, p[99:500])], [(1, p), (2, "ACG")])
    keep = ["pattern_id", "seq_id", "rank", "score", "x_end", "y_end"]
    got = rows(ops.align_hits(seqs, patterns, 2, per_pair=True).select(*keep))
    monkeypatch.setattr(kernels.Seeds, "serve", staticmethod(lambda pattern, scoring: False))
    assert got == rows(ops.align_hits(seqs, patterns, 2, per_pair=True).select(*keep))


def test_only_a_group_of_texts_is_decoded_at_once():
    """A task holds a batch as it came and the code points of one group of its texts, whatever the batch's rows."""
    import tracemalloc
    from types import SimpleNamespace

    shared = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value))
    cut = SimpleNamespace(dtypes=[("seq_id", "bigint")], sparkSession=SimpleNamespace(sparkContext=shared), mapInArrow=lambda run, schema: run)
    run = ops.chunk_hits(cut, [(0, "needle")], 1, Scoring(), per_pair=True)
    n = 4000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), *(pa.array([0] * n, t) for t in (pa.int32(), pa.int64(), pa.int32())), pa.array(["hay needle hay " * 160] * n)], names=["seq_id", "chunk_idx", "start", "skip", "part"])
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == n and peak < 16 << 20  # all texts take 38 MB as code points


def test_text_helpers(spark):
    df = spark.createDataFrame([("Hello, N!",), ("",), (None,)], "t string")
    read = dict(zip(native.OTHER_LETTERS, native.READ_AS, strict=True))
    assert [r[0] for r in df.select(native.dna(F.col("t"))).collect()] == ["".join(read.get(c, c) for c in "HELLON"), "", None]
    got = df.select(native.dna(F.col("t")).alias("d")).where(F.col("d").isNotNull())
    assert got.where(~native.is_valid(F.col("d"))).count() == 0
    parts = df.limit(1).select(F.explode(native.equal_parts(F.col("t"), 4))).collect()
    assert [p[0] for p in parts] == ["Hel", "lo,", " N!", "MMM"]
    assert df.limit(1).select(native.slice_inclusive(F.col("t"), F.lit(1), F.lit(99))).first()[0] == "ello, N!"
    assert df.limit(1).select(native.symbol_index(F.lit("G")), native.symbol_index(F.lit("x"))).first() == (2, -1)


def test_long_alignments_equal_the_whole_matrix(spark):
    """Walked back in linear space, for a pattern and a sequence of many hundred characters."""
    rng = random.Random(12)
    p = "".join(rng.choice("ACGT") for _ in range(700))
    s = p[300:650] + "".join(rng.choice("ACGT") for _ in range(200)) + p[50:400:1][::-1] + p[10:500]
    for order in ("diag_left_up", "diag_up_left"):
        scoring = Scoring(tie_order=order)
        h = fill(code_points(p), code_points(s), np.zeros(1, np.int64), scoring)
        want = [(int(v), *walk(h, p, s, int(x), int(y), scoring)) for x, y, v in zip(*best_cells(h, np.zeros(len(s), np.int64), 5), strict=True)]
        seqs, patterns = tables(spark, [(1, s)], [(1, p)])
        got = ops.align(seqs, patterns, 5, scoring, core=64).orderBy("rank").collect()
        assert [(r.score, r.x_start, r.y_start, r.aligned_p, r.aligned_s) for r in got] == want


def test_names_in_both_orders_equal_the_whole_matrix(spark):
    """The query without SQL, on the smallest tables, against a fill and walks of the whole matrix."""
    import os

    from seqspark.plans import queries

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the test tables")
    names = sorted(r.s_name for r in spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").collect())
    p, s = "\n".join(names), "\n".join(reversed(names))
    h = fill(code_points(p), code_points(s), np.zeros(1, np.int64), Scoring())
    want = [(rank, int(v), int(x), int(y), *walk(h, p, s, int(x), int(y), Scoring())) for rank, (x, y, v) in enumerate(zip(*best_cells(h, np.zeros(len(s), np.int64), queries.K), strict=True), 1)]
    got = queries.sw_long_traceback(spark, "/root/testdata/sf0.001").orderBy("rank").collect()
    assert [(r["rank"], r.score, r.x_end, r.y_end, r.x_start, r.y_start, r.aligned_p, r.aligned_s) for r in got] == want


def test_one_long_sequence_is_dealt_out(spark):
    seqs, patterns = tables(spark, [(1, "ACGTTGCA" * 20_000), (2, "ACG")], [(0, "GGTTGACTA")])
    cut = ops.dealt_out(seqs.coalesce(1), ops.chunks(seqs.coalesce(1), 4096, 30))
    held = cut.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 4 and sum(r["count"] for r in held) == 41
    even = seqs.where("seq_id = 2").repartition(4)
    assert ops.dealt_out(even.where("false"), even.where("false")).count() == 0


def test_sets_of_patterns_beyond_the_bound_are_refused_where_all_must_be_sent(spark, monkeypatch):
    seqs, patterns = tables(spark, [(1, "ACGT")])
    for name in ("SENT_CHARS", "LITERAL_CHARS"):
        monkeypatch.setattr(ops, name, 5)
    for f in (lambda: ops.with_patterns(seqs, patterns), lambda: ops.boundary(seqs, patterns, True), lambda: ops.cells(seqs, patterns)):
        with pytest.raises(ValueError, match="most that are sent"):
            f()
    assert rows(ops.align_hits(seqs, patterns, 1, per_pair=True).select("pattern_id", "score")) == [(0, 12), (1, 7), (4, 7)]


def test_table_functions_equal_the_operators(spark):
    rng = random.Random(3)
    seqs = [(i, "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 50)))) for i in range(40)] + [(90, None)]
    register(spark)
    s, p = tables(spark, seqs)
    s.selectExpr("seq_id", "seq").crossJoin(p.selectExpr("pattern_id", "seq AS p")).createOrReplaceTempView("all_pairs")
    keep = ["pattern_id", "seq_id", "rank", "score", "x_end", "y_end", "x_start", "y_start", "aligned_p", "aligned_s"]
    want = rows(ops.align(s, p, 3, per_pair=True).select(*keep))
    for by in ("", "PARTITION BY (p)"):
        assert rows(spark.sql(f"SELECT {', '.join(keep)} FROM align_of(TABLE(SELECT pattern_id, p, seq_id, seq FROM all_pairs) {by}, 3)")) == want
    costly = rows(spark.sql("SELECT pattern_id, seq_id, rank, score FROM align_hits_of(TABLE(SELECT * FROM all_pairs), 2, 2, -1, 1)"))
    assert costly == rows(ops.align_hits(s, p, 2, Scoring(2, -1, 1), per_pair=True).select("pattern_id", "seq_id", "rank", "score"))
    with pytest.raises(Exception, match="k must be"):
        spark.sql("SELECT * FROM align_of(TABLE(SELECT * FROM all_pairs), 0)").collect()


def test_given_files(spark):
    """Known scores of sequence files in the folder SEQSPARK_FILES: its known.json lists database, pattern, score, x_end and y_end."""
    import json
    import os

    from seqspark.sources.sequences import AlignQuery

    folder = os.environ.get("SEQSPARK_FILES")
    if not folder:
        pytest.skip("no folder is given")
    with open(f"{folder}/known.json") as f:
        known = json.load(f)
    for case in known:
        seqs, patterns = AlignQuery(f"{folder}/{case['database']}", (f"{folder}/{case['pattern']}",), 1).tables(spark)
        hit = ops.align(seqs, patterns, 1).first()
        assert (hit.score, hit.x_end, hit.y_end) == (case["score"], case["x_end"], case["y_end"])
        assert sum(-2 if "-" in (a, b) else 3 if a == b else -3 for a, b in zip(hit.aligned_p, hit.aligned_s, strict=True)) == hit.score


def test_windows_score_as_the_operator_does(spark):
    rng = random.Random(8)
    seqs = [(i, "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(90, None)]
    s, p = tables(spark, seqs)
    pairs = ops.with_patterns(s, p)
    for scoring in (Scoring(), Scoring(2, -1, 1)):
        want = rows(ops.align_hits(s, p, 1, scoring, per_pair=True).select("pattern_id", "seq_id", "score"))
        assert rows(native.best_scores(pairs, 9, scoring)) == want and want
