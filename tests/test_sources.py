from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from seqspark.operators.align import align, align_chunks, align_hits
from seqspark.sources.reports import report, write_by_rank, write_fasta, write_report
from seqspark.sources.sequences import AlignQuery, from_table, read_chunks, read_fasta, read_flat


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.fna").write_bytes(b">one x\r\nACGT\r\nAC\r\n>two\nGG\n\nTT\n>empty\n")
    (tmp_path / "b.fna").write_text("header without mark\nacgt\nac\n")
    (tmp_path / "c.fna").write_text("")
    (tmp_path / "d.txt").write_text("ACGT\n")
    (tmp_path / "e.txt").write_text("")
    return tmp_path


def test_fasta(spark, folder):
    got = {r.seq_id: (r.header, r.seq) for r in read_fasta(spark, str(folder)).collect()}
    assert got == {"a.fna#one": ("one x", "ACGTAC"), "a.fna#two": ("two", "GGTT"), "b.fna#header": ("header without mark", "acgtac")}
    joined = {r.seq_id: r.seq for r in read_fasta(spark, str(folder), concat=True, upper=True).collect()}
    assert joined == {"a.fna": "ACGTACGGTT", "b.fna": "ACGTAC"}


def test_flat_and_table(spark, folder):
    assert [(r.seq_id, r.seq) for r in read_flat(spark, str(folder)).collect()] == [("d.txt", "ACGT")]
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    assert from_table(df, "k", F.upper("v")).first() == (1, "X")


def test_query_file_and_reports(spark, folder, tmp_path):
    config = folder / "q.json"
    config.write_text(json.dumps({"database": str(folder / "a.fna"), "patterns": [str(folder / "d.txt")], "k": 1, "backup_folder": "x"}))
    q = AlignQuery.read(str(config), spark)
    seqs, patterns = q.tables(spark)
    out = align(seqs.select("seq_id", "seq"), patterns, q.k)
    assert [r.report for r in out.select(report().alias("report")).collect()] == ["12\nACGT\nACGT"]
    write_report(out, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 3
    write_by_rank(out, str(tmp_path / "ranks"))
    assert spark.read.text(str(tmp_path / "ranks")).count() == 3
    with pytest.raises(ValueError):
        AlignQuery("x", (), 0)


def test_fasta_round_trip(spark, tmp_path):
    seqs = spark.createDataFrame([("a", "ACGT" * 50), ("b c", "A"), ("d", ""), ("e", None), ("f", "C" * 160)], "seq_id string, seq string")
    write_fasta(seqs, str(tmp_path / "out"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")  # records over many splits
    try:
        got = {r.header: r.seq for r in read_fasta(spark, str(tmp_path / "out"), "*.txt").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"a": "ACGT" * 50, "b c": "A", "f": "C" * 160}


def test_flat_files_in_ranges(spark, tmp_path):
    """Chunks of files with and without lines, read in small ranges, give the hits of whole sequences."""
    rng = random.Random(9)
    seqs = {"one.txt": "".join(rng.choice("ACGT") for _ in range(5000)), "two.txt": "".join(rng.choice("ACGT") for _ in range(900)) + "A", "three.txt": "CGT" * 10}
    for name, s in seqs.items():
        (tmp_path / name).write_text(s)
    (tmp_path / "empty.txt").write_text("")
    lined = tmp_path / "lined"
    lined.mkdir()
    for name, s in seqs.items():
        (lined / name).write_text("\r\n".join(s[k : k + 60] for k in range(0, len(s), 60)) + ("\n" if name == "two.txt" else ""))
    patterns = spark.createDataFrame([(0, "ACGTTGCA"), (1, "GGATC")], "pattern_id long, seq string")
    keep = ["pattern_id", "rank", "seq_id", "score", "x_end", "y_end"]
    want = sorted(map(tuple, align_hits(spark.createDataFrame(list(seqs.items()), "seq_id string, seq string"), patterns, 5).select(*keep).collect()))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        for path, sep in ((tmp_path, "A"), (lined, "\n"), (tmp_path, None), (lined, None)):
            chunks = read_chunks(spark, str(path), 400, 100, sep=sep)
            whole = {}
            for r in chunks.orderBy("seq_id", "chunk_idx").collect():
                assert r.start + r.skip == len(whole.get(r.seq_id, "")) and (r.skip == 100 or not r.start)
                whole[r.seq_id] = whole.get(r.seq_id, "") + r.part[r.skip :]
            assert whole == seqs
            got = align_chunks(lambda core, halo, path=path, sep=sep: read_chunks(spark, str(path), core, halo, sep=sep), patterns, 5, core=400)
            assert sorted(map(tuple, got.select(*keep).collect())) == want
        with pytest.raises(Exception, match="characters"):
            read_chunks(spark, str(tmp_path), 400, 100, sep="\n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_flat_format_cuts_by_bytes_and_follows_what_is_appended(spark, tmp_path):
    from pyspark.sql import functions as F

    from seqspark.sources.ranges import register

    register(spark)
    texts = {"a.txt": "ACGT" * 2500, "b.txt": "aé日🙂" * 700, "c.txt": "x"}
    for name, t in texts.items():
        (tmp_path / name).write_text(t)
    (tmp_path / "other.dat").write_text("no")
    (tmp_path / "empty.txt").write_text("")
    df = spark.read.format("flat").option("glob", "*.txt").option("rangeBytes", 1000).option("pieceBytes", 97).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 10 + 7 + 1
    whole = df.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("p")).collect()
    assert {r.file: "".join(x.value for x in r.p) for r in whole} == texts
    assert {(r.file, r.n) for r in df.where("file = 'a.txt'").unionByName(df).groupBy("file").agg(F.sum(F.length("value")).alias("n")).collect()} == {("a.txt", 20000), ("b.txt", 2800), ("c.txt", 1)}
    work = tmp_path / "_work"

    def run():
        stream = spark.readStream.format("flat").option("glob", "*.txt").load(str(tmp_path))
        stream.writeStream.format("parquet").option("path", str(work / "out")).option("checkpointLocation", str(work / "state")).trigger(availableNow=True).start().awaitTermination(60)

    run()
    with (tmp_path / "a.txt").open("a") as f:
        f.write("TAIL")
    (tmp_path / "n.txt").write_text("new")
    run()
    out = spark.read.parquet(str(work / "out"))
    assert sorted((r.file, r["at"], r.value) for r in out.where("file = 'n.txt' OR at >= 10000").collect()) == [("a.txt", 10000, "TAIL"), ("n.txt", 0, "new")]
    assert out.agg(F.sum(F.length("value"))).first()[0] == 10000 + 2800 + 1 + 4 + 3
