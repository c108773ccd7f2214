"""Readers of sequences: FASTA with or without '>' headers, flat text, table columns, and the JSON form of a query."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import PIECE, register


def _whole(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.translate("value", "\r", "").alias("value"))


def read_fasta(spark: SparkSession, path: str, glob: str | None = "*.fna", concat: bool = False, upper: bool = False) -> DataFrame:
    """(seq_id, header, seq): a row per record, or per file with concat.

    Records are cut by the reader itself at lines that start with '>', so large
    files are split over tasks. A file without such a line has its header in
    its first line. seq_id is the file's name and the header's first word (the
    file's name with concat). Line ends are dropped; empty files and records
    give no row.
    """
    reader = spark.read.option("lineSep", "\n>")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.regexp_replace(F.translate("value", "\r", ""), "^>", "").alias("record"))
    header = F.trim(F.element_at(F.split("record", "\n", 2), 1))
    body = F.regexp_replace(F.coalesce(F.get(F.split("record", "\n", 2), F.lit(1)), F.lit("")), r"\s", "")
    seqs = raw.select("file", "block", "n", header.alias("header"), (F.upper(body) if upper else body).alias("seq")).where("seq <> ''")
    if concat:
        parts = seqs.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "n", "header", "seq"))).alias("r"))
        return parts.select(F.col("file").alias("seq_id"), F.get("r", F.lit(0))["header"].alias("header"), F.array_join(F.transform("r", lambda x: x["seq"]), "").alias("seq"))
    name = F.split("header", r"\s", 2)[0]
    return seqs.select(F.concat_ws("#", "file", name).alias("seq_id"), "header", "seq")


def read_flat(spark: SparkSession, path: str, glob: str | None = "*.txt") -> DataFrame:
    """(seq_id, header, seq): one sequence in each file, without white space; empty files give no row."""
    text = _whole(spark, path, glob)
    return text.select(F.col("file").alias("seq_id"), F.lit(None).cast("string").alias("header"), F.regexp_replace("value", r"\s", "").alias("seq")).where("seq <> ''")


def _ranges(spark: SparkSession, path: str, size: int, glob: str | None) -> DataFrame:
    """(seq_id, block, n, piece) of files cut by bytes."""
    register(spark)
    raw = spark.read.format("flat").option("glob", glob or "*").option("pieceBytes", max(4, size)).load(path)
    return raw.select(F.col("file").alias("seq_id"), F.col("at").alias("block"), F.lit(0).cast("long").alias("n"), F.regexp_replace("value", r"\s", "").alias("piece"))


def _records(spark: SparkSession, path: str, glob: str | None, sep: str) -> DataFrame:
    """(seq_id, block, n, piece) of files whose records end at sep."""
    reader = spark.read.option("lineSep", sep)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    kept = F.lit("" if sep.isspace() else sep)
    raw = reader.text(path).select(F.col("_metadata.file_name").alias("seq_id"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    ends = raw.groupBy("seq_id").agg(F.max(F.struct("block", "n")).alias("last"), (F.first("size") - F.sum(F.length("value")) - F.count("*")).alias("lack"))
    unended = (F.struct("block", "n") == F.col("last")) & (F.col("lack") < 0)  # the last record need not end with a separator
    text = F.concat(F.regexp_replace("value", r"\s", ""), F.when(unended, "").otherwise(kept))
    return raw.join(F.broadcast(ends), "seq_id").select("seq_id", "block", "n", text.alias("piece"))


def read_chunks(spark: SparkSession, path: str, core: int, halo: int, glob: str | None = "*.txt", sep: str | None = None) -> DataFrame:
    """(seq_id, chunk_idx, start, skip, part) of flat files of any length, one sequence in each, read in ranges: no row holds a whole sequence.

    Files are cut by bytes into pieces of at most core - halo characters (the
    format `flat`), whether they have lines or not. Where only Spark's own
    readers reach the files, sep says what ends a record: a line end, which is no
    part of a sequence, or one of its letters, the more frequent the better,
    which stays; a record of more than core - halo characters is then refused,
    and files are taken to be ASCII. Cores of about `core` characters begin at
    pieces, with up to `halo` characters before them. White space is dropped;
    empty files give no row; file names must differ.
    """
    if not 0 <= halo < core:
        raise ValueError("the halo must be shorter than the core")
    pieces = _ranges(spark, path, min(PIECE, core - halo), glob) if sep is None else _records(spark, path, glob, sep)
    length = F.length("piece").cast("long")
    bases = pieces.groupBy("seq_id", "block").agg(F.sum(length).alias("chars"))
    before = W.partitionBy("seq_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    bases = bases.select("seq_id", "block", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("seq_id", "block").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    long = F.when(F.length("piece") > core - halo, F.raise_error(F.lit(f"a record has more than {core - halo} characters"))).otherwise(F.col("piece"))
    placed = pieces.withColumn("upto", F.sum(length).over(within)).join(bases, ["seq_id", "block"]).where(length > 0)
    placed = placed.select("seq_id", (F.col("base") + F.col("upto") - length).alias("start"), long.alias("piece"))
    grouped = placed.groupBy("seq_id", F.floor(F.col("start") / core).cast("int").alias("chunk_idx")).agg(F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("p"))
    cores = grouped.select("seq_id", "chunk_idx", "start", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("part"))
    tails = cores.select("seq_id", (F.col("chunk_idx") + 1).alias("chunk_idx"), F.right("part", F.lit(halo)).alias("tail"))
    met = cores.join(tails, ["seq_id", "chunk_idx"], "left").withColumn("tail", F.coalesce("tail", F.lit("")))
    return met.select("seq_id", "chunk_idx", (F.col("start") - F.length("tail")).alias("start"), F.length("tail").alias("skip"), F.concat("tail", "part").alias("part"))


def from_table(df: DataFrame, seq_id: str, seq: str | Column) -> DataFrame:
    """(seq_id, seq) of any table."""
    return df.select(F.col(seq_id).alias("seq_id"), (F.col(seq) if isinstance(seq, str) else seq).alias("seq"))


def patterns_from(df: DataFrame, pattern_id: str, seq: str | Column) -> DataFrame:
    """(pattern_id, seq) of any table."""
    return df.select(F.col(pattern_id).cast("long").alias("pattern_id"), (F.col(seq) if isinstance(seq, str) else seq).alias("seq"))


@dataclass(frozen=True)
class AlignQuery:
    """A database, its patterns in order, and k."""

    database: str
    patterns: tuple[str, ...]
    k: int

    def __post_init__(self) -> None:
        if self.k < 1:
            raise ValueError("k must be at least 1")

    @staticmethod
    def read(path: str, spark: SparkSession) -> AlignQuery:
        """The query in a JSON file, wherever Spark can read it."""
        raw = json.loads(spark.read.text(path, wholetext=True).first().value)
        return AlignQuery(raw["database"], tuple(raw["patterns"]), int(raw["k"]))

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(sequences, patterns); a pattern's id is its place in the list."""
        def one(path: str) -> DataFrame:
            return read_fasta(spark, path, None) if path.endswith((".fna", ".fa", ".fasta")) else read_flat(spark, path, None)

        patterns = None
        for i, p in enumerate(self.patterns):
            row = one(p).select(F.lit(i).cast("long").alias("pattern_id"), "seq")
            patterns = row if patterns is None else patterns.unionByName(row)
        return one(self.database), patterns
