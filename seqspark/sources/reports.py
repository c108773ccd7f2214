"""Writers: the three-line text report of alignments, FASTA, and flat text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(score: str = "score", pattern: str = "aligned_p", text: str = "aligned_s") -> Column:
    """Score, aligned pattern and aligned sequence, a line each."""
    return F.concat_ws("\n", F.col(score).cast("string"), F.col(pattern), F.col(text))


def labelled_report() -> Column:
    return F.concat(F.lit("Score of chain:"), F.col("score").cast("string"), F.lit("\npattern: "), F.col("aligned_p"), F.lit("\nsequence: "), F.col("aligned_s"))


def write_report(alignments: DataFrame, path: str) -> None:
    """Text files by pattern, each report three lines."""
    alignments.select("pattern_id", report().alias("value")).write.partitionBy("pattern_id").mode("overwrite").text(path)


def write_by_rank(alignments: DataFrame, path: str) -> None:
    """Labelled text files, a folder for each sequence and rank."""
    alignments.select("seq_id", "rank", labelled_report().alias("value")).write.partitionBy("seq_id", "rank").mode("overwrite").text(path)


def write_fasta(seqs: DataFrame, path: str, header: str = "seq_id", width: int = 80) -> None:
    """Sequences as FASTA text, lines of `width` characters; a header is one line. Nulls count as empty."""
    lines = F.regexp_replace(F.coalesce("seq", F.lit("")), f"(.{{{width}}})", "$1\n")
    head = F.translate(F.coalesce(F.col(header).cast("string"), F.lit("")), "\r\n", "  ")
    seqs.select(F.concat(F.lit(">"), head, F.lit("\n"), F.rtrim(lines)).alias("value")).write.mode("overwrite").text(path)


def write_flat(seqs: DataFrame, path: str) -> None:
    """Each sequence as flat text in a folder of its own (seq_id=...), without a line end; null and empty ones have none. Ids must differ."""
    seqs.where(F.length("seq") > 0).select("seq_id", F.col("seq").alias("value")).repartition("seq_id").write.partitionBy("seq_id").option("lineSep", "\n").mode("overwrite").text(path)
