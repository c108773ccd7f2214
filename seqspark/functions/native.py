"""Alignment and sequence expressions built from Spark SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scoring import Scoring

#: Letters outside ACGTN, and what each is read as.
OTHER_LETTERS = "BDEFHIJKLMOPQRSUVWXYZ"
READ_AS = "CGTACGTACGTACGTACGTAC"


def dna(text: Column) -> Column:
    """A whole text as a nucleotide sequence: letters A-Z only, upper case, others mapped into the alphabet; null stays null."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), OTHER_LETTERS, READ_AS)


def is_valid(text: Column, alphabet: str = "ACGTN") -> Column:
    return text.rlike(f"^[{alphabet}]*$")


def symbol_index(char: Column, alphabet: str = "ACGTN") -> Column:
    """0-based place in the alphabet, -1 if it isn't there."""
    return F.instr(F.lit(alphabet), char) - 1


def conform(text: Column, scoring: Scoring) -> Column:
    """A sequence as the scoring reads it: symbols outside the alphabet stay, are refused, or become N."""
    outside = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in scoring.alphabet) + "]"
    if scoring.unknown == "as_n":
        return F.regexp_replace(text, outside, "N")
    if scoring.unknown == "error":
        return F.when(text.rlike(outside), F.raise_error(F.concat(F.lit("symbol outside the alphabet: "), F.regexp_extract(text, outside, 0)))).otherwise(text)
    return text


def pair_score(a: Column, b: Column, scoring: Scoring = Scoring()) -> Column:
    same = F.when(a == b, F.lit(scoring.match)).otherwise(F.lit(scoring.mismatch))
    if scoring.matrix is None:
        return same
    known = F.create_map(*[F.lit(x) for i, c in enumerate(scoring.alphabet) for j, d in enumerate(scoring.alphabet) for x in (c + d, scoring.matrix[i][j])])
    return F.coalesce(F.try_element_at(known, F.concat(a, b)), same)


def slice_inclusive(text: Column, begin: Column, end: Column) -> Column:
    """Characters begin..end, 0-based and inclusive; what lies past the end is left out."""
    return F.substring(text, begin + 1, end - begin + 1)


def equal_parts(text: Column, n: int, pad: str = "M") -> Column:
    """n parts of equal width; the last is padded on its right."""
    width = F.ceil(F.length(text) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.rpad(F.substring(text, k * width + 1, width), width, pad))


def best_score(pattern: Column, text: Column, scoring: Scoring = Scoring()) -> Column:
    """Best local score of two short strings, a fold over anti-diagonals: each needs the two before it alone."""
    m, n = F.length(pattern), F.length(text)
    zero = F.transform(F.sequence(F.lit(0), m), lambda i: F.lit(0))
    start = F.struct(zero.alias("a"), zero.alias("b"), F.lit(0).alias("best"))

    def step(acc: Column, d: Column) -> Column:
        def cell(i: Column) -> Column:
            j = d - i
            met = pair_score(F.substring(pattern, i, F.lit(1)), F.substring(text, j, F.lit(1)), scoring)
            value = F.greatest(F.lit(0), F.get(acc["a"], i - 1) + met, F.get(acc["b"], i - 1) - scoring.gap, F.get(acc["b"], i) - scoring.gap)
            return F.when((i >= 1) & (j >= 1) & (j <= n), value).otherwise(F.lit(0))

        row = F.transform(F.sequence(F.lit(0), m), cell)
        return F.struct(acc["b"].alias("a"), row.alias("b"), F.greatest(acc["best"], F.array_max(row)).alias("best"))

    folded = F.aggregate(F.sequence(F.lit(2), m + n), start, step)["best"]
    return F.when(pattern.isNull() | text.isNull(), None).when((m == 0) | (n == 0), 0).otherwise(folded).cast("int")


def best_scores(pairs: DataFrame, longest: int, scoring: Scoring = Scoring()) -> DataFrame:
    """(pattern_id, seq_id, score) of pairs (pattern_id, p, seq_id, seq) whose patterns have at most `longest` characters, by windows over a row for each character.

    Within a row of the matrix the gap from the left is a running maximum. All
    rows use one partitioning and one order, so pairs are shuffled and sorted
    once. Pairs without a positive score have no row.
    """
    chars = pairs.where((F.length("p") > 0) & (F.length("seq") > 0)).select("pattern_id", "seq_id", "p", F.posexplode(F.split("seq", "")).alias("j", "c"))
    along = W.partitionBy("pattern_id", "seq_id").orderBy("j")
    upto = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    h, gap, best = F.lit(0), F.lit(scoring.gap), F.lit(0)
    for i in range(1, longest + 1):
        corner = F.coalesce(F.lag("h").over(along), F.lit(0)) if i > 1 else F.lit(0)
        met = corner + pair_score(F.substring("p", i, 1), F.col("c"), scoring)
        chars = chars.withColumn("t", F.when(F.length("p") >= i, F.greatest(F.lit(0), h - gap, met))).withColumn("h", (F.max(F.col("t") + gap * F.col("j")).over(upto) - gap * F.col("j")).cast("int"))
        chars, h, best = chars.withColumn("best", F.greatest(best, "h")), F.col("h"), F.col("best")
    return chars.groupBy("pattern_id", "seq_id").agg(F.max(best).cast("int").alias("score")).where("score > 0")
