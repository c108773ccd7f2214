"""Scoring of local alignments with linear gap costs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NUCLEOTIDES = "ACGTN"


@dataclass(frozen=True)
class Scoring:
    """match > 0, mismatch <= 0, gap > 0 (cost of each gap character); ties walk back diagonally first, then by tie_order.

    With a matrix, two symbols of the alphabet score what it holds for them (a
    row and a column for each symbol, in order); all else scores by equality.
    unknown tells what a symbol outside the alphabet is: `free` (itself),
    `error` (refused) or `as_n` (read as N).
    """

    match: int = 3
    mismatch: int = -3
    gap: int = 2
    tie_order: str = "diag_left_up"
    alphabet: str = NUCLEOTIDES
    matrix: tuple[tuple[int, ...], ...] | None = None
    unknown: str = "free"

    def __post_init__(self) -> None:
        if self.match <= 0 or self.mismatch > 0 or self.gap <= 0:
            raise ValueError("match and gap must be positive, mismatch must not")
        if self.tie_order not in ("diag_left_up", "diag_up_left"):
            raise ValueError(f"unknown tie order {self.tie_order!r}")
        if self.unknown not in ("free", "error", "as_n") or (self.unknown == "as_n" and "N" not in self.alphabet):
            raise ValueError(f"unknown symbols can be free, an error, or as_n with N in the alphabet, not {self.unknown!r}")
        if len(set(self.alphabet)) != len(self.alphabet):
            raise ValueError("a symbol stands in the alphabet twice")
        if self.matrix is not None and (len(self.matrix) != len(self.alphabet) or any(len(row) != len(self.alphabet) for row in self.matrix)):
            raise ValueError("the matrix needs a row and a column for each symbol")

    @property
    def most(self) -> int:
        """The most that two symbols can score."""
        return max(self.match, *(max(row) for row in self.matrix or ((self.match,),)))

    def pair(self, a: str, b: str) -> int:
        if self.matrix is not None:
            i, j = self.alphabet.find(a), self.alphabet.find(b)
            if i >= 0 and j >= 0:
                return self.matrix[i][j]
        return self.match if a == b else self.mismatch

    def pairs(self, text: np.ndarray) -> Pairs:
        return Pairs(self, text)

    def reach(self, pattern_length: int) -> int:
        """The most database characters that an alignment of positive score can span, so what a chunk needs on its left."""
        return pattern_length + -(-self.most * pattern_length // self.gap)


class Pairs(dict):
    """The scores of a symbol (its code point) along a text, made when they are asked for; as many are kept as fit in KEPT bytes."""

    KEPT = 32 << 20

    def __init__(self, scoring: Scoring, text: np.ndarray) -> None:
        self.scoring, self.text, self.place = scoring, text, None
        most = max(map(abs, (scoring.match, scoring.mismatch, *(v for row in scoring.matrix or () for v in row))))
        self.kind = np.int8 if most < 128 else np.int32
        if scoring.matrix is not None:
            codes = np.array([ord(c) for c in scoring.alphabet], np.uint32)
            order = np.argsort(codes)
            at = np.minimum(np.searchsorted(codes[order], text), len(codes) - 1)
            self.place = np.where(codes[order][at] == text, order[at], len(codes))  # the last place is that of all other symbols

    def __missing__(self, code: int) -> np.ndarray:
        scoring = self.scoring
        k = scoring.alphabet.find(chr(code)) if self.place is not None else -1
        if k >= 0:
            row = np.array([*scoring.matrix[k], scoring.mismatch], self.kind)[self.place]
        else:
            row = np.where(self.text == code, self.kind(scoring.match), self.kind(scoring.mismatch))
        if (len(self) + 1) * row.nbytes <= self.KEPT:
            self[code] = row
        return row
