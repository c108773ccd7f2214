"""The aligner as SQL functions.

align_score(p, s) is a scalar; align_hits(p, s, k) and align(p, s, k) are table
functions for a LATERAL join: SQL functions over a scalar one that gives a list
for each pair and fills a batch's texts of a pattern side by side. For whole tables
align_hits_of(TABLE(pairs), k) and align_of(TABLE(pairs), k) take the columns
pattern_id, p, seq_id and seq by Arrow batches and fill all texts of a pattern
side by side; with PARTITION BY (p) each task sees all of a pattern's pairs
together. All take match, mismatch and gap as further arguments; by default
those of Scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .kernels import STRIPE_CELLS, code_points, fill, striped_best, stripes, trace_back, walk_many
from .scoring import Scoring

#: Characters of texts that are filled side by side, about.
COLUMNS = 32_768


def _runs(of: dict[str, list[int]], texts: list[np.ndarray | None]) -> Iterator[tuple[str, list[int]]]:
    """(pattern, rows): the rows of each pattern, as many at a time as make COLUMNS characters, or one."""
    for p, rows in of.items():
        held, size = [], 0
        for r in rows:
            if held and size + len(texts[r]) > COLUMNS:
                yield p, held
                held, size = [], 0
            held.append(r)
            size += len(texts[r])
        yield p, held


def _pair_cells(ps: list[str | None], ss: list[str | None], k: int, scoring: Scoring, alignments: bool) -> tuple[list[int], list[list], list[list]]:
    """(row, [rank, score, x_end, y_end], [x_start, y_start, aligned_p, aligned_s]) of the k best cells of every pair, as columns; null and empty strings have none."""
    texts = [code_points(s) if p and s else None for p, s in zip(ps, ss, strict=True)]
    of: dict[str, list[int]] = {}
    for r, t in enumerate(texts):
        if t is not None:
            of.setdefault(ps[r], []).append(r)
    at, cells, walks = [], [[], [], [], []], [[], [], [], []]
    for p, rows in _runs(of, texts):
        size = np.array([len(texts[r]) for r in rows])
        first = size.cumsum() - size
        segment = np.repeat(np.arange(len(rows)), size)
        codes, text = code_points(p), np.concatenate([texts[r] for r in rows])
        h = fill(codes, text, first, scoring) if len(codes) * len(text) <= STRIPE_CELLS else None
        x, y, v = striped_best(iter([(0, h)]) if h is not None else stripes(codes, text, first, scoring), segment, k)
        if not len(x):
            continue
        owner, inner = segment[y], y - first[segment[y]]
        opens = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        rank = np.arange(len(owner)) - np.repeat(opens, np.diff(np.append(opens, len(owner)))) + 1
        found = [rows[o] for o in owner.tolist()]
        at += found
        for column, values in zip(cells, (rank, v, x, inner), strict=True):
            column += values.tolist()
        if alignments:
            if h is not None:
                walked = walk_many(h, codes, text, first[owner], x, y, scoring)
            else:
                walked = zip(*(trace_back(p, ss[r], i, j, scoring) for r, i, j in zip(found, x.tolist(), inner.tolist(), strict=True)), strict=True)
            for column, values in zip(walks, walked, strict=True):
                column += values
    return at, cells, walks


def pair_hits(batch: pa.RecordBatch, k: int, scoring: Scoring, alignments: bool) -> pa.Table:
    """The k best cells of every row (pattern_id, p, seq_id, seq); null and empty strings have none."""
    at, cells, walks = _pair_cells(batch.column("p").to_pylist(), batch.column("seq").to_pylist(), k, scoring, alignments)
    out = {"pattern_id": batch.column("pattern_id").take(pa.array(at, pa.int64())).cast(pa.int64()), "seq_id": batch.column("seq_id").take(pa.array(at, pa.int64())).cast(pa.int64())}
    out |= {n: pa.array(c, t) for n, c, t in zip(("rank", "score", "x_end", "y_end"), cells, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)}
    if alignments:
        out |= {n: pa.array(c, t) for n, c, t in zip(("x_start", "y_start", "aligned_p", "aligned_s"), walks, (pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)}
    return pa.table(out)


HITS = "score int, x_end int, y_end int"
ALIGNMENTS = "rank int, score int, x_start int, x_end int, y_start int, y_end int, aligned_p string, aligned_s string"


def pair_lists(p: pa.Array, s: pa.Array, k: pa.Array, match: pa.Array, mismatch: pa.Array, gap: pa.Array, alignments: bool) -> pa.Array:
    """For every pair the list of its k best cells (HITS, or ALIGNMENTS), all pairs of a batch side by side."""
    told = np.stack([np.array(c.to_pylist()) for c in (k, match, mismatch, gap)], axis=1)
    kinds, which = np.unique(told, axis=0, return_inverse=True) if len(told) else (told, np.zeros(0, np.int64))
    ps, ss, at, cells, walks = p.to_pylist(), s.to_pylist(), [], [[], [], [], []], [[], [], [], []]
    for n, kind in enumerate(kinds):
        rows = np.flatnonzero(which.ravel() == n).tolist()
        some, *columns = _pair_cells([ps[r] for r in rows], [ss[r] for r in rows], *_costs(*([v] for v in kind)), alignments)
        at += [rows[r] for r in some]
        for held, new in zip((cells, walks), columns, strict=True):
            for a, b in zip(held, new, strict=True):
                a += b
    rank, score, x_end, y_end = cells
    named = {"rank": rank, "score": score, "x_end": x_end, "y_end": y_end} | (dict(zip(("x_start", "y_start", "aligned_p", "aligned_s"), walks, strict=True)) if alignments else {})
    fields = [c.split() for c in (ALIGNMENTS if alignments else HITS).split(", ")]
    by = pa.array(np.argsort(np.array(at, np.int64), kind="stable"))
    values = pa.StructArray.from_arrays([pa.array(named[n], pa.int32() if t == "int" else pa.string()).take(by) for n, t in fields], names=[n for n, _ in fields])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.bincount(np.array(at, np.int64), minlength=len(ps)).cumsum()).astype(np.int32)), values)


class HitsOf:
    def eval(self, pairs: pa.RecordBatch, k: pa.Array, match: pa.Array = (3,), mismatch: pa.Array = (-3,), gap: pa.Array = (2,)) -> Iterator[pa.Table]:
        if pairs.num_rows:
            yield pair_hits(pairs, *_costs(k, match, mismatch, gap), False)


class AlignmentsOf:
    def eval(self, pairs: pa.RecordBatch, k: pa.Array, match: pa.Array = (3,), mismatch: pa.Array = (-3,), gap: pa.Array = (2,)) -> Iterator[pa.Table]:
        if pairs.num_rows:
            yield pair_hits(pairs, *_costs(k, match, mismatch, gap), True)


def _costs(k, *costs) -> tuple[int, Scoring]:
    """The arguments, which Arrow gives as columns of one value each."""
    k, *costs = (int(c[0].as_py() if isinstance(c, pa.Array) else c[0]) for c in (k, *costs))
    if k < 1:
        raise ValueError("k must be at least 1")
    return k, Scoring(*costs)


def _lists(kind: str, alignments: bool):
    def lists(p: pa.Array, s: pa.Array, k: pa.Array, match: pa.Array, mismatch: pa.Array, gap: pa.Array) -> pa.Array:
        return pair_lists(p, s, k, match, mismatch, gap, alignments)

    return F.arrow_udf(lists, f"array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL; null and empty inputs score 0 and have no hits."""

    @F.pandas_udf("int")
    def align_score(p, s, match=None, mismatch=None, gap=None):
        import pandas as pd

        frame = pd.DataFrame({"p": p, "s": s, "match": 3 if match is None else match, "mismatch": -3 if mismatch is None else mismatch, "gap": 2 if gap is None else gap})
        out = np.zeros(len(frame), np.int32)
        told = frame[(frame["p"].fillna("") != "") & (frame["s"].fillna("") != "")]
        for (pattern, *costs), rows in told.groupby(["p", "match", "mismatch", "gap"]):  # all texts of one pattern at a time
            texts, place = [code_points(t) for t in rows["s"]], frame.index.get_indexer(rows.index)
            for _, some in _runs({pattern: list(range(len(texts)))}, texts):
                size = np.array([len(texts[r]) for r in some])
                first = size.cumsum() - size
                for _, h in stripes(code_points(pattern), np.concatenate([texts[r] for r in some]), first, Scoring(*map(int, costs))):
                    out[place[some]] = np.maximum(out[place[some]], np.maximum.reduceat(h.max(axis=0), first))
        return pd.Series(out, dtype="int32")

    spark.udf.register("align_score", align_score)
    for name, kind, alignments in (("align_hits", HITS, False), ("align", ALIGNMENTS, True)):
        fields = ", ".join(f"c.{c.split()[0]}" for c in kind.split(", "))
        spark.udf.register(f"{name}_list", _lists(kind, alignments))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(p STRING, s STRING, k INT, match INT DEFAULT 3, mismatch INT DEFAULT -3, gap INT DEFAULT 2) RETURNS TABLE({kind}) RETURN SELECT {fields} FROM (SELECT explode({name}_list(p, s, k, match, mismatch, gap)) AS c)")
    hits = "pattern_id long, seq_id long, rank int, score int, x_end int, y_end long"
    spark.udtf.register("align_hits_of", F.arrow_udtf(HitsOf, returnType=hits))
    spark.udtf.register("align_of", F.arrow_udtf(AlignmentsOf, returnType=hits + ", x_start int, y_start long, aligned_p string, aligned_s string"))
