"""Local alignment of a set of patterns against a table of sequences.

Patterns are sent to all tasks as long as their characters are at most
SENT_CHARS, which is checked; a larger set is aligned a block of that size at a
time, each against all sequences. Sequences are cut into chunks that carry on
their left as many characters as an alignment can span, so chunks are filled on
their own and every cell of a chunk's core has the value that it has in the
whole matrix. Chunks that lie in a few partitions, as those of one long sequence
do, are dealt out anew. A matrix is filled in stripes of rows, so memory grows
with neither the pattern nor the number of sequences. Tasks keep the k best
cells of each pattern; a window keeps the k best of all. Columns that can't
reach a task's k-th best so far, by the runs of the pattern's symbols that stand
before them, are not filled, unless an alignment that can may lie on them. Where alignments are
wanted, a hit carries the stretch of its sequence that the walk back needs, so
sequences are read once and never shuffled for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kernels import Bound, Grams, Seeds, bounded_best, code_points, fill, striped_best, stripes, trace_back
from ..functions.native import conform
from ..functions.scoring import Scoring
from ..plans.tables import written
from . import tiles

CORE = 65_536
#: Characters of chunks that are filled side by side, about.
COLUMNS = 32_768
#: Cells that cells() holds at once, about.
CELLS = 2_000_000
#: Characters of patterns that are sent to all tasks at once, and that are written into a plan.
SENT_CHARS, LITERAL_CHARS = 16_000_000, 400_000
#: Hits that are sent to all tasks at most.
MOST_SENT = 100_000
#: Characters of a task's chunks where chunks are dealt out anew, about.
DEALT_CHARS = 32 << 20


def _ordered(*first: str) -> list[Column]:
    return [F.desc("score"), *[F.asc(c) for c in first], F.asc("y_end"), F.asc("x_end")]


def chunks(seqs: DataFrame, core: int, halo: int) -> DataFrame:
    """(seq_id, chunk_idx, start, skip, part): cores of `core` characters with up to `halo` characters before them.

    start is the place of part's first character, skip the length of its halo.
    """
    n = F.greatest(F.ceil(F.length("seq") / core), F.lit(1)).cast("int")
    cut = seqs.where(F.length("seq") > 0).select("seq_id", "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_idx"))
    begin = F.col("chunk_idx").cast("long") * core
    start = F.greatest(begin - halo, F.lit(0))
    return cut.select("seq_id", "chunk_idx", start.alias("start"), (begin - start).cast("int").alias("skip"), F.substring("seq", (start + 1).cast("int"), (begin - start + core).cast("int")).alias("part"))


def blocks(seqs: DataFrame) -> DataFrame:
    """(seq_id, block, start_ind, end_ind): blocks as wide as the root of the length, ends inclusive."""
    width = F.floor(F.sqrt(F.length("seq"))).cast("long")
    n = F.length("seq").cast("long")
    some = seqs.where(F.length("seq") > 0).select("seq_id", n.alias("n"), width.alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / width).cast("long") - 1)).alias("block"))
    return some.select("seq_id", "block", (F.col("block") * F.col("b")).alias("start_ind"), (F.least((F.col("block") + 1) * F.col("b"), "n") - 1).alias("end_ind"))


def sent_patterns(patterns: DataFrame, most: int | None = None) -> list[tuple[int, str]]:
    """Patterns by id, for all tasks; empty and null ones have no hits and are left out. Refused where they have more than `most` (SENT_CHARS) characters."""
    most = SENT_CHARS if most is None else most
    some = patterns.where(F.length("seq") > 0)
    total = some.agg(F.sum(F.length("seq"))).first()[0] or 0
    if total > most:
        raise ValueError(f"the patterns have {total} characters; {most} are the most that are sent to all tasks")
    return [(r[0], r[1]) for r in some.select(F.col("pattern_id").cast("long"), "seq").orderBy("pattern_id", "seq").toLocalIterator()]


def with_patterns(df: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every row with every pattern (columns pattern_id, p), the patterns as literals of the plan: a set of checked size."""
    listed = [F.struct(F.lit(i).cast("long").alias("pattern_id"), F.lit(p).alias("p")) for i, p in sent_patterns(patterns, LITERAL_CHARS)]
    if not listed:
        return df.where("false").select("*", F.lit(None).cast("long").alias("pattern_id"), F.lit(None).cast("string").alias("p"))
    return df.select("*", F.inline(F.array(*listed)))


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end] <= most):
            total += sizes[end]
            end += 1
        yield at, end
        at = end


def _spans(core: int, scoring: Scoring, twice: bool) -> Column:
    """0 for patterns whose halo is at most a quarter of the core, then a number for each further factor of 4."""
    reach = F.length("seq") + F.ceil(F.length("seq") * scoring.most / scoring.gap)
    return F.greatest(F.ceil(F.log(4.0, reach * (8 if twice else 4) / core)), F.lit(0)).cast("int")


def pattern_blocks(patterns: DataFrame, core: int, scoring: Scoring, twice: bool) -> Iterator[tuple[bool, list[tuple[int, str]]]]:
    """(whether it is one of many, patterns): blocks of like length, each of at most SENT_CHARS characters (or one pattern), one after the other."""
    some = patterns.where(F.length("seq") > 0).select(F.col("pattern_id").cast("long").alias("pattern_id"), "seq", _spans(core, scoring, twice).alias("span"))
    total = some.agg(F.sum(F.length("seq"))).first()[0] or 0
    if total <= SENT_CHARS:
        found: dict[int, list[tuple[int, str]]] = {}
        for r in some.orderBy("pattern_id", "seq").toLocalIterator():
            found.setdefault(r.span, []).append((r.pattern_id, r.seq))
        for span in sorted(found):
            yield False, found[span]
        return
    n = -(-2 * total // SENT_CHARS)
    dealt = written(some.withColumn("block", F.pmod(F.xxhash64("pattern_id"), F.lit(n)).cast("int")), "patterns")
    for span, block in sorted(tuple(r) for r in dealt.select("span", "block").distinct().collect()):
        held, room = [], SENT_CHARS
        for r in dealt.where((F.col("span") == span) & (F.col("block") == block)).orderBy("pattern_id", "seq").toLocalIterator():
            if held and len(r.seq) > room:
                yield True, held
                held, room = [], SENT_CHARS
            held.append((r.pattern_id, r.seq))
            room -= len(r.seq)
        yield True, held


def dealt_out(seqs: DataFrame, cut: DataFrame, keys: tuple[str, ...] = ("seq_id", "chunk_idx")) -> DataFrame:
    """cut, the chunks of seqs (or other rows of them), dealt out anew by keys where one partition holds far more characters than its share."""
    slots = seqs.sparkSession.sparkContext.defaultParallelism
    held = seqs.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.length("seq")).alias("n"))
    most, total = held.agg(F.max("n"), F.sum("n")).first()
    if not total or most * slots <= 2 * total:
        return cut
    return cut.repartition(max(2 * slots, -(-total // DEALT_CHARS)), *keys)


class _Best:
    """The k best hits of a pattern that a task has met, by score, then place."""

    def __init__(self, k: int) -> None:
        self.k, self.rows, self.least = k, [], 1

    def add(self, rows: list[tuple], stretch: Callable[[tuple], tuple]) -> None:
        """rows: (-score, whether seq_id isn't null, seq_id, y_end, x_end, chunk_idx, and what stretch needs), stretched only if they stay."""
        new = sorted([(r, False) for r in rows] + [(r, True) for r in self.rows], key=lambda x: x[0][:6])[: self.k]
        self.rows = [r if done else r[:6] + stretch(r) for r, done in new]
        if len(self.rows) == self.k:
            self.least = max(1, -self.rows[-1][0])


def _seeded(seeds: Seeds, pattern: np.ndarray, texts: list[np.ndarray], skip: list[int], k: int, scoring: Scoring) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What striped_best finds in texts that lie end to end: by the pattern's runs where they tell enough, else with all rows filled."""
    size = np.array(list(map(len, texts)))
    first = size.cumsum() - size
    found, rest = {}, []
    for n, text in enumerate(texts):
        cells = seeds.best(text, k, skip[n]) if 8 * len(text) <= len(pattern) else None
        if cells is None:
            rest.append(n)
        else:
            found[n] = (cells[0], cells[1] + first[n], cells[2])
    if rest:
        text, segment = np.concatenate([texts[n] for n in rest]), np.repeat(np.arange(len(rest)), size[rest])
        begins = size[rest].cumsum() - size[rest]
        inner = np.arange(len(text)) - begins[segment]
        x, y, score = striped_best(stripes(pattern, text, begins, scoring), segment, k, False, 1, inner < np.array(skip)[rest][segment] if any(skip) else None)
        for n, r in enumerate(rest):
            of = segment[y] == n
            found[r] = (x[of], inner[y[of]] + first[r], score[of])
    return tuple(np.concatenate([found[n][c] for n in range(len(texts))]) for c in range(3))


def chunk_hits(cut: DataFrame, patterns: list[tuple[int, str]], k: int, scoring: Scoring, per_pair: bool = False, ties: bool = False, stretches: bool = False) -> DataFrame:
    """(pattern_id, seq_id, chunk_idx, score, x_end, y_end): of each pattern the k best cells of a task's chunk cores, or with per_pair or ties of each core.

    With stretches also (begin, stretch): twice an alignment's span up to the cell.
    """
    kind = dict(cut.dtypes)["seq_id"]
    shipped = cut.sparkSession.sparkContext.broadcast(patterns)
    names = ["pattern_id", "seq_id", "chunk_idx", "score", "x_end", "y_end", "begin", "stretch"][: 8 if stretches else 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = [(pid, code_points(p)) for pid, p in shipped.value]
        kept = {} if per_pair or ties else {pid: _Best(k) for pid, _ in points}
        coded = [(pid, p, Bound(p, scoring) if kept else None, Seeds(p, scoring) if not kept and not ties and Seeds.serve(p, scoring) else None) for pid, p in points]
        id_type = None

        def told(columns: list[list], id_type: pa.DataType) -> pa.RecordBatch:
            kinds = [pa.int64(), id_type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            sizes = pc.utf8_length(batch.column(4)).to_pylist()
            ids, idx, start, skip = (batch.column(c).to_pylist() for c in range(4))
            for a, b in _groups(sizes, COLUMNS):
                texts = [code_points(t) for t in batch.column(4).slice(a, b - a).to_pylist()]  # of a group, not of all that has come in
                text = np.concatenate(texts)
                size = np.array(sizes[a:b])
                first = size.cumsum() - size
                segment = np.repeat(np.arange(b - a), size)
                halo = (np.arange(len(text)) - first[segment] < np.array(skip[a:b])[segment]) if any(skip[a:b]) else None
                pairs, grams = scoring.pairs(text), Grams(text)
                for pid, pattern, bound, seeds in coded:
                    reach = 2 * scoring.reach(len(pattern))
                    of = kept.get(pid)
                    if of:
                        x, y, score, _ = bounded_best(pattern, bound, grams, first, segment, k, scoring, of.least, halo, pairs)
                    elif seeds:
                        x, y, score = _seeded(seeds, pattern, texts, skip[a:b], k, scoring)
                    else:
                        x, y, score = striped_best(stripes(pattern, text, first, scoring, pairs=pairs), segment, k, ties, 1, halo)
                    if not len(x):
                        continue
                    owner = segment[y] + a
                    inner = y - first[owner - a]

                    def stretch(at: int, end: int, reach: int = reach, texts: list[np.ndarray] = texts, a: int = a) -> tuple[int, str]:
                        lo = max(end - reach + 1, 0)
                        return start[at] + lo, texts[at - a][lo : end + 1].tobytes().decode("utf-32-le")

                    found = list(zip(score.tolist(), x.tolist(), owner.tolist(), inner.tolist(), strict=True))
                    if of:
                        of.add([(-v, ids[o] is not None, ids[o], start[o] + i, r, idx[o], o, i) for v, r, o, i in found], lambda r: stretch(r[6], r[7]) if stretches else ())
                        continue
                    columns = [[pid] * len(found), [ids[o] for _, _, o, _ in found], [idx[o] for _, _, o, _ in found], [v for v, *_ in found], [r for _, r, _, _ in found], [start[o] + i for _, _, o, i in found]]
                    if stretches:
                        columns += map(list, zip(*(stretch(o, i) for _, _, o, i in found), strict=True))
                    yield told(columns, id_type)
        for pid, of in kept.items():
            if of.rows:
                rows = [(pid, r[2], r[5], -r[0], r[4], r[3], *r[6:]) for r in of.rows]
                yield told(list(map(list, zip(*rows, strict=True))), id_type)

    schema = f"pattern_id long, seq_id {kind}, chunk_idx int, score int, x_end int, y_end long" + (", begin long, stretch string" if stretches else "")
    return cut.mapInArrow(run, schema)


def best(hits: DataFrame, k: int, per_pair: bool = False, ties: bool = False) -> DataFrame:
    """The k best hits of each pattern (or of each pattern and sequence), numbered; with ties all that equal the k-th."""
    if per_pair:
        w = W.partitionBy("pattern_id", "seq_id").orderBy(*_ordered())
    else:
        w = W.partitionBy("pattern_id").orderBy(*_ordered("seq_id"))
    if ties:
        w = W.partitionBy(*(["pattern_id", "seq_id"] if per_pair else ["pattern_id"])).orderBy(F.desc("score"))
    return hits.withColumn("rank", (F.rank() if ties else F.row_number()).over(w)).where(F.col("rank") <= k)


def align_hits(seqs: DataFrame, patterns: DataFrame, k: int, scoring: Scoring = Scoring(), per_pair: bool = False, ties: bool = False, core: int = CORE, stretches: bool = False) -> DataFrame:
    """(pattern_id, seq_id, chunk_idx, score, x_end, y_end, rank): the k best cells, 0-based ends, ordered by score, then place.

    Only positive scores are hits; empty and null sequences and patterns have none; seq_id must be unique.
    """
    if scoring.unknown != "free":
        seqs = seqs.withColumn("seq", conform(F.col("seq"), scoring))
    return align_chunks(lambda n, halo: dealt_out(seqs, chunks(seqs, n, halo)), patterns, k, scoring, per_pair, ties, core, stretches)


def align_chunks(read: Callable[[int, int], DataFrame], patterns: DataFrame, k: int, scoring: Scoring = Scoring(), per_pair: bool = False, ties: bool = False, core: int = CORE, stretches: bool = False) -> DataFrame:
    """align_hits over chunks that read(core, halo) gives, for sequences that no row could hold.

    Symbols of the chunks are taken as they are.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    patterns = patterns.withColumn("seq", conform(F.col("seq"), scoring))

    def cut(reach: int) -> DataFrame:
        halo = reach * (2 if stretches else 1)
        return read(max(core, 4 * halo), halo)

    out = None
    for many, block in pattern_blocks(patterns, core, scoring, stretches):
        found = chunk_hits(cut(scoring.reach(max(len(p) for _, p in block))), block, k, scoring, per_pair, ties, stretches)
        found = written(found, "hits") if many else found
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = dict(cut(0).dtypes)["seq_id"]
        schema = f"pattern_id long, seq_id {kind}, chunk_idx int, score int, x_end int, y_end long" + (", begin long, stretch string" if stretches else "")
        out = patterns.sparkSession.createDataFrame([], schema)
    return best(out, k, per_pair, ties)


def _walked_back(hits: DataFrame, scoring: Scoring, names: list[str]) -> DataFrame:
    """hits with their pattern p, and the stretch of their sequence from begin on, with what the walk back tells."""

    @F.pandas_udf("x_start int, y_start long, aligned_p string, aligned_s string")
    def walked(p, part, x, y, begin):
        import pandas as pd

        rows = []
        for pattern, text, a, b, o in zip(p, part, x, y, begin, strict=True):
            i, j, ap, as_ = trace_back(pattern, text, int(a), int(b - o), scoring)
            rows.append((i, o + j, ap, as_))
        return pd.DataFrame(rows, columns=["x_start", "y_start", "aligned_p", "aligned_s"])

    return hits.withColumn("w", walked("p", "stretch", "x_end", "y_end", "begin")).select(*names, "w.*")


def trace(hits: DataFrame, seqs: DataFrame, patterns: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """hits with x_start, y_start, aligned_p and aligned_s, for hits from elsewhere: each hit's own stretch of its sequence is filled again and walked back.

    The stretch reaches twice an alignment's span to the left, so every cell that
    the walk looks at is exact. Few hits are sent to where the sequences are;
    sequences are shuffled only for more than MOST_SENT hits.
    """
    if scoring.unknown != "free":
        seqs, patterns = (df.withColumn("seq", conform(F.col("seq"), scoring)) for df in (seqs, patterns))
    span = 2 * (F.length("p") + F.ceil(F.length("p") * scoring.most / scoring.gap)).cast("long")
    named = written(hits.join(patterns.select("pattern_id", F.col("seq").alias("p")), "pattern_id"), "hits")
    few = named.limit(MOST_SENT + 1).count() <= MOST_SENT
    met = seqs.select("seq_id", "seq").join(F.broadcast(named) if few else named, "seq_id")
    begin = F.greatest(F.col("y_end") - span + 1, F.lit(0).cast("long"))
    cut = met.withColumn("begin", begin).withColumn("stretch", F.substring("seq", (F.col("begin") + 1).cast("int"), (F.col("y_end") - F.col("begin") + 1).cast("int"))).drop("seq")
    return _walked_back(cut, scoring, hits.columns)


def align(seqs: DataFrame, patterns: DataFrame, k: int, scoring: Scoring = Scoring(), per_pair: bool = False, core: int = CORE) -> DataFrame:
    """align_hits with their alignments; the stretches that the walk back needs come with the hits.

    Long patterns meet long sequences in tiles.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if not patterns.where(F.length("seq") > tiles.TILE).isEmpty() and not seqs.where(F.length("seq") > tiles.TILE).isEmpty():
        seqs, patterns = (df.withColumn("seq", conform(F.col("seq"), scoring)) for df in (seqs, patterns))
        (long_s, short_s), (long_p, short_p) = (((df.where(F.length("seq") > tiles.TILE), df.where(F.length("seq") <= tiles.TILE)) for df in (seqs, patterns)))
        found = tiles.align_long(long_s, long_p, k, scoring, per_pair)
        for s, p in ((short_s, patterns), (long_s, short_p)):
            found = found.unionByName(_align_chunked(s, p, k, scoring, per_pair, core).select(*found.columns))
        return best(found, k, per_pair)
    return _align_chunked(seqs, patterns, k, scoring, per_pair, core)


def _align_chunked(seqs: DataFrame, patterns: DataFrame, k: int, scoring: Scoring, per_pair: bool, core: int) -> DataFrame:
    hits = align_hits(seqs, patterns, k, scoring, per_pair, core=core, stretches=True)
    named = hits.join(patterns.select("pattern_id", conform(F.col("seq"), scoring).alias("p")), "pattern_id")
    return _walked_back(named, scoring, [c for c in hits.columns if c not in ("begin", "stretch")])


def boundary(seqs: DataFrame, patterns: DataFrame, right: bool, scoring: Scoring = Scoring()) -> DataFrame:
    """(pattern_id, seq_id, edge): the last column (right) or the last row of every matrix, what the next piece of either side needs."""
    kind = dict(seqs.dtypes)["seq_id"]
    shipped = seqs.sparkSession.sparkContext.broadcast([(i, code_points(p)) for i, p in sent_patterns(patterns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.utf8_length(batch.column(1)).to_pylist()
            for pid, pattern in shipped.value:
                for a, b in _groups(sizes, COLUMNS):
                    size = np.array(sizes[a:b])
                    ends = size.cumsum()
                    edges, bottom = [], np.zeros(0, np.int32)
                    for _, h in stripes(pattern, code_points("".join(batch.column(1).slice(a, b - a).to_pylist())), ends - size, scoring):
                        edges.append(h[:, ends - 1])
                        bottom = h[-1]
                    cells = np.concatenate(edges).T.ravel() if right else bottom
                    offsets = np.append(0, np.full(b - a, len(pattern)).cumsum() if right else ends).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, pid, np.int64)), batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(cells)))], names=["pattern_id", "seq_id", "edge"])

    return seqs.where(F.length("seq") > 0).select("seq_id", "seq").mapInArrow(run, f"pattern_id long, seq_id {kind}, edge array<int>")


def statistics(alignments: DataFrame) -> DataFrame:
    """alignments with n_match, n_mismatch and n_gap, counted over the columns of the two strings."""
    chars = F.arrays_zip(F.split("aligned_p", "").alias("p"), F.split("aligned_s", "").alias("s"))

    def count(test) -> Column:
        return F.size(F.filter(chars, test)).cast("int")

    gap = count(lambda c: (c["p"] == "-") | (c["s"] == "-"))
    match = count(lambda c: (c["p"] == c["s"]) & (c["p"] != "-"))
    return alignments.withColumn("n_match", match).withColumn("n_gap", gap).withColumn("n_mismatch", F.length("aligned_p") - F.col("n_match") - F.col("n_gap"))


def cells(seqs: DataFrame, patterns: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """(pattern_id, seq_id, i, j, h, dir): every cell, 1-based; dir 0 stop, 1 diagonal, 2 up, 3 left. For short sequences and checks."""
    block = [(i, code_points(p)) for i, p in sent_patterns(patterns)]
    kind = dict(seqs.dtypes)["seq_id"]
    shipped = seqs.sparkSession.sparkContext.broadcast(block)
    left_first = scoring.tie_order == "diag_left_up"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.utf8_length(batch.column(1)).to_pylist()
            for pid, pattern in shipped.value:
                m = len(pattern)
                for a, b in _groups(sizes, max(1, CELLS // m)):
                    text, size = code_points("".join(batch.column(1).slice(a, b - a).to_pylist())), np.array(sizes[a:b])
                    first = size.cumsum() - size
                    h = fill(pattern, text, first, scoring)
                    pad = np.zeros((m + 1, len(text) + 1), np.int32)
                    pad[1:, 1:] = h
                    corner, up, left = pad[:-1, :-1].copy(), pad[:-1, 1:], pad[1:, :-1].copy()
                    corner[:, first] = 0
                    left[:, first] = 0
                    pairs = scoring.pairs(text)
                    met = np.stack([pairs[c] for c in pattern.tolist()])
                    ways = [(left - scoring.gap == h, 3), (up - scoring.gap == h, 2)]
                    way = np.zeros_like(h)
                    for ok, d in ways[::-1] if left_first else ways:
                        way[ok] = d
                    way[corner + met == h] = 1
                    way[h == 0] = 0
                    n = len(text)
                    at = pa.array(np.tile(np.repeat(np.arange(a, b), size), m))
                    inner = np.arange(n) - np.repeat(first, size) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m * n, pid, np.int64)), batch.column(0).take(at), pa.array(np.repeat(np.arange(1, m + 1), n).astype(np.int32)), pa.array(np.tile(inner, m).astype(np.int32)), pa.array(h.ravel()), pa.array(way.ravel().astype(np.int32))], names=["pattern_id", "seq_id", "i", "j", "h", "dir"])

    return seqs.where(F.length("seq") > 0).select("seq_id", "seq").mapInArrow(run, f"pattern_id long, seq_id {kind}, i int, j int, h int, dir int")
