"""Alignment of sequences that arrive in pieces, by Structured Streaming.

For each sequence the state holds the next piece's number, pieces that came
early (a map, so that a batch writes those that are new), the last column of
every pattern's matrix, the k best cells so far (a list), and, where alignments are wanted, as
much of its text as a walk back can need. A piece is filled from the column
before it, so nothing is read twice; late and repeated pieces are passed over.
Early pieces wait as long as it takes; a timer tells of sequences that wait
longer than they should, and drops nothing.

The k best of each pattern over all sequences are kept by two more stateful
steps behind the first: one for each pattern and a part of the sequences, which
passes on only what enters its own k best, and one for each pattern. The
stream's checkpoint makes a restarted query go on where the last one stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.kernels import code_points, striped_best, stripes, trace_back
from ..functions.scoring import Scoring
from ..operators.align import sent_patterns
from ..plans.tables import shared_dir

HIT = "seq_id long, pattern_id long, rank int, score int, x_end int, y_end long, pieces long"
ALIGNED = "x_start int, y_start long, aligned_p string, aligned_s string"
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of the sequences over which a pattern's best hits are gathered first.
SPREAD = 32
#: Characters of patterns that go with a stream's plan at most.
PLAN_CHARS = 4_000_000


class PieceCells(StatefulProcessor):
    """Fills a sequence's pieces in order and keeps the k best cells of every pattern."""

    def __init__(self, patterns, scoring: Scoring, k: int, alignments: bool, wait_ms: int | None, overall: bool = False) -> None:
        self.patterns, self.scoring, self.k, self.alignments, self.wait_ms, self.overall = patterns, scoring, k, alignments, wait_ms, overall

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = [(i, p, code_points(p)) for i, p in self.patterns]
        self.told_best: list[list[tuple]] = [[] for _ in self.known]  # the k best cells of each pattern that this task has told
        self.span = 2 * self.scoring.reach(max((len(p) for _, p, _ in self.known), default=0))
        self.cursor = handle.getValueState("cursor", "next long, length long")
        self.early = handle.getMapState("early", "piece long", "text string")
        self.columns = handle.getValueState("columns", "columns binary")
        self.hits = handle.getListState("hits", f"place int, score int, x_end int, y_end long, {ALIGNED}")
        self.tail = handle.getValueState("tail", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cursor, length = map(int, self.cursor.get() or (0, 0))
        waits = None  # whether pieces of earlier batches wait: looked up when it matters
        held: dict[int, str] = {}
        for frame in rows:
            for piece, text in zip(frame["piece"].tolist(), frame["text"].tolist(), strict=True):
                if piece >= cursor:
                    held.setdefault(int(piece), text or "")
        ready, at = [], cursor
        while True:
            if at not in held:
                waits = self.early.exists() if waits is None else waits
                if not waits or not self.early.containsKey((at,)):
                    break
                held[at] = self.early.getValue((at,))[0]
            elif waits is not False and self.early.exists() and self.early.containsKey((at,)):
                held[at] = self.early.getValue((at,))[0]  # what came first stays
            if waits and self.early.containsKey((at,)):
                self.early.removeKey((at,))
            ready.append(held.pop(at))
            at += 1
        for piece, text in held.items():
            if not self.early.containsKey((piece,)):
                self.early.updateValue((piece,), (text,))
        if self.wait_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if self.early.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        best = self.filled(key[0], ready, length)
        self.cursor.update((at, length + sum(map(len, ready))))
        yield self.told(key[0], best, at)

    def filled(self, seq_id: int, ready: list[str], length: int) -> list[list[tuple]]:
        """The k best cells of every pattern after these pieces, and the state with them; overall without those that k told ones of other sequences or this one surpass."""
        best: list[list[tuple]] = [[] for _ in self.known]
        for row in self.hits.get():
            best[int(row[0])].append((int(row[1]), int(row[2]), int(row[3]), *row[4:]))
        new = "".join(ready)
        if not new:
            return best
        text, raw = code_points(new), self.columns.get()
        flat = np.frombuffer(raw[0], np.int32) if raw else np.zeros(sum(len(p) + 1 for _, p, _ in self.known), np.int32)
        tail = (self.tail.get() or ("",))[0] if self.alignments else ""
        segment, pairs, at, edges, changed = np.zeros(len(text), np.int64), self.scoring.pairs(text), 0, [], False
        for n, (_, p, codes) in enumerate(self.known):
            edge = [np.zeros(1, np.int32)]

            def parts(codes=codes, left=flat[at : at + len(p) + 1], edge=edge) -> Iterator[tuple[int, np.ndarray]]:
                for row, h in stripes(codes, text, np.zeros(1, np.int64), self.scoring, left, pairs=pairs):
                    edge.append(h[:, -1].copy())
                    yield row, h

            least = best[n][-1][0] if len(best[n]) == self.k else 1
            if len(self.told_best[n]) == self.k:
                least = max(least, -self.told_best[n][-1][0])
            x, y, v = striped_best(parts(), segment, self.k, least=least)
            at += len(p) + 1
            edges += edge
            none = (None,) * 4
            found = sorted([*best[n], *((s, r, length + c, *none) for s, r, c in zip(v.tolist(), x.tolist(), y.tolist(), strict=True))], key=lambda c: (-c[0], c[2], c[1]))[: self.k]
            changed |= found != best[n]
            if self.overall:
                self.told_best[n] = sorted({*self.told_best[n], *((-c[0], seq_id, c[2], c[1]) for c in found)})[: self.k]
            best[n] = [self.walked(p, c, tail + new, length - len(tail)) if self.alignments and c[3] is None else c for c in found]
        self.columns.update((np.concatenate(edges).tobytes() if edges else b"",))
        if changed:
            self.hits.put([(n, *c) for n, cells in enumerate(best) for c in cells])
        if self.alignments:
            self.tail.update(((tail + new)[-self.span :],))
        return best

    def walked(self, p: str, cell: tuple, text: str, begin: int) -> tuple:
        """A cell with its alignment, from a text that begins at `begin`."""
        v, x, y = cell[:3]
        lo = max(0, y - begin - 2 * self.scoring.reach(len(p)) + 1)
        i, j, ap, as_ = trace_back(p, text[lo : y - begin + 1], x, y - begin - lo, self.scoring)
        return v, x, y, i, begin + lo + j, ap, as_

    def told(self, seq_id: int, best: list[list[tuple]], pieces: int) -> pd.DataFrame:
        rows = [(seq_id, self.known[n][0], rank, *c[: 7 if self.alignments else 3]) for n, cells in enumerate(best) for rank, c in enumerate(cells, 1)]
        names = ["seq_id", "pattern_id", "rank", "score", "x_end", "y_end", *(("x_start", "y_start", "aligned_p", "aligned_s") if self.alignments else ())]
        out = pd.DataFrame(rows, columns=names)
        out.insert(6, "pieces", pieces)
        return out.assign(waits_for=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Tells, once after each batch that left pieces behind, that the sequence still waits for one; they stay."""
        if self.early.exists():
            names = [c.split()[0] for c in (HIT + (", " + ALIGNED if self.alignments else "")).split(", ")]
            at = int((self.cursor.get() or (0, 0))[0])
            yield pd.DataFrame([{**dict.fromkeys(names), "seq_id": key[0], "pieces": at, "waits_for": at}])

    def close(self) -> None:
        pass


def _state_in_rocks(spark: SparkSession) -> None:
    """States of several variables need this provider; it writes what has changed, not all of a state."""
    if spark.conf.get(PROVIDER, None) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)


def align_stream(pieces: DataFrame, patterns: DataFrame, scoring: Scoring = Scoring(), k: int = 1, alignments: bool = False, wait_ms: int | None = None, overall: bool = False) -> DataFrame:
    """From a stream (seq_id, piece, text), after each batch the k best cells of every pattern in each sequence so far, and how many pieces they are from.

    Pieces are numbered from 0. Patterns are held by every task: a set of checked
    size. With alignments also where each begins and its two strings, as align()
    has them. waits_for is null but for sequences that have held early pieces for
    wait_ms: of them a row names the piece they wait for. With overall, what goes
    into best_of_stream with the same k: cells that k told ones surpass are left out.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = pieces.sparkSession
    _state_in_rocks(spark)
    known = sent_patterns(patterns, PLAN_CHARS)
    schema = HIT + (", " + ALIGNED if alignments else "") + ", waits_for long"
    some = pieces.select(F.col("seq_id").cast("long").alias("seq_id"), F.col("piece").cast("long").alias("piece"), "text").where("seq_id IS NOT NULL AND piece IS NOT NULL")
    return some.groupBy("seq_id").transformWithStateInPandas(PieceCells(known, scoring, k, alignments, wait_ms, overall), schema, "Append", "ProcessingTime" if wait_ms is not None else "None")


class BestHits(StatefulProcessor):
    """Keeps the k best of the hits it has met; tells those that have entered, or all k with the number of the change."""

    def __init__(self, k: int, names: list[str], schema: str, whole: bool) -> None:
        self.k, self.names, self.schema, self.whole = k, names, schema, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getListState("hits", self.schema)
        self.change = handle.getValueState("change", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = [self.names.index(c) for c in ("score", "seq_id", "y_end", "x_end")]
        place = lambda r: (-r[at[0]], r[at[1]], r[at[2]], r[at[3]])
        old = {place(r): tuple(r) for r in map(list, self.hits.get())}
        best = dict(old)
        for frame in rows:
            for r in frame[self.names].itertuples(index=False, name=None):
                best[place(r)] = r
            best = dict(sorted(best.items())[: self.k])
        if best.keys() == old.keys():
            return
        self.hits.put(list(best.values()))
        if not self.whole:
            fresh = pd.DataFrame([r for p, r in best.items() if p not in old], columns=self.names)
            fresh.insert(0, "pattern_id", key[0])
            yield fresh
            return
        n = int((self.change.get() or (0,))[0]) + 1
        self.change.update((n,))
        out = pd.DataFrame(list(best.values()), columns=self.names)
        out.insert(0, "pattern_id", key[0])
        out.insert(1, "rank", np.arange(1, len(out) + 1))
        yield out.assign(change=n)

    def close(self) -> None:
        pass


def best_of_stream(hits: DataFrame, k: int) -> DataFrame:
    """Of a stream of align_stream, whenever they change, the k best hits of each pattern over all sequences, and the number of the change."""
    _state_in_rocks(hits.sparkSession)
    kinds = dict(hits.dtypes)
    names = [c for c in hits.columns if c not in ("pattern_id", "rank", "pieces", "waits_for")]
    row = ", ".join(f"{c} {kinds[c]}" for c in names)
    some = hits.where("pattern_id IS NOT NULL").select("pattern_id", *names, F.pmod(F.xxhash64("seq_id"), F.lit(SPREAD)).cast("int").alias("part"))
    parted = some.groupBy("pattern_id", "part").transformWithStateInPandas(BestHits(k, names, row, False), f"pattern_id long, {row}", "Append", "None")
    return parted.groupBy("pattern_id").transformWithStateInPandas(BestHits(k, names, row, True), f"pattern_id long, rank int, {row}, change long", "Append", "None")


def latest(out: DataFrame) -> DataFrame:
    """Of what align_stream has told, each sequence's last word; of best_of_stream, each pattern's."""
    of, by = ("pattern_id", "change") if "change" in out.columns else ("seq_id", "pieces")
    told = out if by == "change" else out.where("waits_for IS NULL").drop("waits_for")
    last = told.groupBy(of).agg(F.max(by).alias("__last"))
    return told.join(last, of).where(F.col(by) == F.col("__last")).drop("__last").distinct()


def run_available(stream: DataFrame, name: str, where: str | None = None) -> DataFrame:
    """Runs a stream over what there is, into a Parquet table in the shared folder, and reads that table.

    Batches without data are left out: timers would ask for one after another
    without end; those that are due are told in the next batch with data.
    """
    spark: SparkSession = stream.sparkSession
    where = where or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, "false")
    try:
        query = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(idle, before)
    return spark.read.schema(stream.schema).parquet(f"{where}/out")
