"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens. Each window of a fixed number of tokens is
filled by deficit round-robin: a source's deficit grows by its share of the
window, it is served in whole granules while its deficit lasts, and what is
left over or borrowed is carried to the next window. Over one turn of the
schedule (64 windows) all deficits return to zero, so the turn repeats, and the
deficits at any window, hence at any partition's start, follow from the window
number: partitions need not be packed one after the other. Where a source ends,
the turn is planned anew for those that are left, then with shorter turns (8
windows, 1 window), and the last tokens of every source are laid end to end.
The last window is cut at powers of two, so nothing needs padding.

A document's place in its queue is the tokens of its source in earlier
partitions plus those before it in its own: the only figures that are gathered
are one sum per (partition, source).

A source whose share of the mixture is below least_share (a granule in four
windows) cannot be in every window. All such sources are one queue with the sum
of their shares, and are served in it by deficit round-robin over whole
documents: a document's turn comes when its source's deficit covers it, that is
in the order of (tokens of its source up to its end) / share. Spark sorts them by
that, over as many partitions as it takes. So 1 / least_share rows at most go to
the driver, and any number of sources is mixed by the same rule.

Edge cases: null text is empty and still has its end token; null sources are a
queue of their own; empty tables give no pieces; repeated rows are packed each;
documents longer than a window are cut; extra columns are ignored.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, held, release, trim, write_table

WINDOW = 4096
GRANULE = 64
TURNS = (64, 8, 1)
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
CACHE = 150_000
NO_SOURCE, TAIL = "\0none", "\0tail"
LEAST_SHARE = 1 / 256


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def struct_packer(kind: type) -> Callable[[list[int]], bytes]:
    code = np.dtype(kind).char
    return lambda ids: array(code, ids).tobytes()


def _byte_letter(byte: int) -> str:
    """The letter that stands for a byte in a byte-level vocabulary: itself where printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return chr(byte) if byte in shown else chr(0x100 + sum(b not in shown for b in range(byte)))


class WordIds(dict):
    """word -> its ids as bytes, two or four per id; two bounded generations, the older dropped when the younger is full.

    The tokenizer drops white space and never looks across it, so a text's ids
    are those of its words. Words are cut at ASCII white space only, which is
    white space to the tokenizer whatever surrounds it, and between letters or
    digits and punctuation, where the tokenizer cuts as well. New words go to it
    together, between separators; words of lower-case Latin letters, which its
    normaliser and splitter leave as they are, go straight to its model.
    Letters A-Z are lowered first where no combining mark could compose with them.
    """

    LOWER = np.arange(256, dtype=np.uint8)
    LOWER[65:91] += 32
    KIND = np.zeros(256, np.uint8)
    KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
    KIND[list(b".,!?;:*#$%&")] = 2
    SEPARATOR = "\x01"
    TOGETHER = 20_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.pack = struct_packer(self.kind)
        self.bytewise = {c: "".join(map(_byte_letter, chr(c).encode())) for c in range(0x80, 0x250)}
        self.old: dict[str, bytes] = {}
        self.mark = self.encode(self.SEPARATOR)
        if len(self.mark) != 1:
            raise ValueError("the separator is not one id")

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of words, many at once; where a word holds the separator's id, each goes alone."""
        out: dict[str, bytes] = {}
        between = f" {self.SEPARATOR} "
        for at in range(0, len(new), self.TOGETHER):
            words = new[at : at + self.TOGETHER]
            ids = self.encode(between.join(words))
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) != len(words) - 1:
                out.update((w, self.encode(w).tobytes()) for w in words)
                continue
            size, raw = ids.itemsize, ids.tobytes()
            starts = ((np.concatenate(([0], cuts + 1))) * size).tolist()
            stops = (np.append(cuts, len(ids)) * size).tolist()
            out.update((w, raw[a:b]) for w, a, b in zip(words, starts, stops, strict=True))
        return out

    def rows(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        found = list(map(self.get, words))
        missing = [k for k, x in enumerate(found) if x is None]
        if len(self) + len(missing) > CACHE:
            self.old = dict(self)
            self.clear()
        old, plain, rest = self.old.get, self.tokenizer.model.tokenize, []
        for k in missing:
            w = words[k]
            x = old(w)
            if x is None:
                if not w.isalpha() or not w.islower():
                    rest.append(k)
                    continue
                if w.isascii():
                    x = self.pack([t.id for t in plain(w)])
                elif max(w) < "\u0250" and w.lower() == w:
                    x = self.pack([t.id for t in plain(w.translate(self.bytewise))])
                else:
                    rest.append(k)
                    continue
            found[k] = self[w] = x
        known = self.learn([words[k] for k in rest])
        for k in rest:
            found[k] = self[words[k]] = known[words[k]] if words[k] else b""
        return found

    def parted(self, texts: pa.Array) -> pa.Array:
        """The texts in lower case (A-Z), with a space between a letter or digit and the punctuation that follows it."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not ((raw == 0xCC) | (raw == 0xCD)).any():
            raw = self.LOWER[raw]
        kind = self.KIND[raw]
        cut = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
        out = np.full(len(raw) + len(cut), 32, np.uint8)
        stay = np.ones(len(out), bool)
        stay[cut + np.arange(len(cut))] = False
        out[stay] = raw
        moved = (offsets + np.searchsorted(cut, offsets)).astype(np.int32)
        return pa.StringArray.from_buffers(len(texts), pa.py_buffer(moved.tobytes()), pa.py_buffer(out.tobytes()))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each); nulls are empty."""
        if not len(texts):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        split = pc.ascii_split_whitespace(self.parted(pc.fill_null(texts.cast(pa.string()), "")))
        coded = split.flatten().dictionary_encode()
        rows = self.rows(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // self.kind().itemsize
        pool = np.frombuffer(b"".join(rows), self.kind)
        which = coded.indices.to_numpy()
        n = sizes[which]
        ends = np.concatenate(([0], n.cumsum()))
        ids = pool[np.repeat((np.concatenate(([0], sizes.cumsum()))[:-1])[which] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        return ids, np.diff(ends[bounds])


def word_ids(path: str) -> WordIds:
    """One table for each worker process; its words serve all tasks that the process runs."""
    return held(f"words {path}", lambda: WordIds(path))


def tokenise(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(part, source, start, n, doc_id, ids): each document's ids with its place among its partition's tokens of its source."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("source"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        end = np.array([end_id], words.kind).tobytes()
        at: dict[str, int] = {}
        for whole in batches:
            step = max(1, int(whole.num_rows * (2 << 20) / max(whole.nbytes, 1)))
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                flat, sizes = words.texts(batch.column(1))
                raw, size = flat.tobytes(), flat.itemsize
                stops = (sizes.cumsum() * size).tolist()
                ids = [raw[a:b] + end for a, b in zip([0, *stops], stops, strict=False)]
                n = (sizes + 1).tolist()
                starts = []
                for q, count in zip(batch.column(2).to_pylist(), n, strict=True):
                    starts.append(at.get(q, 0))
                    at[q] = starts[-1] + count
                yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(2), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), batch.column(0), pa.array(ids, pa.binary())], names=["part", "source", "start", "n", "doc_id", "ids"])
        trim()

    return write_table(slim.mapInArrow(run, "part int, source string, start long, n long, doc_id long, ids binary"), "tokens")


def served_in_turn(rows: DataFrame) -> DataFrame:
    """Documents of small sources (source, at, rate, n, doc_id, ids) as one queue: (queue, at, n, doc_id, ids), in the order of (at + n) / rate."""
    turns = rows.withColumn("turn", (F.col("at") + F.col("n")) / F.col("rate"))
    dealt = turns.repartitionByRange("turn", "source", "at").sortWithinPartitions("turn", "source", "at")
    slim = dealt.select(F.spark_partition_id().alias("part"), "n", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            n = np.asarray(batch.column(1))
            ends = n.cumsum() + done
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - n), *batch.columns[1:]], names=["part", "start", "n", "doc_id", "ids"])
            done = int(ends[-1]) if len(ends) else done

    tail = write_table(slim.mapInArrow(run, "part int, start long, n long, doc_id long, ids binary"), "tail")
    sums = tail.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each partition
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return tail.join(F.broadcast(bases), "part").select(F.lit(TAIL).alias("queue"), (F.col("base") + F.col("start")).alias("at"), "n", "doc_id", "ids")


def shares(weights: dict[str, float], units: int) -> dict[str, int]:
    """Whole units by weight, largest remainders first, one at least for each."""
    total = sum(weights.values())
    exact = {s: w / total * units for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    short = units - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, short)]:
        out[s] += 1
    while short < 0:
        most = max(out, key=lambda s: (out[s], s))
        cut = min(-short, out[most] - 1)
        out[most] -= cut
        short += cut
    return out


def turn(quota: dict[str, int], windows: int, slots: int) -> dict[str, np.ndarray]:
    """Granules of each source in each window of a turn, by deficit round-robin.

    A deficit is counted in granules times windows. After the last window every
    source has had its quota exactly and all deficits are zero.
    """
    q = np.fromiter(quota.values(), np.int64, len(quota))
    deficit = np.zeros(len(q), np.int64)
    given = np.zeros((len(q), windows), np.int64)
    for w in range(windows):
        deficit += q
        due = np.maximum(0, deficit // windows)
        take = np.clip(slots - (due.cumsum() - due), 0, due)  # in the order of the sources, while the window has room
        deficit -= take * windows
        left = slots - int(take.sum())
        first = np.argsort(-deficit, kind="stable")[:left]
        deficit[first] -= windows
        take[first] += 1
        given[:, w] = take
    return dict(zip(quota, given, strict=True))


@dataclass
class Stretch:
    """Where a stretch of one queue goes: turns from window `first`, or fixed slots at the end."""

    queue_start: int
    queue_end: int
    first: int
    turn_windows: int
    turn_tokens: int
    window_end: np.ndarray  # tokens of this source up to and with each window of a turn
    offset: np.ndarray  # where its tokens start in each window of a turn


@dataclass
class Slot:
    queue_start: int
    queue_end: int
    sequence: int
    offset: int


def schedule(totals: dict[str, int], weights: dict[str, float] | None = None, window: int = WINDOW, granule: int = GRANULE) -> dict[str, list[Stretch | Slot]]:
    """For each queue, where its tokens go, in order. Weights default to the totals: the corpus's own mixture."""
    left = {s: n for s, n in sorted(totals.items()) if n > 0}
    done = dict.fromkeys(left, 0)
    plan: dict[str, list[Stretch | Slot]] = {s: [] for s in left}
    slots, first = window // granule, 0
    for windows in TURNS:
        active = {s for s in left if left[s] > 0}
        while active and len(active) <= slots * windows:
            share = {s: (weights.get(s, 0) if weights else left[s]) or 1e-9 for s in sorted(active)}
            quota = shares(share, slots * windows)
            turns = min(left[s] // (quota[s] * granule) for s in active)
            if not turns:
                active -= {s for s in active if left[s] < quota[s] * granule}
                continue
            given = turn(quota, windows, slots)
            grid = np.array([given[s] for s in given], np.int64) * granule
            ends, offsets = grid.cumsum(axis=1), grid.cumsum(axis=0) - grid
            for k, s in enumerate(given):
                size = quota[s] * granule
                plan[s].append(Stretch(done[s], done[s] + turns * size, first, windows, size, ends[k], offsets[k]))
                done[s] += turns * size
                left[s] -= turns * size
            first += turns * windows
            active = {s for s in active if left[s] > 0}
    rest = sum(left.values())
    room: list[tuple[int, int]] = []  # (sequence, tokens) of the last windows; the last is cut at powers of two
    while rest >= window:
        room.append((first, window))
        first, rest = first + 1, rest - window
    while rest:
        part = 1 << (rest.bit_length() - 1)
        room.append((first, part))
        first, rest = first + 1, rest - part
    used = 0
    for s in left:
        while left[s]:
            sequence, size = room[0]
            take = min(left[s], size - used)
            plan[s].append(Slot(done[s], done[s] + take, sequence, used))
            done[s], left[s], used = done[s] + take, left[s] - take, used + take
            if used == size:
                room.pop(0)
                used = 0
    return plan


def cut(plan: list[Stretch | Slot], start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(start in document, length, sequence, offset) of a document that lies at `start` in its queue."""
    lo, hi = 0, len(plan) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if plan[mid].queue_end <= start else (lo, mid)
    at, end = start, start + n
    while at < end:
        s = plan[lo]
        stop = min(end, s.queue_end)
        if isinstance(s, Slot):
            yield at - start, stop - at, s.sequence, s.offset + at - s.queue_start
            at = stop
        else:
            while at < stop:
                turns, y = divmod(at - s.queue_start, s.turn_tokens)
                w = int(np.searchsorted(s.window_end, y, "right"))
                begin = int(s.window_end[w - 1]) if w else 0
                take = min(int(s.window_end[w]) - y, stop - at)
                yield at - start, take, s.first + turns * s.turn_windows + w, int(s.offset[w]) + y - begin
                at += take
        lo += 1


def pack(docs: DataFrame, weights: dict[str, float] | None = None, path: str | None = None, end_id: int = END_ID, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, start, doc_tokens, sequence_id, offset, length, ids): every id of every document in exactly one piece; ids as little-endian 32-bit numbers.

    weights are the sources' shares of the mixture; a source without one has none until the others end. By default a source's tokens are its weight.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tokens = tokenise(docs, path or tokenizer_path(), end_id)
    sums = write_table(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "sums")
    totals = sums.groupBy("source").agg(F.sum("n").alias("n"))
    if weights is None:
        totals = totals.withColumn("weight", F.col("n").cast("double"))
    else:
        listed = spark.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0], "source string, weight double")
        totals = totals.join(listed, "source", "left").fillna(1e-9, ["weight"])
    totals = write_table(totals, "totals")
    n, mass = totals.agg(F.sum("n"), F.sum("weight")).first()
    own = {r.source: (r.n, r.weight) for r in totals.where(F.col("weight") >= least_share * (mass or 0)).collect()}  # 1 / least_share rows at most
    rest = (n or 0) - sum(x for x, _ in own.values())
    queues, share = {s: x for s, (x, _) in own.items()}, {s: w for s, (_, w) in own.items()}
    if rest:
        queues[TAIL], share[TAIL] = rest, max(1e-9, mass - sum(share.values()))
    plan = spark.sparkContext.broadcast(schedule(queues, share))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("part", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if rest:
        bases = bases.join(totals.select("source", F.col("weight").alias("rate")), "source")
    bases = write_table(bases, "bases")  # a row for each task and source: small enough to send while there are few of them
    at = tokens.join(F.broadcast(bases) if bases.count() <= 100_000 else bases, ["part", "source"]).withColumn("at", F.col("base") + F.col("start"))
    placed = at.select(F.col("source").alias("queue"), "at", "n", "doc_id", "ids")
    if rest:
        placed = placed.where(F.col("queue").isin(sorted(own))).unionByName(served_in_turn(at.where(~F.col("source").isin(sorted(own)))))
    schema = "doc_id long, start long, doc_tokens long, sequence_id long, offset long, length long, ids binary"
    out = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for queue, at, n, doc, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wide = ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                for start, length, sequence, offset in cut(plan.value[queue], at, n):
                    rows.append((doc, start, n, sequence, offset, length, wide[4 * start : 4 * (start + length)]))
                held += len(wide)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves, at most a window of ids each."""
    grouped = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return grouped.select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def piece_crc(pieces: DataFrame) -> DataFrame:
    """Replaces ids by ids_crc32, the CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op1_packing_drr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_crc(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
