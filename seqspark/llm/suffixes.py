"""Suffix-array dedup: removes every byte that a string of `span` bytes covers which also starts in an earlier document.

Suffixes are sorted where they can meet. Each window of `span` bytes is dealt by
its anchor, the k-gram of least hash in it (the leftmost of equals): equal
windows have equal anchors. Texts travel in shards of a few megabytes:

1. every shard tells the distinct anchors it has, as hashes dealt to buckets;
2. a bucket tells each shard which of them another document has as well;
3. a shard cuts the stretches of text around those anchors, its own copies
   folded, and deals them to buckets;
4. a bucket sorts the suffixes of its stretches to the span's depth by
   deep-shallow sorting: multikey quicksort over machine words to a shallow
   depth, then a blind trie for each group that still agrees. Suffixes that
   agree to the full depth are one string, and the bucket tells each shard of
   the strings that an earlier document than any of its own has;
5. a shard cuts the same stretches again, finds the intervals of its own texts
   that an earlier document covers, unites them and gives each document what is
   left.

The shards are a table bucketed by shard, so steps 3 and 5 read them in place;
what is shuffled are hashes, and each shard's different stretches once with
their least document: where and how often they stand never leaves the shard. An
anchor that very many texts hold (a licence line, a boiler-plate passage) is
dealt by single windows instead, each by its own
content, so no bucket gathers all of its contexts. Shards grow with the root of
the corpus, so that neither a window's shards nor rows of a shard for each
bucket become too many.

Edge cases: null and empty texts have no bytes; texts shorter than the span
keep all; documents of equal ids are not earlier than each other; null ids come
after all others; very long texts are cut over shards with the span's overlap;
repeated rows are returned each; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .common import bound_batches, release, write_table

SPAN = 50
GRAM = 24
SHALLOW = 24
SHARD_BYTES = 2 << 20
BUCKET_BYTES = 3 << 20
#: Texts under one anchor from which on its windows are dealt one by one: at most so many stretches of one anchor lie in a bucket.
HOT_TEXTS = 32_768
WINDOWS = 100_000
LAST = (1 << 63) - 1
_M = 0x9E3779B97F4A7C15
_BLOCK = 48_000


def gram_hashes(b: np.ndarray, k: int = GRAM) -> np.ndarray:
    """48-bit hashes of the k-grams that start at each byte, by doubling."""
    part, width, have, acc = b.astype(np.uint64) + np.uint64(1), 1, 0, None
    while True:
        if k & 1:
            if acc is None:
                acc, have = part, width
            else:
                m = len(part) - have
                acc = acc[:m] * np.uint64(pow(_M, width, 1 << 64)) + part[have : have + m]
                have += width
        k >>= 1
        if not k:
            break
        m = len(part) - width
        part = part[:m] * np.uint64(pow(_M, width, 1 << 64)) + part[width : width + m]
        width *= 2
    acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (acc ^ (acc >> np.uint64(32))) >> np.uint64(16)


def spread_evenly(h: np.ndarray) -> np.ndarray:
    """One-to-one over 48 bits: anchors are least hashes, so they crowd at the low end, and buckets are cut by value."""
    return (h * np.uint64(_M)) & np.uint64((1 << 48) - 1)


def stretches(b: np.ndarray, bounds: np.ndarray, span: int = SPAN, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window, text) of the maximal runs of windows with one anchor.

    bounds: where each text starts in b, and the end. Windows lie in one text.
    """
    none = np.zeros(0, np.int64)
    n = len(b) - span + 1
    if n < 1:
        return none.astype(np.uint64), none, none, none
    w = span - k + 1
    at, value = np.empty(n, np.int64), np.empty(n, np.uint64)
    for lo in range(0, n, _BLOCK):
        hi = min(lo + _BLOCK, n)
        h = gram_hashes(b[lo : hi + span - 1], k)
        m, width = (h << np.uint64(16)) | np.arange(len(h), dtype=np.uint64), 1  # least hash, then leftmost
        while width * 2 <= w:
            m, width = np.minimum(m[:-width], m[width:]), width * 2
        if width < w:
            m = np.minimum(m[: len(m) - (w - width)], m[w - width :])
        m = m[: hi - lo]
        at[lo:hi] = lo + (m & np.uint64(0xFFFF)).astype(np.int64)
        value[lo:hi] = m >> np.uint64(16)
    sizes = np.diff(bounds)
    last = np.repeat(bounds[1:] - span, sizes)[:n]
    ok = np.arange(n) <= last
    start = ok.copy()
    start[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(start)
    stop = ok.copy()
    stop[:-1] &= ~ok[1:] | (at[1:] != at[:-1])
    end = np.flatnonzero(stop)
    text = np.searchsorted(bounds, first, "right") - 1
    return spread_evenly(value[first]), first, end, text


class BlindTrie:
    """Orders strings that agree so far: inner nodes test one bit, a leaf holds all members with its key."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, key: int, member: int) -> None:
        if self.root is None:
            self.root = [-1, key, [member]]
            return
        node = self.root
        while node[0] >= 0:
            node = node[1 + (key >> node[0] & 1)]
        if node[1] == key:
            node[2].append(member)
            return
        bit = (node[1] ^ key).bit_length() - 1
        above, side, node = None, 0, self.root
        while node[0] > bit:
            above, side = node, 1 + (key >> node[0] & 1)
            node = node[side]
        leaf = [-1, key, [member]]
        new = [bit, node, leaf] if key >> bit & 1 else [bit, leaf, node]
        if above is None:
            self.root = new
        else:
            above[side] = new

    def leaves(self) -> Iterator[list[int]]:
        """Members of equal keys, in order of the keys."""
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] < 0:
                yield node[2]
            else:
                todo += (node[2], node[1])


def deep_shallow(b: np.ndarray, starts: np.ndarray, depth: int = SPAN, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes to `depth` bytes, class of each suffix in that order: equal to the full depth or not)."""
    pad = np.concatenate([b, np.zeros(8, np.uint8)]).astype(np.uint64)
    word, width = pad, 1
    while width < 8:
        word, width = (word[:-width] << np.uint64(8 * width)) | word[width:], width * 2
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    live = np.ones(len(starts), bool)
    for level in range(0, shallow, 8):  # multikey quicksort: groups that agree so far are parted by their next word
        rows = np.flatnonzero(live)
        key = word[starts[order[rows]] + level]
        by = np.lexsort((key, group[rows]))
        order[rows] = order[rows][by]
        key = key[by]
        g = group[rows]
        new = np.ones(len(rows), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        group[rows] = rows[np.flatnonzero(new)][np.cumsum(new) - 1]
        alone = np.ones(len(order), bool)
        alone[1:] = group[1:] != group[:-1]
        alone[:-1] &= group[1:] != group[:-1]
        live &= ~alone
    rows = np.flatnonzero(live)
    if len(rows):
        raw = b.tobytes()
        edges = np.flatnonzero(np.append(True, group[rows][1:] != group[rows][:-1]))
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(rows)], strict=True):
            first = int(rows[lo])
            trie = BlindTrie()
            for member in order[first : first + hi - lo].tolist():
                s = int(starts[member])
                trie.add(int.from_bytes(raw[s + shallow : s + depth], "big"), member)
            at = first
            for equal in trie.leaves():
                order[at : at + len(equal)] = equal
                group[at : at + len(equal)] = at
                at += len(equal)
    return order, group


def _six(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _zip(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unzip(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def make_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(shard, rows, ids, sizes, firsts, n, body): texts end to end in shards of bounded size, compressed.

    A text longer than a shard goes on in the next ones; the pieces overlap by
    one byte less than the span, and firsts tells where a piece lies in its text.
    rows numbers the texts of a task, so pieces of one text share (part, row).
    extras holds the carried columns as JSON, with a text's first piece.
    """
    extra = F.to_json(F.struct(*[F.col(f"`{c}`") for c in carry])) if carry else F.lit(None).cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"), extra.alias("extra"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes, str | None]] = []
        size = row = number = part = 0
        release()

        def out() -> pa.RecordBatch:
            rows, ids, firsts, texts, extras = zip(*held, strict=True)
            body = b"".join(texts)
            return pa.RecordBatch.from_pydict({"shard": pa.array([part << 32 | number], pa.int64()), "rows": pa.array([list(rows)], pa.list_(pa.int64())), "ids": pa.array([list(ids)], pa.list_(pa.int64())), "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), "firsts": pa.array([list(firsts)], pa.list_(pa.int64())), "n": pa.array([len(body)], pa.int64()), "body": pa.array([_zip(body)], pa.binary()), "extras": pa.array([list(extras)], pa.list_(pa.string()))})

        for batch in batches:
            for i, t, part, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, first = (t or "").encode(), 0
                while True:
                    piece = raw[first : first + shard_bytes]
                    held.append((row, i, first, piece, None if first else e))
                    size += len(piece)
                    if size >= shard_bytes or len(held) >= 50_000:
                        yield out()
                        held, size, number = [], 0, number + 1
                    if first + len(piece) >= len(raw):
                        break
                    first += shard_bytes - SPAN + 1
                row += 1
        if held:
            yield out()

    return slim.mapInArrow(run, "shard long, rows array<long>, ids array<long>, sizes array<int>, firsts array<long>, n long, body binary, extras array<string>")


def _ids(ids: list[int | None]) -> np.ndarray:
    """Null ids come last."""
    return np.array([LAST if i is None else i for i in ids], np.int64)


def _tell_anchors(shards: DataFrame, buckets: int) -> DataFrame:
    """(bucket, shard, hashes, texts): a shard's distinct anchors and how many of its own texts have each (at most 65,535 are told)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            for row in batch.to_pylist():
                bounds = np.concatenate(([0], np.cumsum(row["sizes"]))).astype(np.int64)
                h, _, _, text = stretches(np.frombuffer(_unzip(row["body"]), np.uint8), bounds)
                if not len(h):
                    continue
                order = np.argsort(h, kind="stable")  # texts stay in order under each anchor
                h, text = h[order], text[order]
                first = np.append(True, h[1:] != h[:-1])
                edge = np.flatnonzero(first)
                other = first | np.append(True, text[1:] != text[:-1])
                texts = np.minimum(np.add.reduceat(other.astype(np.int64), edge), 65_535).astype("<u2")
                one = h[edge]
                cuts = np.searchsorted(one, np.arange(buckets + 1, dtype=np.float64) * (2.0**48 / buckets))
                rows = [(k, row["shard"], _six(one[i:j]), _zip(texts[i:j].tobytes())) for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), [*cuts[1:-1].tolist(), len(one)], strict=True)) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "shard", "hashes", "texts"])

    return shards.select("shard", "ids", "sizes", "body").mapInArrow(run, "bucket int, shard long, hashes binary, texts binary")


def _tell_shared(told: DataFrame) -> DataFrame:
    """(shard, shared, hot): which of its anchors other texts have too; hot ones lie in very many texts."""
    schema = pa.schema([("shard", pa.int64()), ("shared", pa.binary()), ("hot", pa.binary())])

    def meet(group: pa.Table) -> pa.Table:
        rows = group.select(["shard", "hashes", "texts"]).to_pylist()
        parts = [_from_six(r["hashes"]) for r in rows]
        h, owner = np.concatenate(parts), np.repeat(np.arange(len(rows)), [len(x) for x in parts])
        texts = np.concatenate([np.frombuffer(_unzip(r["texts"]), "<u2") for r in rows]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, owner, texts = h[order], owner[order], texts[order]
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        count = np.diff(np.append(edge, len(h)))
        total = np.repeat(np.add.reduceat(texts, edge), count)
        keep, hot = total > 1, total >= HOT_TEXTS
        out = []
        h, owner, hot = h[keep], owner[keep], hot[keep]
        order = np.argsort(owner, kind="stable")
        h, owner, hot = h[order], owner[order], hot[order]
        cuts = np.searchsorted(owner, np.arange(len(rows) + 1)).tolist()
        for k, r in enumerate(rows):
            i, j = cuts[k], cuts[k + 1]
            if j > i:
                out.append((r["shard"], _six(h[i:j][~hot[i:j]]), _six(h[i:j][hot[i:j]])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else ([], [], []), schema, strict=True)], schema=schema)

    return told.groupBy("bucket").applyInArrow(meet, "shard long, shared binary, hot binary")


class Stretches:
    """A shard's stretches around anchors that other texts have too, in an order that the shard's bytes and those anchors fix."""

    def __init__(self, row: dict, warm: list[bytes], hot: list[bytes]) -> None:
        self.raw = _unzip(row["body"])
        b, bounds, ids = np.frombuffer(self.raw, np.uint8), np.concatenate(([0], np.cumsum(row["sizes"]))).astype(np.int64), _ids(row["ids"])
        h, first, last, text = stretches(b, bounds)

        def among(parts: list[bytes]) -> np.ndarray:
            known = np.sort(np.concatenate([np.zeros(0, np.uint64), *map(_from_six, parts)]))
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            return known[at] == h if len(known) else np.zeros(len(h), bool)

        w, t = np.flatnonzero(among(warm)), np.flatnonzero(among(hot))
        spread = (last - first + 1)[t]
        each = np.repeat(t, spread)
        single = np.repeat(first[t], spread) + np.arange(len(each)) - np.repeat(spread.cumsum() - spread, spread)
        self.begin = np.concatenate([first[w], single])
        stop = np.concatenate([last[w] + SPAN, single + SPAN])
        self.doc = ids[np.concatenate([text[w], text[each]])]
        seen: dict[bytes, int] = {}
        raw = self.raw
        self.which = np.fromiter((seen.setdefault(raw[i:j], len(seen)) for i, j in zip(self.begin.tolist(), stop.tolist(), strict=True)), np.int64, len(self.begin))
        self.bodies = list(seen)
        lead = np.zeros(len(seen), np.int64)
        lead[self.which[::-1]] = np.arange(len(self.which))[::-1]
        self.deal = np.concatenate([h[w], h[each]])[lead]
        for k in np.flatnonzero(lead >= len(w)).tolist():  # windows of hot anchors go by their own content
            self.deal[k] = int.from_bytes(hashlib.blake2b(self.bodies[k], digest_size=6).digest(), "little")
        self.least = np.full(len(seen), LAST, np.int64)
        np.minimum.at(self.least, self.which, self.doc)

    def gone(self, told: Iterator[tuple[int, list[int], list[int]]]) -> np.ndarray:
        """Sorted first bytes of the windows that an earlier document has; told: (stretch, first windows of runs, their earliest documents)."""
        n = np.fromiter(map(len, self.bodies), np.int64, len(self.bodies)) - SPAN + 1
        base = n.cumsum() - n
        earliest = np.repeat(self.least, n)
        for k, starts, docs in told:
            lo = int(base[k])
            sizes = np.diff(np.append(starts, n[k]))
            earliest[lo : lo + int(n[k])] = np.minimum(np.repeat(np.array(docs, np.int64), sizes), self.least[k])
        out = []
        step = 1 << 16
        for at in range(0, len(self.which), step):  # a bounded number of stretches at a time
            which = self.which[at : at + step]
            m = n[which]
            inner = np.arange(m.sum()) - np.repeat(m.cumsum() - m, m)
            late = earliest[np.repeat(base[which], m) + inner] < np.repeat(self.doc[at : at + step], m)
            out.append(np.repeat(self.begin[at : at + step], m)[late] + inner[late])
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _deal_stretches(shards: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """Distinct stretches around shared anchors, numbered, with the least document of the shard that has each."""
    schema = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("bodies", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary()), ("numbers", pa.binary()), ("docs", pa.binary())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        release()
        s = Stretches(left.select(["ids", "sizes", "body"]).to_pylist()[0], right.column("shared").to_pylist(), right.column("hot").to_pylist())
        if not s.bodies:
            return schema.empty_table()
        bucket = (s.deal.astype(np.float64) * (buckets / 2.0**48)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(bucket[by]) != 0))
        out = []
        for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(by)], strict=True):
            mine = by[i:j]
            text_of = [s.bodies[m] for m in mine.tolist()]
            out.append((int(bucket[mine[0]]), left.column("shard")[0].as_py(), _zip(b"".join(text_of)), bytes(map(len, text_of)), _six(s.deal[mine]), mine.astype("<u4").tobytes(), _zip(s.least[mine].astype("<i8").tobytes())))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ddl = "bucket int, shard long, bodies binary, sizes binary, hashes binary, numbers binary, docs binary"
    return shards.select("shard", "ids", "sizes", "body").groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(cut, ddl)


def _sort_suffixes(dealt: DataFrame) -> DataFrame:
    """(shard, numbers, counts, starts, docs): of each shard's stretches that an earlier document of another shard has in part, the runs of windows with one earliest document."""
    schema = pa.schema([("shard", pa.int64()), ("numbers", pa.binary()), ("counts", pa.binary()), ("starts", pa.binary()), ("docs", pa.binary())])

    def judge(group: pa.Table) -> pa.Table:
        release()
        known: dict[bytes, int] = {}
        low: list[int] = []
        hashes: list[int] = []
        rows = []
        for batch in group.to_batches(max_chunksize=64):
            for r in batch.to_pylist():
                sizes, raw, at = r["sizes"], _unzip(r["bodies"]), 0
                docs = np.frombuffer(_unzip(r["docs"]), "<i8")
                which = np.empty(len(sizes), np.int64)
                for k, (n, h, d) in enumerate(zip(sizes, _from_six(r["hashes"]).tolist(), docs.tolist(), strict=True)):
                    body = raw[at : at + n]
                    at += n
                    i = known.get(body)
                    if i is None:
                        i = known[body] = len(low)
                        low.append(d)
                        hashes.append(h)
                    elif d < low[i]:
                        low[i] = d
                    which[k] = i
                rows.append((r["shard"], which, r["numbers"], docs))
        bodies = list(known)
        low_of, size = np.array(low, np.int64), np.fromiter(map(len, bodies), np.int64, len(bodies))
        n = size - SPAN + 1
        base = n.cumsum() - n
        earliest = np.repeat(low_of, n)
        # A stretch whose anchor has no other stretch can share no window: its copies' earliest document stands.
        # Windows can only be equal under one anchor, so anchors are sorted a bounded number of windows at a time.
        anchors, inverse, counts = np.unique(np.array(hashes, np.uint64), return_inverse=True, return_counts=True)
        several = np.flatnonzero(counts[inverse] > 1)
        several = several[np.argsort(inverse[several], kind="stable")]
        edges = np.flatnonzero(np.append(True, np.diff(inverse[several]) != 0)) if len(several) else several
        upto = n[several].cumsum()
        lo = 0
        while lo < len(several):
            full = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + WINDOWS, "right"))
            k = int(np.searchsorted(edges, max(full, lo + 1), "right")) - 1
            hi = int(edges[k]) if edges[k] > lo else int(edges[k + 1]) if k + 1 < len(edges) else len(several)
            if full >= len(several):
                hi = len(several)
            some = several[lo:hi]
            lo = hi
            text = np.frombuffer(b"".join(bodies[k] for k in some.tolist()), np.uint8)
            offset = size[some].cumsum() - size[some]
            m = n[some]
            inner = np.arange(m.sum()) - np.repeat(m.cumsum() - m, m)
            slot = np.repeat(base[some], m) + inner
            order, klass = deep_shallow(text, np.repeat(offset, m) + inner)
            edge = np.flatnonzero(np.append(True, klass[1:] != klass[:-1]))
            least = np.minimum.reduceat(earliest[slot][order], edge)
            earliest[slot[order]] = np.repeat(least, np.diff(np.append(edge, len(order))))
        lowest = np.minimum.reduceat(earliest, base) if len(base) else earliest
        new = np.append(True, earliest[1:] != earliest[:-1]) if len(earliest) else np.zeros(0, bool)
        new[base] = True
        run = np.flatnonzero(new)  # runs of one earliest document, none over two stretches
        first_run = np.searchsorted(run, base)
        runs = np.diff(np.append(first_run, len(run)))
        run_start = run - np.repeat(base, runs)
        out = []
        for shard, which, numbers, docs in rows:
            tell = np.flatnonzero(lowest[which] < docs)
            if len(tell):
                k = which[tell]
                m = runs[k]
                at = np.repeat(first_run[k], m) + np.arange(m.sum()) - np.repeat(m.cumsum() - m, m)
                out.append((shard, np.frombuffer(numbers, "<u4")[tell].tobytes(), m.astype(np.uint8).tobytes(), run_start[at].astype(np.uint8).tobytes(), _zip(earliest[run[at]].astype("<i8").tobytes())))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else ([], [], [], [], []), schema, strict=True)], schema=schema)

    return dealt.groupBy("bucket").applyInArrow(judge, "shard long, numbers binary, counts binary, starts binary, docs binary")


def _told(rows: list[dict]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for r in rows:
        numbers, counts, starts, docs = np.frombuffer(r["numbers"], "<u4").tolist(), np.frombuffer(r["counts"], np.uint8).tolist(), np.frombuffer(r["starts"], np.uint8), np.frombuffer(_unzip(r["docs"]), "<i8")
        at = 0
        for k, n in zip(numbers, counts, strict=True):
            yield k, starts[at : at + n], docs[at : at + n]
            at += n


_PIECE = "part long, row long, first long, doc_id long, n_bytes long, n_removed long, n_spans long, kept string, starts array<long>, ends array<long>, body binary, extra string"


def _unite(shards: DataFrame, told: DataFrame, keep_text: bool, shard_bytes: int) -> DataFrame:
    """A row for each text with its result, or for each piece of a long text with its runs and bytes (kept is null)."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _PIECE.split(", ")])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        release()
        row, told = left.to_pylist()[0], right.to_pylist()
        warm, hot = [r["shared"] for r in told if r["shared"] is not None], [r["hot"] for r in told if r["hot"] is not None]
        starts: list[int] = []
        ends: list[int] = []
        if warm or hot:
            own = Stretches(row, warm, hot)
            raw = own.raw
            window = own.gone(_told([r for r in told if r["numbers"] is not None]))
            if len(window):
                new = np.append(True, np.diff(window) > 1)
                starts, ends = window[new].tolist(), (window[np.append(new[1:], True)] + SPAN).tolist()
        else:
            raw = _unzip(row["body"])
        out, at, lo = [], 0, 0
        for number, doc, first, n, extra in zip(row["rows"], row["ids"], row["firsts"], row["sizes"], row["extras"], strict=True):
            runs: list[list[int]] = []
            while at < len(starts) and starts[at] < lo + n:  # an interval lies in one text, as windows do
                a, b = starts[at] - lo, ends[at] - lo
                at += 1
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            body = raw[lo : lo + n]
            lo += n
            if first or n >= shard_bytes:  # only such a text can have other pieces
                out.append((row["shard"] >> 32, number, first, doc, n, None, None, None, [r[0] for r in runs], [r[1] for r in runs], body, extra))
            else:
                out.append((row["shard"] >> 32, number, first, doc, n, *_left(body, runs, keep_text), None, None, None, extra))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return shards.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(join, _PIECE)


def _left(body: bytes, runs: list[list[int]], keep_text: bool) -> tuple[int, int, str]:
    """(bytes removed, runs, what is left: as text without broken characters, or the SHA-256 of its bytes)."""
    parts, at = [], 0
    for a, b in runs:
        parts.append(body[at:a])
        at = b
    kept = b"".join(parts) + body[at:]
    return sum(b - a for a, b in runs), len(runs), kept.decode("utf-8", "ignore") if keep_text else hashlib.sha256(kept).hexdigest()


def _whole_texts(pieces: DataFrame, keep_text: bool) -> DataFrame:
    """Puts the pieces of each long text together, one text in a group."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "extra"]
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept string, extra string"
    result = pa.schema([(n, pa.string() if n in ("kept", "extra") else pa.int64()) for n in names])

    def gather(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda p: p["first"])
        size = rows[-1]["first"] + rows[-1]["n_bytes"]
        body, spans = bytearray(size), []
        for p in rows:
            body[p["first"] : p["first"] + p["n_bytes"]] = p["body"]
            spans += [(p["first"] + a, p["first"] + b) for a, b in zip(p["starts"], p["ends"], strict=True)]
        runs: list[list[int]] = []
        for a, b in sorted(spans):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        row = (rows[0]["doc_id"], size, *_left(bytes(body), runs, keep_text), rows[0]["extra"])
        return pa.table([pa.array([v], f.type) for v, f in zip(row, result, strict=True)], schema=result)

    done = pieces.where(F.col("kept").isNotNull()).select(*names)
    return done.unionByName(pieces.where(F.col("kept").isNull()).groupBy("part", "row").applyInArrow(gather, ddl))


def sizes(total: int, parts: int, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[int, int]:
    """(bytes of a shard, buckets) for a corpus of so many bytes: at least the given shard, and one that grows with the root of the corpus, so that rows of (shard, bucket) grow with it in proportion."""
    shard = max(shard_bytes, int(math.sqrt(total) * 4))
    bucket = max(bucket_bytes, shard * bucket_bytes // shard_bytes)
    return shard, max(8, 2 * parts, -(-total // bucket))


def dedup(docs: DataFrame, keep_text: bool = True, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, extra): kept is the remaining text (broken characters left out), or the SHA-256 of the remaining bytes; extra the carried columns as JSON."""
    spark = docs.sparkSession
    bound_batches(spark)
    name = f"suffix_shards_{uuid.uuid4().hex}"
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shard_bytes, buckets = sizes(total, parts, shard_bytes, bucket_bytes)
    made = make_shards(docs, shard_bytes, carry).repartition(parts, "shard")  # a file for each task, not for each task and bucket
    made.write.bucketBy(parts, "shard").option("compression", "uncompressed").saveAsTable(name)
    shards = spark.table(name)
    shared = write_table(_tell_shared(_tell_anchors(shards, buckets)), "shared")
    gone = _sort_suffixes(_deal_stretches(shards, shared, buckets))
    none = F.lit(None).cast("binary")
    told = shared.select("shard", "shared", "hot", *[none.alias(c) for c in ("numbers", "counts", "starts", "docs")])
    told = told.unionByName(gone.select("shard", none.alias("shared"), none.alias("hot"), "numbers", "counts", "starts", "docs"))
    pieces = write_table(_unite(shards, told, keep_text, shard_bytes), "deduped")
    spark.sql(f"DROP TABLE {name}")
    return _whole_texts(pieces, keep_text)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of their texts; all rows and columns stay, n_chars follows where there is one.

    Bytes of a character that was cut in two go with it.
    """
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    out = dedup(docs, True, carry=tuple(f.name for f in others))

    out = out.select("doc_id", F.col("kept").alias("text"), F.from_json("extra", StructType(others)).alias("x") if others else F.lit(None).alias("x"))

    def column(name: str, kind: DataType) -> Column:
        if name == "doc_id":
            return F.col("doc_id").cast(kind).alias(name)
        if name == "text":
            return F.col("text")
        return (F.length("text").cast(kind) if name == "n_chars" else F.col("x").getField(name)).alias(name)

    return out.select(*[column(f.name, f.dataType) for f in docs.schema.fields])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))
