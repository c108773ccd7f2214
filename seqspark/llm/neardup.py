"""SimHash near-dedup on word shingles at a stated similarity, one document of each group kept.

Fingerprints of 256 bits are compared in shards: a shard holds the fingerprints
that agree in a band of bits, and its BK-tree follows only the edges within the
radius that the similarity implies for 128 of the bits; a text within the radius
of one in the tree is linked to it and not kept. The number of bands is fixed,
so what is dealt grows with the texts alone; their width grows with the
logarithm of the number of texts, so shards stay small. A shard that is hot all
the same is split by Spark, and a tree that is full begins anew: what these let
go, as bands do, is found by an exact join beside them, at any table size. With
shingles in the order of their hashes, two similar
texts share a known number of their first ones, and of those that other texts
hold too, each has one of its rarest in common with the other. Both ways give
forests of candidates, and the components of those are clusters that no similar
pair leaves, whatever the table's size. An exact check follows inside each
cluster: an inverted index over the rarest shingles of every text finds
the pairs whose shingle sets reach the similarity. Texts are told apart by 128
bits of their SHA-256. In a cluster above a block's size every text is held
against a few pivots first: those that are joined to one pivot, by themselves
or by way of others, are one group already and never meet each other again.
Only the rest is checked block against block, with itself and with that group.
Every task gives a spanning forest, so no group is gathered whole and no list of
all pairs is made.

Edge cases: null and wordless texts are copies of each other's empty shingle
set, and equal texts always form a group; of repeated rows one stays; null ids
stay only where no other id is in the group; very long texts are read whole;
extra columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import digest, map_rows, maybe_in, release, write_table
from .graph import connected_components
from .simhash import MOST, BKTree, shingle_hashes

WORDS = 256
BANDS = 10
PIVOTS = 4
#: Shingles of a text that the exact join takes beyond those that may differ, as a share of all: more are a sharper filter and a larger shuffle.
SPARE = 0.1
#: Texts that lead with a shingle from which on it counts as very common, and what such a one counts as held by.
COMMON, MOST_HELD = 500_000, 1 << 40
#: Share of a task's different texts from which on a shingle that they lead with is told as a candidate for a hot one, and of all texts from which on it is one.
TOLD, HOT = 1 / 500, 1 / 250
#: Texts that a hot shingle leads at least.
HOT_LEAST = 1000
#: Shingles of the texts that meet in one block of a cluster, about, beside their number.
BLOCK_SHINGLES = 2_000_000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def wide_fingerprint(hashes: np.ndarray) -> int:
    """256 bits, each the majority over all hashes; the three further words are mixes of the first."""
    if not len(hashes):
        return 0
    out = 0
    for k, odd in enumerate(_ODD):
        h = hashes
        if k:
            h = (h ^ (h >> np.uint64(31))) * np.uint64(odd)
            h = h ^ (h >> np.uint64(29))
        counts = np.zeros(64, np.int64)
        octets = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
        for at in range(0, len(octets), 65536):
            counts += np.unpackbits(octets[at : at + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out |= int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little") << 64 * k
    return out


def plan_bands(texts: int, similarity: float) -> tuple[int, int]:
    """(bits of a band, radius over 128 bits) for so many texts at a similarity of shingle sets."""
    cosine = 2 * similarity / (1 + similarity)
    p = math.acos(cosine) / math.pi
    width = min(28, max(14, math.ceil(math.log2(max(texts, 1) / 16 + 1))))
    return width, math.ceil(128 * p + 3.2 * math.sqrt(128 * p * (1 - p)))


def candidates(distinct: DataFrame, similarity: float) -> DataFrame:
    """(u, v): a forest of each shard's candidate pairs of keys."""
    width, radius = plan_bands(distinct.count(), similarity)
    rng = np.random.default_rng(42)
    chosen = [np.sort(rng.choice(WORDS, width, replace=False)) for _ in range(BANDS)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, WORDS // 8)
                bits = np.unpackbits(raw, axis=1, bitorder="little")
                value = np.stack([bits[:, c].astype(np.int64) @ (1 << np.arange(width)) for c in chosen], axis=1)
                n = batch.num_rows
                keys = np.repeat(np.asarray(batch.column(0)), BANDS)
                shard = (np.tile(np.arange(BANDS), n) << width) | value.ravel()
                words = np.repeat(raw[:, :16].copy().view(np.int64), BANDS, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(keys), pa.array(np.ascontiguousarray(words[:, 0])), pa.array(np.ascontiguousarray(words[:, 1]))], names=["shard", "key", "a", "b"])

    dealt = distinct.select("key", "fp").mapInArrow(deal, "shard long, key long, a long, b long").hint("rebalance", "shard").sortWithinPartitions("shard", "a", "b", "key")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    mask = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, owner, last = None, BKTree(), {}, (None, None)
        for batch in batches:
            out = []
            for s, key, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard or len(owner) >= MOST:
                    shard, tree, owner, last = s, BKTree(), {}, (None, None)
                fp = (b & mask) << 64 | (a & mask)
                if fp == last[0]:  # equal fingerprints follow each other and chain
                    out.append((last[1], key))
                else:
                    found = tree.first_within(fp, radius)
                    if found is None:
                        tree.add(fp)
                        owner[fp] = key
                    else:
                        out.append((owner[found], key))
                last = (fp, key)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return dealt.mapInArrow(run, "u long, v long")


def leading(n: int, similarity: float) -> tuple[int, int]:
    """(p, c) for a set of n: any set of this size or more that is similar shares c of the first p, in any common order of all elements."""
    alike = max(1, math.ceil(similarity * n - 1e-9))
    c = min(alike, math.ceil(SPARE * n))
    return n - alike + c, c


def lead(hashes: np.ndarray, similarity: float) -> tuple[int, int, bytes]:
    """(n, least, first hashes) of a text's set: a similar text shares `least` of the first ones; the empty set counts as one of a zero."""
    hashes = hashes if len(hashes) else np.zeros(1, np.uint64)
    n = len(hashes)
    least = leading(max(1, math.ceil(similarity * n - 1e-9)), similarity)[1]  # that of the smallest partner
    return n, least, hashes[: leading(n, similarity)[0]].tobytes()


def hot_shingles(marks: DataFrame) -> np.ndarray:
    """Shingles that a stated share of all texts lead with, in order: as many at most as texts lead with shingles, over that share."""
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[bytes] = set()
        held, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            leads = []
            for whole, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if whole not in seen:
                    seen.add(whole)
                    leads.append(raw)
            values, counts = np.unique(np.frombuffer(b"".join(leads), np.uint64), return_counts=True)
            values, which = np.unique(np.concatenate([*held, values]), return_inverse=True)
            total = np.bincount(which, np.concatenate([*n, counts]), len(values)).astype(np.int64)
            keep = total >= max(2, TOLD * len(seen) / 2)  # what is rare so far goes, so this stays small
            held, n = [values[keep]], [total[keep]]
        often = n[0] >= max(16, TOLD * len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(held[0][often].view(np.int64)), pa.array(n[0][often])], schema=schema)

    told = marks.select("digest", "lead").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    least = max(HOT_LEAST, HOT * marks.count())
    return np.sort(np.array([r.shingle for r in told.where(F.col("n") >= least).select("shingle").collect()], np.int64).view(np.uint64))


def _shared(marks: DataFrame) -> DataFrame:
    """(short, shingle, held): the leading shingles that at least two different texts lead with, and how many do.

    short is half of a text's digest. Should two texts share it, both count under
    the leading shingles of either, which only adds candidates. Hot shingles are
    told where they are met, so no bucket holds a share of all texts.
    """
    hot = hot_shingles(marks)
    total = marks.agg(F.sum(F.length("lead") / 8)).first()[0] or 0
    buckets = 1 << max(10, math.ceil(math.log2(total / 200_000 + 1)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[bytes] = set()  # spares most copies; the rest fold below
        for batch in batches:
            keys, leads = [], []
            for whole, short, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if whole not in seen:
                    seen.add(whole)
                    keys.append(short)
                    leads.append(raw)
            if len(seen) > 500_000:
                seen.clear()
            if not keys:
                continue
            hashes = np.frombuffer(b"".join(leads), np.uint64)
            owner = np.repeat(np.array(keys, np.int64), [len(x) // 8 for x in leads])
            if len(hot):
                rest = ~np.isin(hashes, hot)
                hashes, owner = hashes[rest], owner[rest]
                if not len(hashes):
                    continue
            bucket = (hashes & np.uint64(buckets - 1)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            hashes, owner, bucket = hashes[order], owner[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets)).tolist()
            parts = list(zip(cuts, cuts[1:], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array([hashes[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([owner[a:b].tobytes() for a, b in parts], pa.binary())], names=["bucket", "hashes", "owners"])

    def rows(h: np.ndarray, k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(h.view(np.int64)), pa.array(n)], names=["short", "shingle", "held"])

    class Bucket:
        """The shingles of a bucket with the texts that lead with each. Those of a very common one are told as they come, not kept."""

        def __init__(self) -> None:
            self.h, self.k, self.size, self.common, self.full = [], [], 0, np.zeros(0, np.uint64), 2 * COMMON

        def add(self, hashes: bytes, owners: bytes) -> Iterator[pa.RecordBatch]:
            self.h.append(np.frombuffer(hashes, np.uint64))
            self.k.append(np.frombuffer(owners, np.int64))
            self.size += len(self.h[-1])
            if self.size > self.full:
                h, k, n = self.folded()
                self.common = np.union1d(self.common, h[n >= COMMON])
                known = np.isin(h, self.common)
                if known.any():
                    yield rows(h[known], k[known], np.full(int(known.sum()), MOST_HELD))
                self.h, self.k, self.size = [h[~known]], [k[~known]], int((~known).sum())
                self.full = max(2 * COMMON, 2 * self.size)

        def folded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, k = np.concatenate(self.h), np.concatenate(self.k)
            order = np.lexsort((k, h))
            h, k = h[order], k[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
            h, k = h[once], k[once]
            _, which, counts = np.unique(h, return_inverse=True, return_counts=True)
            return h, k, counts[which].astype(np.int64)

        def rest(self) -> pa.RecordBatch:
            h, k, n = self.folded()
            known = np.isin(h, self.common)
            n = np.where(known, MOST_HELD, n)
            return rows(h[n > 1], k[n > 1], n[n > 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket = None, None
        for batch in batches:
            for b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != at:
                    if bucket:
                        yield bucket.rest()
                    at, bucket = b, Bucket()
                yield from bucket.add(x, y)
        if bucket:
            yield bucket.rest()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads = batch.column(1).to_pylist()
            hashes = np.frombuffer(b"".join(leads), np.uint64)
            owner = np.repeat(np.asarray(batch.column(0)), [len(x) // 8 for x in leads])
            known = np.isin(hashes, hot)
            if known.any():
                yield rows(hashes[known], owner[known], np.full(int(known.sum()), MOST_HELD))

    schema = "short long, shingle long, held long"
    parts = marks.select("digest", "short", "lead").mapInArrow(deal, "bucket int, hashes binary, owners binary")
    counted = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)
    return counted.unionByName(marks.select("short", "lead").mapInArrow(told, schema).distinct()) if len(hot) else counted


def exact_candidates(marks: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links that join all pairs of keys whose sets may reach the similarity, none left out.

    Texts that share fewer of their leading shingles with any others than a
    similar pair must are done with. The others are listed under their rarest,
    as many as one of which a similar text must share. A list is chained by
    size, so it gives no more links than rows, and a chain breaks only where
    sizes are too far apart.
    """
    some = _shared(marks).groupBy("short").agg(F.collect_list(F.struct("held", "shingle")).alias("s")).join(distinct.select("short", "key", "n", "least"), "short")
    rare = some.where(F.size("s") >= F.col("least")).select("key", "n", F.explode(F.slice(F.sort_array("s"), 1, F.size("s") - F.col("least") + 1)).alias("x")).select("key", "n", "x.shingle")
    return chained(rare, similarity)


def chained(rare: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the keys of each shingle's list (key, n, shingle) as a chain in the order of n.

    Lists are sorted over all partitions by range, so that a list of any length
    is spread over as many as it takes; the ends of neighbouring partitions are
    chained afterwards, two rows for each.
    """
    sorted_ = rare.repartitionByRange("shingle", "n", "key").sortWithinPartitions("shingle", "n", "key").select("shingle", "n", "key")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("shingle", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        ends: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(c) for c in batch.columns])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            if not ends:
                ends.append(rows[:, :1])
            near = (rows[0, 1:] == rows[0, :-1]) & (rows[1, :-1] >= similarity * rows[1, 1:] - 1e-9)
            none = pa.nulls(int(near.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows[2, 1:][near]), pa.array(rows[2, :-1][near]), none, none], schema=schema)
            held = rows[:, -1:]
        if held is not None:
            edge = np.concatenate([*ends, held], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(edge[2]), pa.nulls(2, pa.int64()), pa.array(edge[0]), pa.array(edge[1])], schema=schema)

    linked = write_table(sorted_.mapInArrow(run, "u long, v long, shingle long, n long"), "chained")
    before = W.orderBy("shingle", "n", "u")  # two rows of each partition, so as many as there are tasks
    ends = linked.where("v IS NULL").select("u", "n", "shingle", *[F.lag(c).over(before).alias(f"__{c}") for c in ("u", "n", "shingle")])
    ends = ends.where((F.col("shingle") == F.col("__shingle")) & (F.col("__n") >= similarity * F.col("n") - 1e-9)).select("u", F.col("__u").alias("v"))
    return linked.where("v IS NOT NULL").select("u", "v").unionByName(ends).where("u != v").distinct()


def _forest(keys: list[int], near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links, breadth first."""
    out, unseen = [], np.ones(len(keys), bool)
    for start in range(len(keys)):
        if not unseen[start]:
            continue
        unseen[start], todo = False, [start]
        while todo:
            i = todo.pop()
            found = np.flatnonzero(near[i] & unseen).tolist()
            unseen[found] = False
            out += [(keys[i], keys[j]) for j in found]
            todo += found
    return out


def _all_intersections(sets: list[np.ndarray], most: float = 1e11) -> np.ndarray | None:
    """Sizes of all intersections by products of the membership matrix, a slab of shingles at a time; None where that takes too much."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    if n < 64 or n * n * float(shared.sum()) > most:
        return None
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int(shared.sum()), 1024):
        a, b = np.searchsorted(column, (lo, lo + 1024))
        member = np.zeros((n, 1024), np.float32)
        member[owner[a:b], column[a:b] - lo] = 1
        out += member @ member.T
    return out


def similar_forest(keys: list[int], sets: list[np.ndarray], side: list[int] | None, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sets reach the similarity; with sides, only pairs of different sides count.

    Sets are walked from small to large. Two sets can reach the similarity only
    if they share one of the rarest shingles of each, as many as it leaves room
    to differ; pairs that are joined already are not compared. Where many sets
    share few shingles, as copies do, all intersections are taken at once instead.
    """
    both = _all_intersections(sets)
    if both is not None:
        size = np.array([len(s) for s in sets], np.float32)
        near = both * (1 + similarity) >= similarity * (size[:, None] + size[None, :]) - 1e-3
        if side:
            near &= np.array(side)[:, None] != np.array(side)[None, :]
        return _forest(keys, near)
    ranks: Counter = Counter()
    for s in sets:
        ranks.update(s.tolist())
    parent = list(range(len(keys)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out, posted, ready = [], {}, {}
    for i in sorted(range(len(keys)), key=lambda i: (len(sets[i]), keys[i])):
        n = len(sets[i])
        rare = sorted(sets[i].tolist(), key=lambda x: (ranks[x], x))[: n - math.ceil(similarity * n - 1e-9) + 1]
        near: set[int] = set()
        for x in rare:
            near.update(posted.get(x, ()))
        if n == 0:
            near = set(ready.get(0, ()))
        mine = None
        for j in near:
            m = len(sets[j])
            if (side and side[i] == side[j]) or m < similarity * n - 1e-9 or top(i) == top(j):
                continue
            mine = set(sets[i].tolist()) if mine is None else mine
            both = len(mine.intersection(sets[j].tolist()))
            if both >= similarity * (n + m - both) - 1e-9:
                parent[top(i)] = top(j)
                out.append((keys[i], keys[j]))
        for x in rare:
            posted.setdefault(x, []).append(i)
        if n == 0:
            ready.setdefault(0, []).append(i)
    return out


def _near_pivots(large: DataFrame, similarity: float) -> DataFrame:
    """(key, root, bag, mask, pivot): which of its cluster's pivots each text is similar to, as bits, and the first pivot's key."""
    picked = large.groupBy("root").agg(F.array_distinct(F.array(*[F.min_by("key", F.xxhash64(F.lit(k), "key")) for k in range(PIVOTS)])).alias("keys"))
    named = picked.select("root", F.posexplode("keys").alias("at", "key")).join(large.select("key", "bag"), "key")
    pivots = write_table(named.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("at", "key", "bag"))).alias("p")), "pivots")
    met = large.select("key", "root", "bag").join(pivots.select("root", F.col("p.bag").alias("bags"), F.col("p.key")[0].alias("pivot")), "root")

    def make():
        def f(keys, roots, bags, others, firsts):
            rows = []
            for k, r, raw, ps, p in zip(keys, roots, bags, others, firsts, strict=True):
                mine, mask = np.frombuffer(raw, np.uint64), 0
                for at, other in enumerate(ps):
                    theirs = np.frombuffer(other, np.uint64)
                    both = len(np.intersect1d(mine, theirs, assume_unique=True))
                    mask |= (both >= similarity * (len(mine) + len(theirs) - both) - 1e-9) << at
                rows.append((k, r, raw, int(mask), p))
            return rows

        return f

    return map_rows(met.select("key", "root", "bag", "bags", "pivot"), "key long, root long, bag binary, mask int, pivot long", make)


def _joined_masks(marked: DataFrame) -> DataFrame:
    """(root, reach): all pivots that texts join to the first pivot, as bits."""
    masks = marked.groupBy("root").agg(F.collect_set("mask").alias("masks"))  # 2^PIVOTS at most
    once = lambda reach: F.aggregate("masks", reach, lambda acc, m: F.when(acc.bitwiseAND(m) != 0, acc.bitwiseOR(m)).otherwise(acc))
    reach = F.lit(1)
    for _ in range(PIVOTS - 1):
        reach = once(reach)
    return masks.select("root", once(reach).alias("reach"))


Join = Callable[[list[int], list[np.ndarray], list[int] | None, float], list[tuple[int, int]]]


def checked_links(texts: DataFrame, clusters: DataFrame, width: int, similarity: float, block: int, join: Join = similar_forest) -> DataFrame:
    """(u, v): links that join the texts of each cluster (key, root, first, digest, n) which similar pairs join.

    Of copies only the text of the row `first` is read. Clusters grow with the
    corpus, so they are merged with the texts, never broadcast. Clusters of more
    than `block` texts, or of more than BLOCK_SHINGLES shingles, meet in blocks
    of about that many.
    """
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    sizes = clusters.groupBy("root").agg(blocks.cast("int").alias("blocks"))
    placed = clusters.drop("n").join(sizes, "root").withColumn("large", F.col("blocks") > 1)

    def make():
        return lambda keys, roots, large, ts: [(k, r, x, np.unique(shingle_hashes(t, width)).tobytes()) for k, r, x, t in zip(keys, roots, large, ts, strict=True)]

    some = maybe_in(texts, F.xxhash64("doc_id", "digest"), clusters.select(F.xxhash64("first", "digest"))).where("__maybe")
    placed = placed.withColumnRenamed("digest", "__digest")
    met = some.join(placed.hint("merge"), (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("first")))
    held = map_rows(met.select("key", "root", "large", "text"), "key long, root long, large boolean, bag binary", make)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def check(group: pa.Table) -> pa.Table:
        if group.num_rows < 2:
            return schema.empty_table()
        keys, side = group.column("key").to_pylist(), group.column("side").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("bag").to_pylist()]
        links = join(keys, sets, side if side[0] is not None else None, similarity)
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*links, strict=True) if links else ([], []))], schema=schema)

    def within(dealt: DataFrame) -> DataFrame:
        return dealt.groupBy("root", "kind", "lo", "hi").applyInArrow(check, "u long, v long")

    zero, none = F.lit(0), F.lit(None).cast("int")
    if not sizes.where("blocks > 1").limit(1).count():
        return within(held.select("key", "root", "bag", zero.alias("kind"), zero.alias("lo"), zero.alias("hi"), none.alias("side")))
    held = write_table(held, "bags")
    alone = held.where("NOT large").select("key", "root", "bag", zero.alias("kind"), zero.alias("lo"), zero.alias("hi"), none.alias("side"))
    marked = write_table(_near_pivots(held.where("large"), similarity), "marked")
    marked = marked.join(_joined_masks(marked), "root").withColumn("inside", F.col("mask").bitwiseAND(F.col("reach")) != 0)
    stars = marked.where("inside AND key != pivot").select(F.col("key").alias("u"), F.col("pivot").alias("v"))

    def blocks_of(inside: bool) -> Column:
        held_by = F.when(F.col("inside") == inside, F.length("bag") / 8)
        return F.greatest(F.ceil(F.count(held_by) / block), F.ceil(F.coalesce(F.sum(held_by), F.lit(0)) / BLOCK_SHINGLES)).cast("int")

    counted = marked.groupBy("root").agg(blocks_of(False).alias("rest"), blocks_of(True).alias("group")).where("rest > 0")
    dealt = marked.join(counted, "root").withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "key"), F.when(F.col("inside"), F.col("group")).otherwise(F.col("rest"))).cast("int"))

    def places(kind: int, of: str, lo, hi, side) -> Column:
        """A struct for each block of `of` that a row meets."""
        return F.transform(F.sequence(F.lit(0), F.col(of) - 1), lambda k: F.struct(F.lit(kind).alias("kind"), lo(k).alias("lo"), hi(k).alias("hi"), side(k).alias("side")))

    own = F.col("own")
    with_rest = places(1, "rest", lambda k: F.least(own, k), lambda k: F.greatest(own, k), lambda k: F.when(own != k, own).when(F.lit(True), none))
    with_group = places(2, "group", lambda k: own, lambda k: k, lambda k: F.lit(0))
    as_group = places(2, "rest", lambda k: k, lambda k: own, lambda k: F.lit(1))
    apart = dealt.select("key", "root", "bag", F.explode(F.when(F.col("inside"), as_group).otherwise(F.concat(with_rest, with_group))).alias("p")).select("key", "root", "bag", "p.kind", "p.lo", "p.hi", "p.side")
    return within(alone.unionByName(apart)).unionByName(stars)


def near_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, block: int = 1000) -> DataFrame:
    """(doc_id, digest, rows, keeper): for each different (doc_id, text) its number of rows and whether it is the one that stays."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = slim.select("doc_id", digest(F.col("text")).alias("digest"), "text")

    def make():
        def f(rows, ids, digests, ts):
            sets = [np.unique(shingle_hashes(t, width)) for t in ts]
            return [(r, i, d, int.from_bytes(d[:8], "big", signed=True), wide_fingerprint(s).to_bytes(WORDS // 8, "little"), *lead(s, similarity)) for r, i, d, s in zip(rows, ids, digests, sets, strict=True)]

        return f

    numbered = keyed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest", "text")
    marks = write_table(map_rows(numbered, "row long, doc_id long, digest binary, short long, fp binary, n long, least int, lead binary", make), "marks")
    ones = [F.first(c).alias(c) for c in ("short", "fp", "n", "least")]
    distinct = write_table(marks.groupBy("digest").agg(F.min("row").alias("key"), F.min("doc_id").alias("first"), *ones), "distinct")
    links = candidates(distinct, similarity).unionByName(exact_candidates(marks, distinct, similarity))
    clusters = connected_components(links).withColumnRenamed("node", "key")
    clusters = write_table(clusters.join(distinct.select("key", "first", "digest", "n"), "key"), "clusters")
    links = checked_links(keyed, clusters, width, similarity, block)
    groups = connected_components(links).withColumnRenamed("node", "key")
    roots = distinct.select("digest", "key").join(groups, "key", "left").select("digest", F.coalesce("root", "key").alias("root"))
    rows = write_table(marks.groupBy("doc_id", "digest").agg(F.count("*").alias("rows")).join(roots, "digest"), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    best = rows.groupBy("root").agg(F.min(order).alias("best"))
    met = rows.join(write_table(best, "best"), "root")  # two plain exchanges, so a hot group can be split
    return met.select("doc_id", "digest", "rows", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))).alias("keeper"))


def drop_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near copies, the one of the smallest doc_id; all columns stay."""
    names = docs.columns
    rows = write_table(near_groups(docs, width, similarity), "groups")
    named = rows.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__key"), "rows", "keeper")
    other = named.where("NOT keeper OR rows > 1")  # all else stays as it is
    several = named.where("keeper AND rows > 1")
    own = docs.withColumn("__own", digest(F.col("text").cast("string")))

    def near(keys: DataFrame) -> DataFrame:
        return maybe_in(own, F.xxhash64(F.col("doc_id").cast("long"), "__own"), keys.select(F.xxhash64("__id", "__key")))

    def met(keys: DataFrame, how: str) -> DataFrame:
        """The rows that the keys' bit table lets through, merged with the keys, which grow with the corpus."""
        return near(keys).where("__maybe").join(keys.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), how)

    away = near(other).where("NOT __maybe")
    once = met(several, "inner").dropDuplicates(["__id", "__key"])
    return away.select(*names).unionByName(met(other, "left_anti").select(*names)).unionByName(once.select(*names))
