"""SimHash near-dedup with BK-trees.

Children of a BK-tree node are keyed by their integer Hamming distance to it,
and a search follows only the edges within the radius. The trees are sharded:
two fingerprints that differ in at most r bits agree in at least two of r + 2
blocks of bits, so a tree per (two blocks, their values) finds every link, and
no tree or fingerprint table ever goes to the driver or to all executors (a
broadcast of all shard trees would grow with the corpus). Fingerprints that
share one block only, as those of a page template may, part by the other one
over many shards; a shard that is large all the same is parted by its further
bits again, so no tree holds more than a stated number of values.

Copies are folded before the search (one row per distinct fingerprint), and a
shard emits a spanning forest, never all pairs.

Edge cases: null and wordless texts have fingerprint zero and link like any
other; null ids take part but never name a component (null if no id is left);
repeated rows are returned each; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, map_rows, write_table
from .graph import connected_components

#: Values of one tree at most.
MOST = 4096
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; fewer words: the whole sequence; none: empty."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(octets), 65536):
        counts += np.unpackbits(octets[at : at + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every whole text, as a signed long."""

    def make():
        return lambda ids, texts: [(i, signed(fingerprint(shingle_hashes(t, width)))) for i, t in zip(ids, texts, strict=True)]

    return map_rows(id_text(docs), "doc_id long, fp long", make)


class BKTree:
    """Node: [value, {distance: node}]. Equal values are kept once."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while d := (x ^ node[0]).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [x, {}]
                return
            node = child

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (x ^ value).bit_count()
            if d <= radius:
                found.append(value)
            if children:
                todo += [child for at, child in children.items() if d - radius <= at <= d + radius]
        return found

    def first_within(self, x: int, radius: int) -> int | None:
        """Any one value within the radius."""
        todo = [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (x ^ value).bit_count()
            if d <= radius:
                return value
            if children:
                todo += [child for at, child in children.items() if d - radius <= at <= d + radius]
        return None


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct values, from one tree."""
    tree, parent, out = BKTree(), {}, []

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x in values:
        for y in tree.within(x, radius):
            a, b = top(x), top(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((x, y))
        tree.add(x)
    return out


def shard_links(values: list[int], radius: int, most: int = MOST) -> list[tuple[int, int]]:
    """Links that join all of a shard's values that links join; trees of at most `most` values.

    More values are parted by the bits in which they differ, in radius + 1
    blocks: values that link agree in one of them at least.
    """
    if len(values) <= most:
        return tree_links(values, radius)
    vary = 0
    for x in values:
        vary |= x ^ values[0]
    bits = [k for k in range(vary.bit_length()) if vary >> k & 1]
    if len(bits) <= radius:
        return [(x, values[0]) for x in values[1:]]
    out = []
    for k in range(radius + 1):
        mask = sum(1 << b for b in bits[k :: radius + 1])
        groups: dict[int, list[int]] = {}
        for x in values:
            groups.setdefault(x & mask, []).append(x)
        for group in groups.values():
            if len(group) > 1:
                out += shard_links(group, radius, most)
    return out


def blocks(parts: int) -> list[tuple[int, int]]:
    """(first bit, mask) of so many blocks that together hold all 64 bits."""
    cuts = [round(64 * k / parts) for k in range(parts + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def dealt_by_blocks(distinct: DataFrame, radius: int) -> DataFrame:
    """(b, v, fp): every fingerprint once for each two of radius + 2 blocks, with the values of both."""

    def value(at: int, mask: int) -> Column:
        return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit(mask))

    pairs = [F.struct(F.lit(k).alias("b"), F.shiftleft(value(*one), 32).bitwiseOR(value(*two)).alias("v")) for k, (one, two) in enumerate(combinations(blocks(radius + 2), 2))]
    return distinct.select("fp", F.explode(F.array(*pairs)).alias("s")).select("s.b", "s.v", "fp")


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """(u, v) links among distinct fingerprints (column fp) that differ in at most radius bits.

    Lone rows of a shard are dropped while streaming through it, so a task
    holds one shard at a time.
    """
    dealt = dealt_by_blocks(distinct, radius).repartition("b", "v").sortWithinPartitions("b", "v", "fp")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> list[tuple[int, int]]:
            return [(signed(u), signed(v)) for u, v in shard_links(held, radius)] if len(held) > 1 else []

        for batch in batches:
            out = []
            for b, v, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (b, v) != key:
                    out += links()
                    key, held = (b, v), []
                held.append(fp & 0xFFFFFFFFFFFFFFFF)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
        if out := links():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return dealt.mapInArrow(run, "u long, v long")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links, the own included."""
    marks = write_table(fingerprints(docs, width), "fingerprints")
    distinct = marks.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = connected_components(near_links(distinct.select("fp"), radius))
    placed = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.join(placed.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return marks.join(named, "fp")


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
