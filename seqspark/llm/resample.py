"""Importance resampling towards a target: hashed word-run features, gains against the target, Gumbel top-k.

A dictionary of delimiter-bounded distinct words stands in an Aho-Corasick
automaton, each with its CRC-32 and its length in bytes. A scan of a slab of
texts gives the payloads of all words in order; the CRC of a run of words is
composed from adjacent payloads, without a look at the bytes again, and modulo
the number of bins it is the run's bucket. A worker's dictionary grows by the
words it meets, up to `most_words`; words outside it are found as the places
where no match ends, and get their payload directly, so every word counts
whatever the dictionary holds.

Buckets are counted in each task before anything is shuffled. The gains (one
number for each bin) go with the plan to all tasks, which give each document the
floored mean of the gains of its features. A document's score adds Gumbel noise
from its id, so the highest scores are a draw without replacement. The draw's
threshold comes from counts by score; only documents at or above it are sorted,
by range over all partitions, and numbered by the partitions' sizes: no task
and no driver holds them all.

Edge cases: null texts and texts without a word have no features and weight 0;
null ids count as empty text for the noise and come last among ties; repeated
rows are scored and drawn one by one, ties of score and id by features, then
weight; texts are read whole; extra columns are ignored; an empty corpus or an
empty target gives counts of zero; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, held, id_text, release, trim, write_table

#: Bytes of texts that are scanned at once, and distinct words a worker's dictionary holds at most.
SLAB, MOST_WORDS = 4 << 20, 20_000
#: Bytes of a word in the dictionary: longer ones would fill the automaton.
LONGEST = 64
_SPACE = 32
#: A-Z to a-z; ASCII other than letters and digits to the delimiter; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else _SPACE for c in range(256))
_POLYNOMIAL = 0xEDB88320


def _shift(length: int) -> np.ndarray:
    """What each bit of a CRC becomes when so many bytes follow."""
    columns = []
    for bit in range(32):
        c = 1 << bit
        for _ in range(8 * length):
            c = (c >> 1) ^ (_POLYNOMIAL if c & 1 else 0)
        columns.append(c)
    return np.array(columns, np.uint32)


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each first string followed by its second, from the CRCs of both and the second's length in bytes."""
    out = second.copy()
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        c, moved = first[rows], np.zeros(len(rows), np.uint32)
        for bit, column in enumerate(_shift(n)):
            moved ^= np.where((c >> np.uint32(bit)) & np.uint32(1), column, np.uint32(0))
        out[rows] ^= moved
    return out


class Words:
    """The automaton of delimiter-bounded words that this worker has met, with their payloads."""

    def __init__(self, most: int) -> None:
        self.most, self.known = most, {}
        self.crc, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.automaton, self.met = None, Counter()

    def grow(self) -> None:
        """Takes in the words met outside the dictionary, most frequent first, as far as there is room."""
        for w in sorted(self.met, key=lambda w: (-self.met[w], w))[: self.most - len(self.known)]:
            self.known[w] = len(self.known)
        self.met.clear()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for w, i in self.known.items():
            self.automaton.add_word(" " + w.decode("latin-1") + " ", i)
        self.automaton.make_automaton()
        self.crc = np.fromiter(map(zlib.crc32, self.known), np.uint32, len(self.known))
        self.length = np.fromiter(map(len, self.known), np.int64, len(self.known))

    def scan(self, slab: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place after each word, its CRC, its length) of folded bytes that begin and end with a delimiter."""
        raw = np.frombuffer(slab, np.uint8)
        inside = raw != _SPACE
        begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        crc, length = np.zeros(len(ends), np.uint32), ends - begins
        missing = np.ones(len(ends), bool)
        if self.automaton is not None:
            found = np.fromiter(chain.from_iterable(self.automaton.iter(slab.decode("latin-1"))), np.int64).reshape(-1, 2)
            place = np.zeros(len(slab), np.int32)
            place[ends] = np.arange(len(ends), dtype=np.int32)
            at = place[found[:, 0]]
            crc[at], length[at] = self.crc[found[:, 1]], self.length[found[:, 1]]
            missing[at] = False
        gaps = np.flatnonzero(missing)
        rest = [slab[a:b] for a, b in zip(begins[gaps].tolist(), ends[gaps].tolist(), strict=True)]
        crc[gaps] = np.fromiter(map(zlib.crc32, rest), np.uint32, len(rest))
        if len(self.known) < self.most:
            self.met.update(w for w in rest if len(w) <= LONGEST)
            if len(gaps) * 20 > len(ends):
                self.grow()
        return ends, crc, length


def slab_features(words: Words, texts: list[str | None], longest: int, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each feature, its bucket, words of each text) for runs of 1 to `longest` words."""
    parts = [t.encode().translate(_FOLD) if t else b"" for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends, crc, length = words.scan(b" " + b" ".join(parts) + b" ")
    owner = np.searchsorted(size.cumsum(), ends - 1, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    owners, buckets = [owner], [crc % np.uint32(bins)]
    run, space = crc, np.uint32(zlib.crc32(b" "))
    for more in range(1, longest):
        if len(crc) <= more:
            break
        run = run[:-1]
        spaced = joined_crc(run, np.full(len(run), space), np.ones(len(run), np.int64))
        run = joined_crc(spaced, crc[more:], length[more:])
        same = owner[more:] == owner[:-more]
        owners.append(owner[more:][same])
        buckets.append(run[same] % np.uint32(bins))
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64), n_words


def _slabs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(t or "") for t in batch.column(column).to_pylist()]
        at = 0
        while at < len(sizes):
            end, total = at, 0
            while end < len(sizes) and (end == at or total + sizes[end] <= SLAB):
                total += sizes[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end


def bucket_counts(texts: DataFrame, longest: int = 1, bins: int = 10_000, most_words: int = MOST_WORDS) -> DataFrame:
    """(bucket, n): how many features of all texts (column text) lie in each bucket; empty buckets have no row."""
    bound_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(f"words-{most_words}", lambda: Words(most_words))
        counts = np.zeros(bins, np.int64)
        for slab in _slabs(batches, 0):
            counts += np.bincount(slab_features(words, slab.column(0).to_pylist(), longest, bins)[1], minlength=bins)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])
        trim()

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, bins: int = 10_000) -> list[int]:
    """Of each bucket, floor(1000 ln) of how much likelier the target's features fall into it than the raw texts', with 1 added to each count.

    raw and target are bucket_counts, so at most a row for each bin comes here.
    """
    s, t = ({r.bucket: r.n for r in df.collect()} for df in (raw, target))
    many_s, many_t = sum(s.values()) + bins, sum(t.values()) + bins
    return [math.floor(1000 * math.log((t.get(b, 0) + 1) * many_s / ((s.get(b, 0) + 1) * many_t))) for b in range(bins)]


def weights(docs: DataFrame, gain: list[int], longest: int = 1, most_words: int = MOST_WORDS) -> DataFrame:
    """(doc_id, n_features, n_words, weight): the floored mean of the gains of each text's features, 0 where it has none."""
    bound_batches(docs.sparkSession)
    table = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(f"words-{most_words}", lambda: Words(most_words))
        for slab in _slabs(batches, 1):
            owner, bucket, n_words = slab_features(words, slab.column(1).to_pylist(), longest, len(table))
            n = np.bincount(owner, minlength=slab.num_rows)
            total = np.zeros(slab.num_rows, np.int64)
            np.add.at(total, owner, table[bucket])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(n.astype(np.int64)), pa.array(n_words.astype(np.int64)), pa.array(weight)], names=["doc_id", "n_features", "n_words", "weight"])
        trim()

    return id_text(docs).mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def noise(seed: str) -> Column:
    """floor(1000 x Gumbel noise) from the id: the first 32 bits of SHA-256 of `seed:id`, as a uniform number."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with `rank` (1, 2, ...) in the given order over the whole table.

    Sorted by range over partitions and written; a place within its partition
    and the sizes of those before it make the rank. One row for each partition
    is broadcast.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = [*((f.name, f.dataType.simpleString()) for f in rows.schema), ("__part", "int"), ("__at", "bigint")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at + 1, at + n + 1))], names=[c for c, _ in schema])
            at += n

    placed = write_table(sorted_.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in schema)), name)
    sizes = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, parts = 0, []
    for part in sorted(sizes):
        parts.append((part, before))
        before += sizes[part]
    bases = rows.sparkSession.createDataFrame(parts, "__part int, __before long")
    return placed.join(F.broadcast(bases), "__part").withColumn("rank", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, bins: int = 10_000, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank): a draw of floor(percent / 100) of the documents with enough words, towards the texts of target.

    rank is null for documents that aren't drawn.
    """
    gain = gains(bucket_counts(docs, longest, bins), bucket_counts(target, longest, bins), bins)
    scored = write_table(weights(docs, gain, longest).withColumn("score", F.col("weight") + noise(seed)), "scored")
    enough = F.col("n_words") >= least_words
    tally = scored.where(enough).groupBy("score").agg(F.count("*").alias("n")).collect()  # scores lie within a few ten thousand, so these rows do
    drawn = percent * sum(r.n for r in tally) // 100
    threshold, above = None, 0
    for score, n in sorted(((r.score, r.n) for r in tally), reverse=True):
        if above >= drawn:
            break
        threshold, above = score, above + n
    reaches = enough & (F.col("score") >= threshold) if threshold is not None else F.lit(False)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("n_words")]
    ranked = numbered(scored.where(reaches), order, "ranked")
    some = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return some.unionByName(scored.where(~reaches).withColumn("rank", F.lit(None).cast("long")))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""WITH crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) tbl),
doc_words AS MATERIALIZED (SELECT rid, doc_id, unnest({_WORDS.format(text="text")}) w FROM (SELECT row_number() OVER () rid, doc_id, text FROM documents)),
all_docs AS MATERIALIZED (SELECT row_number() OVER () rid, doc_id FROM documents),
target_words AS MATERIALIZED (SELECT unnest({_WORDS.format(text="text")}) w FROM benchmark),
bucket AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h), 2), lambda i: CAST('0x' || substr(h, i + 1, 2) AS BIGINT))), lambda a, b: xor(tbl[1 + (xor(a, b) & 255)], a >> 8)), 4294967295) % 10000 b
  FROM (SELECT DISTINCT w, hex(encode(w)) h FROM (SELECT w FROM doc_words UNION ALL SELECT w FROM target_words)), crc_table),
s AS (SELECT b, count(*) n FROM doc_words JOIN bucket USING (w) GROUP BY b), t AS (SELECT b, count(*) n FROM target_words JOIN bucket USING (w) GROUP BY b),
totals AS (SELECT (SELECT count(*) FROM doc_words) many_s, (SELECT count(*) FROM target_words) many_t),
gain AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (many_s + 10000) AS DOUBLE) / CAST((coalesce(s.n, 0) + 1) * (many_t + 10000) AS DOUBLE))) AS BIGINT) g FROM s FULL JOIN t USING (b), totals),
per_doc AS (SELECT rid, count(*) n, CAST(sum(g) AS BIGINT) g FROM doc_words JOIN bucket USING (w) JOIN gain USING (b) GROUP BY rid),
weighed AS (SELECT doc_id, coalesce(n, 0) n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END weight FROM all_docs LEFT JOIN per_doc USING (rid)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) score FROM weighed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST, n_features, weight) place, (SELECT count(*) FROM scored WHERE n_features >= 20) many FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) n_features, CAST(weight AS BIGINT) weight, CAST(score AS BIGINT) score, CASE WHEN n_features >= 20 AND place <= 10 * many // 100 THEN place END AS rank FROM ranked"""
