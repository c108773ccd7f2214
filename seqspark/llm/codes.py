"""Vector code compression: product codes learned by rounds of nearest-entry assignment over tries of distinct parts.

Vectors become integers and are cut into equal parts. Each task sorts the parts
of a block of vectors, position by position, and keeps each distinct one once
with its weight; the sorted matrix with the common prefixes of neighbours is a
trie, stored once and read in every round. A depth-first traversal carries the
squared distances of a prefix to all entries down to its children, so a prefix
is summed once for all parts below it; small subtrees and runs of small siblings
are settled a level at a time by arrays. Leaves take the nearest entry and add
their weighted components to its sums. A round sends one row for each entry from
a task, and the driver holds the codebooks alone: positions x entries x
components, whatever the table's size. Vectors are never shuffled.

Edge cases: vectors that are null, hold null or non-finite components, or have
another length than most have (ties: the longer) are dropped; a length that
can't be cut into equal parts, and components beyond 8192 in size, whose squares
might not fit, are refused; null ids come last among the first entries, ties of
ids by their vectors; with fewer vectors than entries the codebooks have as many
entries; repeated rows are coded each; null labels are one label; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, write_table

#: Vectors in a trie at most, parts of a subtree that are settled at once, and labels that are sent to all tasks at most.
BLOCK, SUBTREE, MOST_SENT = 65_536, 4096, 100_000
LIMIT = 1 << 25
#: Places over which the rows of a label are spread where labels are many.
SPREAD = 32


def trie(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct parts in lexicographic order, weight of each, which of them each part is)."""
    n, width = parts.shape
    if not n or not width:
        return parts[: min(n, 1)], np.full(min(n, 1), n, np.int64), np.zeros(n, np.int64)
    order = np.lexsort(parts.T[::-1])
    placed = parts[order]
    opens = np.ones(n, bool)
    opens[1:] = (placed[1:] != placed[:-1]).any(axis=1)
    begins = np.flatnonzero(opens)
    which = np.empty(n, np.int64)
    which[order] = np.cumsum(opens) - 1
    return placed[begins], np.diff(np.append(begins, n)), which


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry of each distinct part, its squared distance), ties to the lower index; parts in lexicographic order."""
    n, width = parts.shape
    label, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n or not width:
        return label, error
    common = np.zeros(n, np.int64)  # components shared with the part before
    common[1:] = np.argmax(parts[1:] != parts[:-1], axis=1)
    columns = np.ascontiguousarray(entries.T)

    def settle(lo: int, hi: int, depth: int, distance: np.ndarray) -> None:
        """Parts lo..hi, which share their first `depth` components: a level of nodes at a time."""
        shared, held, begins = common[lo:hi], distance[None, :], np.zeros(1, np.int64)
        for d in range(depth, width):
            opens = shared <= d
            opens[0] = True
            nodes = np.flatnonzero(opens)
            parent = np.searchsorted(begins, nodes, side="right") - 1
            apart = parts[lo + nodes, d][:, None] - columns[d]
            held, begins = held[parent] + apart * apart, nodes
        label[lo:hi] = held.argmin(axis=1)
        error[lo:hi] = held[np.arange(hi - lo), label[lo:hi]]

    todo = [(0, n, 0, np.zeros(len(entries), np.int64))]
    while todo:
        lo, hi, depth, distance = todo.pop()
        if hi - lo <= SUBTREE:
            settle(lo, hi, depth, distance)
            continue
        cuts = np.append(np.flatnonzero(common[lo + 1 : hi] <= depth) + lo + 1, hi).tolist()
        run, at, below = lo, lo, []
        for end in cuts:  # children of this node; neighbours that are small together stay one run
            if end - run > SUBTREE:
                if at > run:
                    settle(run, at, depth, distance)
                run = at
                if end - at > SUBTREE:
                    below.append((at, end, depth + 1, distance + (parts[at, depth] - columns[depth]) ** 2))
                    run = end
            at = end
        if at > run:
            settle(run, at, depth, distance)
        todo += reversed(below)
    return label, error


def whole_vectors(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(vec_id, v, label): vectors without nulls or non-finite components, of the length that most have."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, v).alias("v"), F.col(label).alias("label")).where("v IS NOT NULL")
    most = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.where("false") if most is None else kept.where(F.size("v") == most.n)


def integers(batch: pa.RecordBatch, column: int, scale: int) -> np.ndarray:
    """floor(scale x) of a batch's vectors, a row for each."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    out = np.floor(flat * scale)
    if len(out) and np.abs(out).max() > LIMIT:
        raise ValueError(f"a component lies beyond {LIMIT // scale}")
    return out.astype(np.int64).reshape(batch.num_rows, -1)


def tries(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """(position, parts, weights): the distinct parts of each block of vectors, in order, as little-endian 32- and 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[np.ndarray] = []

        def told() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            held.clear()
            width = rows.shape[1] // parts
            for k in range(parts):
                distinct, weight, _ = trie(rows[:, k * width : (k + 1) * width])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([distinct.astype("<i4").tobytes()], pa.binary()), pa.array([weight.astype("<i8").tobytes()], pa.binary())], names=["position", "parts", "weights"])

        for batch in batches:
            if batch.num_rows:
                held.append(integers(batch, 0, scale))
            if sum(map(len, held)) >= BLOCK:
                yield from told()
        if held:
            yield from told()

    return vectors.select("v").mapInArrow(run, "position int, parts binary, weights binary")


def improved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the floored mean of the parts nearest to it; unused ones stay."""
    positions, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total, used = np.zeros(books.shape, np.int64), np.zeros((positions, entries), np.int64)
        for batch in batches:
            for k, raw, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                weight = np.frombuffer(weights, "<i8")
                rows = np.frombuffer(raw, "<i4").reshape(len(weight), width).astype(np.int64)
                label, _ = nearest(rows, books[k])
                np.add.at(used[k], label, weight)
                np.add.at(total[k], label, rows * weight[:, None])
        at = np.argwhere(used > 0)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(total[at[:, 0], at[:, 1]].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.array(used[at[:, 0], at[:, 1]]), sums], names=["position", "entry", "n", "sums"])

    told = blocks.mapInArrow(run, "position int, entry int, n long, sums array<long>")
    means = [F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)]
    out = books.copy()
    for row in told.groupBy("position", "entry").agg(F.sum("n").alias("n"), *means).collect():  # a row for each entry
        out[row.position, row.entry] = [int(row[f"s{d}"]) // row.n for d in range(width)]
    return out


def learn(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> np.ndarray:
    """Codebooks (positions x entries x components) of whole_vectors: from the vectors of the smallest ids, by so many rounds."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    if len(first[0].v) % parts:
        raise ValueError(f"vectors of {len(first[0].v)} components can't be cut into {parts} equal parts")
    seeds = np.floor(np.array([r.v for r in first], np.float64) * scale)
    if seeds.size and np.abs(seeds).max() > LIMIT:
        raise ValueError(f"a component lies beyond {LIMIT // scale}")
    books = np.ascontiguousarray(seeds.astype(np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2))
    blocks = write_table(tries(vectors, parts, scale), "tries")
    for _ in range(rounds):
        books = improved(blocks, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: int = 4096) -> DataFrame:
    """(vec_id, label, code, error): the nearest entry of each part as two hex digits, and the squared distances summed."""
    kind = vectors.schema["label"].dataType.simpleString()
    positions, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                rows = integers(batch, 1, scale)
                codes, error = np.zeros((len(rows), positions), np.uint8), np.zeros(len(rows), np.int64)
                for k in range(positions):
                    distinct, _, which = trie(rows[:, k * width : (k + 1) * width])
                    label, apart = nearest(distinct, books[k])
                    codes[:, k], error = label[which], error + apart[which]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes().hex() for r in codes]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "v", "label").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors of all rows of the same label summed; sums are sent to all tasks up to a checked number of labels, else joined by salted labels."""
    sums = write_table(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "__label")
    if sums.limit(MOST_SENT + 1).count() <= MOST_SENT:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
    salted = coded.withColumn("__salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SPREAD)).cast("int"))
    spread = sums.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return salted.join(spread, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__salt") == F.col("__place"))).drop("__label", "__salt", "__place")


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every whole vector."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    vectors = whole_vectors(df, id_col, vector, label)
    books = learn(vectors, parts, entries, rounds, scale)
    coded = write_table(encode(vectors, books, scale), "coded")
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest(books)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return compress(vectors).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    near = """SELECT rid, pos, v, e, d FROM (SELECT p.rid, p.pos, p.v, c.e, list_sum(list_transform(list_zip(p.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) d, row_number() OVER (PARTITION BY p.rid, p.pos ORDER BY d, c.e) n FROM p JOIN {book} c USING (pos)) WHERE n = 1"""
    out = [f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, pos, list_slice(v, pos * (len(v) // {parts}) + 1, (pos + 1) * (len(v) // {parts})) v FROM kept, range({parts}) r(pos)),
c0 AS MATERIALIZED (SELECT pos, rid - 1 e, v FROM p WHERE rid <= {entries})"""]
    for k in range(rounds):
        out.append(f"""a{k} AS MATERIALIZED ({near.format(book=f"c{k}")}),
m{k} AS MATERIALIZED (SELECT pos, e, list(f ORDER BY i) v FROM (SELECT pos, e, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) f FROM (SELECT pos, e, i, sum(x) s, count(*) n FROM (SELECT pos, e, generate_subscripts(v, 1) i, unnest(v) x FROM a{k}) GROUP BY ALL)) GROUP BY pos, e),
c{k + 1} AS MATERIALIZED (SELECT c.pos, c.e, coalesce(m.v, c.v) v FROM c{k} c LEFT JOIN m{k} m USING (pos, e))""")
    out.append(f"""z AS MATERIALIZED ({near.format(book=f"c{rounds}")}),
coded AS (SELECT rid, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY pos) code, CAST(sum(d) AS BIGINT) error FROM z GROUP BY rid)""")
    return ",\n".join(out) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY pos, e)) FROM c{rounds}) codebooks_sha256 FROM kept JOIN coded USING (rid)"""


OP12_SQL = _sql()
