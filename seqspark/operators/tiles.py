"""Local alignment of long patterns with long sequences, in tiles of their matrix.

A tile is filled from the last row of the tile above it and the last column of
the tile to its left. Tiles of one diagonal don't depend on each other: each
diagonal is a job over all pairs, grouped by tile, and what it hands on is
written and read by the next. The rows that come in bring the tile's symbols, so
no task holds more than a tile's sides, its symbols and the differences along some of its rows and
columns. Each tile tells the scores of some of its best cells and what none of them surpasses;
only tiles that can reach the k-th of all are searched for cells. The
walk back goes a tile at a time, from the sides that were written, and all
alignments go together.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import Tile
from ..functions.scoring import Scoring
from ..plans.tables import shared_dir, written

#: The least side of a tile, and how many tiles a side of the longest matrix has at most; up to the side WIDE it has FEW, as every diagonal is a job.
TILE, MOST_TILES = 4096, 64
FEW, WIDE = 24, 65_536
KEYS = ("pattern_id", "seq_id", "r", "c")
TOP, LEFT, PEAK, HIGH = 0, 1, 2, 3


def _sides(table: pa.Table) -> tuple[str, str, np.ndarray, np.ndarray] | None:
    """(pattern, text, left column with its corner, row above) of a tile; None beyond the matrix, where one of them is missing."""
    at = {kind: n for n, kind in enumerate(table.column("kind").to_pylist())}
    if TOP not in at or LEFT not in at:
        return None
    p, t = (table.column("part")[at[kind]].as_py() for kind in (LEFT, TOP))
    left, above = (table.column("cells")[at[kind]].as_py() for kind in (LEFT, TOP))
    above = np.zeros(len(t) + 1, np.int32) if above is None else np.frombuffer(above, np.int32)
    left = np.zeros(len(p), np.int32) if left is None else np.frombuffer(left, np.int32)
    return p, t, np.concatenate((above[:1], left)), above[1:]


def _by_tile(df: DataFrame, apart: bool = False):
    """df by tile, over several partitions for each slot: rows are few and long to work on. apart: by ranges, so that as few tiles as can be share a task."""
    n = 4 * df.sparkSession.sparkContext.defaultParallelism
    return (df.repartitionByRange if apart else df.repartition)(n, *KEYS).groupBy(*KEYS)


def align_long(seqs: DataFrame, patterns: DataFrame, k: int, scoring: Scoring, per_pair: bool = False, side: int | None = None) -> DataFrame:
    """What align() gives, without ranks, of at least the k best cells of each pattern (or pair): (pattern_id, seq_id, score, x_end, y_end, x_start, y_start, aligned_p, aligned_s)."""
    from .align import best, chunks

    spark = seqs.sparkSession
    kind = dict(seqs.dtypes)["seq_id"]
    rows = f"pattern_id long, seq_id {kind}, r int, c int, kind int, score int, part string, cells binary"
    seqs = written(seqs.where(F.length("seq") > 0).select("seq_id", "seq"), "long-seqs")
    patterns = written(patterns.where(F.length("seq") > 0).select(F.col("pattern_id").cast("long").alias("pattern_id"), "seq"), "long-patterns")
    n, m = (df.agg(F.max(F.length("seq"))).first()[0] or 0 for df in (seqs, patterns))
    side = side or max(TILE, -(-max(n, m) // MOST_TILES), min(-(-max(n, m) // FEW), WIDE))
    where = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"

    zero, none, nothing = F.lit(0).alias, F.lit(None).cast("binary").alias("cells"), F.lit(None).cast("int").alias("score")
    tops = chunks(seqs, side, 0).crossJoin(patterns.select("pattern_id")).select("pattern_id", "seq_id", zero("r"), F.col("chunk_idx").alias("c"), F.lit(TOP).alias("kind"), nothing, "part", none)
    cut = chunks(patterns.withColumnRenamed("pattern_id", "seq_id"), side, 0).withColumnRenamed("seq_id", "pattern_id")
    lefts = cut.crossJoin(seqs.select("seq_id")).select("pattern_id", "seq_id", F.col("chunk_idx").alias("r"), zero("c"), F.lit(LEFT).alias("kind"), nothing, "part", none)
    tops.unionByName(lefts).withColumn("d", F.col("r") + F.col("c")).write.partitionBy("d").parquet(f"{where}/begin")

    def come_in(d: int) -> DataFrame:
        """What comes into the tiles of a diagonal: from the one before it, and at the matrix's own sides."""
        some = [f"{where}/begin/d={d}"] if d < max(-(-n // side), -(-m // side)) else []
        some += [f"{where}/edges/{d}"] if d else []
        return spark.read.schema(rows).parquet(*some).where(F.col("kind").isin(TOP, LEFT))

    def handed_on(table: pa.Table) -> pa.Table:
        sides = _sides(table)
        if sides is None:
            return table.slice(0, 0)
        p, t, left, above = sides
        tile = Tile(p, t, left, above, scoring, k)
        ids = [table.column(x)[0] for x in KEYS]
        r, c = ids[2].as_py(), ids[3].as_py()
        bottom, right = np.append(left[-1:], tile.bottom).astype(np.int32), tile.right.astype(np.int32)
        told = [(r + 1, c, TOP, None, t, bottom.tobytes()), (r, c + 1, LEFT, None, p, right.tobytes()), (r, c, HIGH, tile.high, None, None), *((r, c, PEAK, v, None, None) for v in tile.peaks)]
        columns = [pa.array([i.as_py()] * len(told), i.type) for i in ids[:2]] + [pa.array(x, y) for x, y in zip(zip(*told, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()), strict=True)]
        return pa.Table.from_arrays(columns, names=table.column_names)

    last = -(-n // side) + -(-m // side) - 1
    for d in range(last):
        _by_tile(come_in(d), apart=True).applyInArrow(handed_on, rows).write.parquet(f"{where}/edges/{d + 1}")

    of = ["pattern_id", "seq_id"] if per_pair else ["pattern_id"]
    if not last > 0:
        scores = spark.createDataFrame([], rows)
    else:
        scores = spark.read.schema(rows).parquet(*(f"{where}/edges/{d + 1}" for d in range(last)))
    kth = scores.where(F.col("kind") == PEAK).withColumn("n", F.row_number().over(W.partitionBy(*of).orderBy(F.desc("score")))).where(F.col("n") == k).select(*of, F.col("score").alias("least"))
    reached = written(scores.where(F.col("kind") == HIGH).select(*KEYS, "score").join(kth, of, "left").withColumn("least", F.coalesce("least", F.lit(1))).where("score >= least").select(*KEYS, "least"), "tiles")

    def of_tiles(tiles: DataFrame) -> DataFrame | None:
        """The sides of some tiles, from the diagonals where they lie; None where there are no tiles."""
        diagonals = sorted(x[0] for x in tiles.select(F.col("r") + F.col("c")).distinct().collect())
        out = None
        for d in diagonals:
            out = come_in(d) if out is None else out.unionByName(come_in(d))
        return out if out is None else out.join(F.broadcast(tiles.select(*KEYS).distinct()), list(KEYS), "left_semi")

    hit = f"pattern_id long, seq_id {kind}, score int, x_end long, y_end long"

    def cells(sides: pa.Table, tile: pa.Table) -> pa.Table:
        found = _sides(sides) if tile.num_rows else None
        x, y, v = [np.zeros(0, np.int64)] * 3
        if found is not None:
            p, t, left, above = found
            x, y, v = Tile(p, t, left, above, scoring, k, keep=True).best(tile.column("least")[0].as_py())
            x, y = x + tile.column("r")[0].as_py() * side, y + tile.column("c")[0].as_py() * side
        ids = [tile.column(i).take(pa.array([0] * len(v), pa.int64())) for i in KEYS[:2]]
        return pa.Table.from_arrays([*ids, pa.array(v, pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["pattern_id", "seq_id", "score", "x_end", "y_end"])

    met = of_tiles(reached)
    met = spark.createDataFrame([], rows) if met is None else met
    hits = written(best(_by_tile(met).cogroup(_by_tile(reached)).applyInArrow(cells, hit), k, per_pair), "long-hits")

    walk = f"pattern_id long, seq_id {kind}, rank int, x long, y long, ap string, as_ string"
    path = f"{where}/walk"
    hits.select("pattern_id", "seq_id", F.col("rank").cast("int").alias("rank"), F.col("x_end").alias("x"), F.col("y_end").alias("y"), F.lit("").alias("ap"), F.lit("").alias("as_"), F.lit(True).alias("going")).write.parquet(f"{path}/step=0")

    def walked(sides: pa.Table, cells: pa.Table) -> pa.Table:
        found = _sides(sides)
        base = [cells.column(i)[0].as_py() * side for i in ("r", "c")]
        known: dict[tuple[int, int], tuple] = {}
        tile, blocks = None, {}
        m, n = (pc.max(cells.column(x)).as_py() - b + 1 for x, b in zip(("x", "y"), base, strict=True))
        out = []
        for at in zip(cells.column("x").to_pylist(), cells.column("y").to_pylist(), strict=True):
            if at not in known:
                if tile is None:  # as far as the walks begin
                    p, t, left, above = found
                    tile = Tile(p[:m], t[:n], left[: m + 1], above[:n], scoring, k, keep=True)
                i, j, ap, as_ = tile.walk(at[0] - base[0], at[1] - base[1], blocks)
                x, y = base[0] + i - 1, base[1] + j - 1
                known[at] = (x, y, ap, as_, (i == 0 or j == 0) and x >= 0 and y >= 0)
            out.append(known[at])
        names = ("x", "y", "ap", "as_", "going")
        columns = [cells.column(i) for i in ("pattern_id", "seq_id", "rank")] + [pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)]
        return pa.Table.from_arrays(columns, names=["pattern_id", "seq_id", "rank", *names])

    step = 0
    while True:
        live = spark.read.schema(walk + ", going boolean").parquet(f"{path}/step={step}").where("going")
        live = live.select("pattern_id", "seq_id", "rank", "x", "y", F.floor(F.col("x") / side).cast("int").alias("r"), F.floor(F.col("y") / side).cast("int").alias("c"))
        met = of_tiles(live)
        if met is None:
            break
        step += 1
        _by_tile(met).cogroup(_by_tile(live)).applyInArrow(walked, walk + ", going boolean").write.parquet(f"{path}/step={step}")

    steps = spark.read.schema(walk + ", going boolean, step int").parquet(path)
    parts = F.reverse(F.array_sort(F.collect_list(F.struct("step", "x", "y", "ap", "as_"))))
    whole = steps.groupBy("pattern_id", "seq_id", "rank").agg(parts.alias("parts"))
    told = [F.array_join(f"parts.{n}", "").alias(a) for n, a in (("ap", "aligned_p"), ("as_", "aligned_s"))]
    begun = whole.select("pattern_id", "seq_id", F.col("rank").alias("__rank"), (F.col("parts")[0]["x"] + 1).cast("int").alias("x_start"), (F.col("parts")[0]["y"] + 1).alias("y_start"), *told)
    return hits.withColumnRenamed("rank", "__rank").join(begun, ["pattern_id", "seq_id", "__rank"]).select("pattern_id", "seq_id", "score", F.col("x_end").cast("int").alias("x_end"), "y_end", "x_start", "y_start", "aligned_p", "aligned_s")
