"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import shared_dir


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df under the shared folder and reads it back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes what write_table has written, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(conf).delete(path, True)


BATCH, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Bounds what goes to Python at once by bytes, where the session leaves the default: texts differ in length by orders of magnitude.

    Spark reads this setting when a plan runs, after its caller has returned, so
    it can be neither an option of one table nor put back; set it on the session to keep another.
    """
    if spark.conf.get(BATCH) == BATCH_DEFAULT:
        spark.conf.set(BATCH, "8m")


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns every operator reads; extra columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def digest(text: Column) -> Column:
    """128 bits that stand for a text: the first half of its SHA-256; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, bits: int = 22) -> DataFrame:
    """df with a boolean __maybe, false only where the key (a hash, as long) is none of those in keys' first column.

    A bit table of fixed size goes to every task: at most 2^(bits - 6) rows of
    two numbers, however many keys there are. Rows that pass are for an exact
    join; the others need not be shuffled.
    """
    own = keys.select(F.pmod(F.col(keys.columns[0]), F.lit(1 << bits)).alias("__bit"))
    words = own.groupBy(F.shiftright("__bit", 6).cast("int").alias("__w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__bit & 63 AS int))")).alias("__v"))
    marked = df.withColumn("__bit", F.pmod(key, F.lit(1 << bits))).withColumn("__w", F.shiftright("__bit", 6).cast("int"))
    met = marked.join(F.broadcast(words), "__w", "left").withColumn("__maybe", F.expr("coalesce(shiftright(__v, cast(__bit & 63 AS int)) & 1, 0) = 1"))
    return met.drop("__bit", "__w", "__v")


def remainder(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo the fold count; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


#: What this worker process keeps between tasks: one table at most, of the operator that ran last.
_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """The table of this key, made on first use; making one lets go of any other's."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Lets go of what another operator's tasks have left in this process."""
    _held.clear()
    trim()


def trim() -> None:
    """Gives freed memory back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., list[tuple]]], slice_bytes: int = 8 << 20, keeps: bool = False) -> DataFrame:
    """df through a function of column lists, by Arrow batches, in slices of bounded size.

    make runs once in each task and returns f(*column lists) -> row tuples. keeps
    tells that make calls held(); otherwise what is held is let go.
    """
    names = df.columns
    bound_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        f = make()
        for batch in batches:
            step = max(1, int(batch.num_rows * slice_bytes / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = f(*(part.column(n).to_pylist() for n in range(len(names))))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, out, strict=True)], schema=out)
        trim()

    return df.mapInArrow(run, schema)
