"""Small helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in rows, that an operator asks Spark to broadcast; larger sides are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Parts in which a matrix is summed, and most bytes of an Arrow batch.
PIECES, BATCH_BYTES = 16, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a local session gets a new temporary one, and a cluster's is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, where the session leaves the limit at Spark's 64 MB: a worker holds one on each side, and long texts fill it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


def trim() -> None:
    """Give back what a task's arrays have left in the allocators, as workers live on after it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


class Scratch:
    """Written tables that cut lineage: a lost executor costs one stage, never the job.

    Each table is Parquet in the shared folder. ``drop`` deletes one that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Write df as a table and read it back."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)

    def free_shuffles(self) -> None:
        """Let Spark's cleaner drop the shuffle files of finished plans now, not at its next half-hourly collection."""
        for _ in range(2):  # what the first round lets go may hold more
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df only if a count shows that it has at most ``limit`` rows; else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_or_empty(column: str = "text") -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo n (null ids: null)."""
    return F.crc32(F.col(column).cast("string")) % n


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """The columns of docs as one struct, row, beside ``more``: so no name of theirs can clash with one of an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs out of df (row)."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def text_slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[list[str]]:
    """Texts that follow one another, about ``most`` bytes at once; the others stay in Arrow meanwhile."""
    start, size = 0, 0
    for at, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 1):
        size += n
        if size > most or at == len(texts):
            yield texts.slice(start, at - start).to_pylist()
            start, size = at, 0


def list_array(flat: np.ndarray, sizes) -> pa.ListArray:
    """Lists of the given sizes, one after another in flat."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes], dtype=np.int64).astype(np.int32)), pa.array(flat))


def tree_sum(df: DataFrame, add, rows: int, cols: int) -> np.ndarray:
    """Sum a rows x cols matrix over the partitions of df; ``add(iterator of record batches)`` gives a partition's matrix.

    Partitions send the matrix in PIECES parts; sums are formed on the executors in two levels, so that
    neither a task nor the driver ever holds more than a bounded share: the driver gets one matrix.
    """
    pieces = min(PIECES, rows * cols)

    def rows_of(parts: list[tuple[int, np.ndarray]]) -> list[pa.Array]:
        return [pa.array([i for i, _ in parts], pa.int32()), list_array(np.concatenate([v for _, v in parts]), [len(v) for _, v in parts])]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.asarray(add(batches), dtype=np.float64).reshape(-1)
        yield pa.RecordBatch.from_arrays(rows_of(list(enumerate(np.array_split(m, pieces)))), ["i", "v"])

    def total(table: pa.Table) -> pa.Table:
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
        return pa.table(dict(zip(("i", "v"), rows_of([(table["i"][0].as_py(), v)]), strict=True)))

    shape = "i int, v array<double>"
    sums = df.mapInArrow(part, shape).withColumn("g", F.spark_partition_id() % 64)
    sums = sums.groupBy("i", "g").applyInArrow(lambda t: total(t), shape).groupBy("i").applyInArrow(lambda t: total(t), shape)
    found = {r["i"]: r["v"] for r in sums.collect()}
    return np.concatenate([found[i] for i in range(pieces)]).reshape(rows, cols) if found else np.zeros((rows, cols))
