"""A stored table gone through as a stream: what a running query would have given for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The session of the row that ends a backfill.
END = "\x00end"
#: The state store that the operators in order of time need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside spark, with its tables and files, whose streams keep their state in RocksDB."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


def backfill(spark: SparkSession, rows: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, batches: int = 4, t: str = "t", session: str = "session_id") -> DataFrame:
    """The operator's rows for all of rows, which are written under ``path`` and read again in micro-batches in order of time, about as many.

    A row far ahead of all others ends the stream, so that the watermark passes every row; what the operator gives for it is left out. Rows without a time are left out
    too. The folder must be one that the driver and all executors share; spark should be a stateful_session for operators that hold rows in order of time.
    """
    rows = rows.where(F.col(t).isNotNull())
    at = F.unix_micros(t)
    low, high = rows.agg(F.min(at), F.max(at)).first()
    low, high = (0, 0) if low is None else (low, high)
    bucket = F.least(F.lit(batches - 1), F.floor((at - low) * batches / F.lit(max(1, high - low))))
    for k in range(batches):
        rows.where(bucket == k).write.mode("append").parquet(f"{path}/in")
    end = [F.lit(END).cast(f.dataType).alias(f.name) if f.name == session else F.timestamp_micros(F.lit(high + 10**15)).cast(f.dataType).alias(f.name) if f.name == t else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
    spark.range(1).select(*end).write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1 + _files(spark, f"{path}/in") // batches).parquet(f"{path}/in")
    made = operator(source)
    query = made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(made.schema).parquet(f"{path}/out")
    return out.where(F.col(session).isNull() | (F.col(session) != END)) if session in out.columns else out


def _files(spark: SparkSession, path: str) -> int:
    return len(spark.read.parquet(path).inputFiles())
