"""Tables written between stages: they cut a long plan, and a lost executor costs one stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Parquet tables in a new folder of the shared folder in spark.checkpoint.dir, or of a temporary one where that is unset (local tests)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        base = root or spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = base or tempfile.mkdtemp(prefix="spark-shared-")
        self.root = f"{base.rstrip('/')}/session-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")
