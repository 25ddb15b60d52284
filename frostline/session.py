"""Session construction for local work and tests; on a cluster the submitted session is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "frostline", **conf: str) -> SparkSession:
    """A local session with UTC times, AQE and few shuffle partitions.

    Cluster runs bring their own session. Operators set two of its values only, and only where they are left at Spark's own: the training-data
    ones take Arrow batches of 4 MB for 64 MB, and a local session without spark.checkpoint.dir gets a temporary folder.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that functions in it can be unpickled in any working folder."""
    import os
    import shutil
    import tempfile

    context = spark.sparkContext
    if getattr(context, "_frostline_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "frostline")
    context.addPyFile(shutil.make_archive(name, "zip", root, "frostline"))
    context._frostline_shipped = True
