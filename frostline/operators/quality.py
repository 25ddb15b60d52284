"""How well rows map to frames, and plain summaries of series and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.scalars import clip01
from frostline.operators.selection import medians, quantiles


def mapping_quality(mapped: DataFrame, cadence_confidence: float = 0.5) -> DataFrame:
    """(session_id, n, n_mapped, coverage, median_residual, confidence) of rows mapped to frames. The median is of signed residuals, so that it shows a shifted clock."""
    out = mapped.groupBy("session_id").agg(F.count("*").alias("n"), F.count("frame_idx").alias("n_mapped"), F.median(F.when(F.col("frame_idx").isNotNull(), F.col("residual"))).alias("median_residual"))
    out = out.withColumn("coverage", F.col("n_mapped") / F.col("n"))
    return out.withColumn("confidence", clip01(0.6 * F.lit(cadence_confidence) + 0.4 * F.col("coverage")))


def alignment_confidence(observed: DataFrame, reference: DataFrame, cadence: DataFrame) -> DataFrame:
    """(session_id, coverage_observed, coverage_reference, coverage, alignment_confidence) of the sessions of cadence (session_id, confidence).

    observed, reference: rows mapped to frames. coverage is the greater share of the two that are mapped, 0 for a table without rows.
    """
    share = lambda df, name: df.groupBy("session_id").agg((F.count("frame_idx") / F.count("*")).alias(name))
    out = cadence.select("session_id", "confidence").join(share(observed, "coverage_observed"), "session_id", "left").join(share(reference, "coverage_reference"), "session_id", "left")
    out = out.na.fill(0.0, ["coverage_observed", "coverage_reference"]).withColumn("coverage", F.greatest("coverage_observed", "coverage_reference"))
    return out.withColumn("alignment_confidence", clip01(0.6 * F.col("confidence") + 0.4 * F.col("coverage"))).drop("confidence")


def describe(rows: DataFrame, value: str) -> DataFrame:
    """(session_id, n, mean, std (of a sample), least, q25, q50, q75, largest) of a column's values."""
    plain = rows.groupBy("session_id").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("largest"))
    q = quantiles(rows, ["session_id"], {f"q{p}": (F.col(value), p / 100) for p in (25, 50, 75)}).withColumnRenamed("session_id", "sid")
    return plain.join(q, plain["session_id"].eqNullSafe(q["sid"])).select("session_id", "n", "mean", "std", "least", "q25", "q50", "q75", "largest")


def time_offset(a: DataFrame, b: DataFrame, t: str = "t") -> DataFrame:
    """(session_id, offset): the median time of a less that of b, in seconds."""
    mid = lambda df, name: medians(df, ["session_id"], **{name: F.unix_micros(t)})
    return mid(a, "a").join(mid(b, "b"), "session_id").select("session_id", ((F.col("a") - F.col("b")) / 1e6).alias("offset"))


def count_by_time(rows: DataFrame, t: str = "t") -> DataFrame:
    return rows.groupBy("session_id", t).agg(F.count("*").alias("n"))
