"""Sources and sinks: raw tables with quarantine, frames, artifacts with provenance."""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass
from datetime import UTC, datetime
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.functions import scalars as S
from frostline.sources.files import with_row_numbers

#: Raw columns of observation and reference tables. Fixed values.
OBSERVATION = {"Time to Evaporate (Sec)": "time_to_evaporate_s", "Mass (mg)": "mass_mg", "Max Area (mm^2)": "max_area_mm2", "Temp (C)": "temp_c"}
CENTROID = "Centroid location (x, y)"
REFERENCE = {"SWE (mm)": "swe_mm", "SWE Rate (mm/hr)": "swe_rate_mmhr"}


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A .csv or .txt table with all columns as text, .parquet as it is; with source_file and row_index.

    row_index is a row's number in its file, from 0, however files are split between tasks. Other suffixes are an error before anything is planned.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "txt"):
        raw = spark.read.option("header", True).csv(path)
    elif suffix == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported table type: {path}")
    return with_row_numbers(raw)


def require(df: DataFrame, *columns: str) -> None:
    """An error that names the columns df lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def _extras(df: DataFrame, known: set[str]) -> Column:
    rest = sorted(c for c in df.columns if c not in known)
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])) if rest else F.lit("{}")


def normalise_observations(raw: DataFrame, zone: str = "America/New_York") -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) observations from a raw table with Date, Time and centroid columns.

    A row with a bad time is quarantined for that, else for a bad centroid. Bad numbers are null. Columns without a role are kept as JSON in raw_json.
    """
    require(raw, "Date", "Time", CENTROID)
    t, c = S.parse_local_time(F.col("Date"), F.col("Time"), zone), S.centroid(F.col(f"`{CENTROID}`"))
    known = {"Date", "Time", CENTROID, "row_index", "source_file", *OBSERVATION}
    numbers = [(S.number(F.col(f"`{k}`")) if k in raw.columns else F.lit(None).cast("double")).alias(v) for k, v in OBSERVATION.items()]
    rows = raw.select(
        t.alias("t_utc"), F.concat_ws(" ", "Date", "Time").alias("t_local_raw"), F.col("Date").alias("date_raw"), F.col("Time").alias("time_raw"), c.alias("c"), *numbers,
        "source_file", "row_index", _extras(raw, known).alias("raw_json"), F.when(t.isNull(), "time_parse_failed").when(c.isNull(), "centroid_parse_failed").alias("reason"),
    )
    key = S.stable_id("particle", row=F.col("row_index"), source=F.col("source_file"), t=F.col("t_local_raw"))
    valid = rows.where("reason is null").select(
        key.alias("particle_event_id"), "t_utc", "t_local_raw", "date_raw", "time_raw", F.col("c.x").alias("x_px"), F.col("c.y").alias("y_px"), *OBSERVATION.values(), "source_file", "row_index", "raw_json"
    )
    return valid, rows.where("reason is not null").select("row_index", "reason", "date_raw", "time_raw", "raw_json")


def normalise_reference(raw: DataFrame, zone: str = "America/New_York") -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) reference series rows from a raw table with Date, Time and SWE columns."""
    require(raw, "Date", "Time", "SWE (mm)")
    t = S.parse_local_time(F.col("Date"), F.col("Time"), zone)
    known = {"Date", "Time", "row_index", "source_file", *REFERENCE}
    numbers = [(S.number(F.col(f"`{k}`")) if k in raw.columns else F.lit(None).cast("double")).alias(v) for k, v in REFERENCE.items()]
    rows = raw.select(
        t.alias("t_utc"), F.concat_ws(" ", "Date", "Time").alias("t_local_raw"), *numbers, "source_file", "row_index", _extras(raw, known).alias("raw_json"), F.when(t.isNull(), "time_parse_failed").alias("reason"),
    )
    key = S.stable_id("processed", row=F.col("row_index"), source=F.col("source_file"), t=F.col("t_local_raw"))
    return rows.where("reason is null").select(key.alias("processed_row_id"), *[c for c in rows.columns if c != "reason"]), rows.where("reason is not null").select("row_index", "reason", "t_local_raw", "raw_json")


FRAMES = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("frame_idx", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("pixels", T.ArrayType(T.IntegerType()))])


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames as Parquet: session_id, frame_idx, height, width, pixels row by row. Partition them by session_id: scans then read one session alone."""
    return spark.read.schema(FRAMES).parquet(path)


def write_frames(frames: DataFrame, path: str) -> None:
    frames.select(*FRAMES.fieldNames()).write.mode("overwrite").partitionBy("session_id").parquet(path)


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces; dataclasses count as their fields. NaN and infinity are an error."""
    return json.dumps(asdict(value) if is_dataclass(value) else value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def config_hash(config: object) -> str:
    """The sha256 of a configuration's canonical JSON."""
    return sha256(canonical(config).encode()).hexdigest()


def wrap(payload: object, schema_version: str, config_hash: str, input_hashes: dict[str, str], artifact_type: str | None = None, **provenance: object) -> str:
    """A small JSON artifact: header and payload, keys in order, no NaN. Its type and what else is told of its making stand in the header."""
    header = {"schema_version": schema_version, "config_hash": config_hash, "input_hashes": input_hashes, "created_at_utc": datetime.now(UTC).isoformat()}
    header |= ({"artifact_type": artifact_type} if artifact_type else {}) | ({"provenance": provenance} if provenance else {})
    return json.dumps({"header": header, "payload": payload}, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False)


def write_artifact(spark: SparkSession, path: str, text: str) -> None:
    """One artifact's text as a file in the folder ``path``, which it replaces; Spark's committer writes it whole or not at all, in any store that Spark reaches."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def with_provenance(df: DataFrame, schema_version: str, config_hash: str) -> DataFrame:
    """df with the columns that say what made it."""
    return df.withColumn("schema_version", F.lit(schema_version)).withColumn("config_hash", F.lit(config_hash))


def write_table(df: DataFrame, path: str, schema_version: str, config_hash: str, partition_by: str = "session_id") -> None:
    """Parquet with provenance columns, a folder a session; Spark's committer makes the write all or nothing."""
    out = with_provenance(df, schema_version, config_hash)
    writer = out.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by in out.columns else writer).parquet(path)


def as_json_records(df: DataFrame, key: str) -> DataFrame:
    """One JSON text a row with nulls for NaN, in order of key."""
    clean = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema]
    return df.select(*clean).select(key, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record")).orderBy(key)
