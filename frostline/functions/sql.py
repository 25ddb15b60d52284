"""The library's scalar functions for SQL: temporary functions of a session, written in SQL, and one table function.

register(spark) defines them; they then stand beside Spark's own in spark.sql and in expressions. SQL bodies are put into the plan, so Catalyst sees through them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from frostline.functions.scalars import TIME_FORMATS

_BARE = r"regexp_replace(trim(text), '^[()\\[\\]]+|[()\\[\\]]+$', '')"
_BOTH = "CASE WHEN trim(day) <> '' AND trim(clock) <> '' THEN concat_ws(' ', trim(day), trim(clock)) END"
#: Name, parameters, result, body.
FUNCTIONS = {
    "stable_id": ("prefix STRING, body STRING", "STRING", "concat(prefix, '_', substring(sha2(body, 256), 1, 16))"),
    "parse_centroid": ("text STRING", "STRUCT<x: DOUBLE, y: DOUBLE>", f"""CASE WHEN size(split({_BARE}, ',')) = 2 AND try_cast(trim(split({_BARE}, ',')[0]) AS DOUBLE) IS NOT NULL AND try_cast(trim(split({_BARE}, ',')[1]) AS DOUBLE) IS NOT NULL
        THEN named_struct('x', try_cast(trim(split({_BARE}, ',')[0]) AS DOUBLE), 'y', try_cast(trim(split({_BARE}, ',')[1]) AS DOUBLE)) END"""),
    "parse_local_time": ("day STRING, clock STRING, zone STRING", "TIMESTAMP", f"to_utc_timestamp(coalesce({', '.join(f'''try_to_timestamp({_BOTH}, '{f}')''' for f in TIME_FORMATS)}), zone)"),
    "clip01": ("x DOUBLE", "DOUBLE", "greatest(0D, least(1D, x))"),
    "mass_to_depth": ("mass_mg DOUBLE, area_mm2 DOUBLE", "DOUBLE", "CASE WHEN mass_mg >= 0 AND area_mm2 > 0 THEN mass_mg / area_mm2 END"),
    "depth_to_mass": ("depth_mm DOUBLE, area_mm2 DOUBLE", "DOUBLE", "CASE WHEN depth_mm >= 0 AND area_mm2 > 0 THEN depth_mm * area_mm2 END"),
    "frame_of_time": ("t TIMESTAMP, t0 TIMESTAMP, dt DOUBLE, n_frames INT", "INT", "CAST(greatest(0, least(ceil((unix_micros(t) - unix_micros(t0)) / 1e6D / dt - 0.5D), n_frames - 1)) AS INT)"),
    "match_confidence": ("dframes DOUBLE, dxy DOUBLE, frames DOUBLE, pixels DOUBLE", "DOUBLE", "greatest(0D, 1D - 0.5D * dframes / (frames + 1e-9D) - 0.5D * dxy / (pixels + 1e-9D))"),
    "rle_decode": ("starts ARRAY<INT>, lengths ARRAY<INT>", "ARRAY<INT>", "flatten(transform(arrays_zip(starts, lengths), r -> CASE WHEN r.lengths > 0 THEN sequence(r.starts, r.starts + r.lengths - 1) ELSE CAST(array() AS ARRAY<INT>) END))"),
}


class RleEncode:
    """Runs of consecutive places of an array: places in any order, doubles once, nulls left out; a null or empty array has none."""

    def eval(self, pos: list[int] | None) -> Iterator[tuple[int, int]]:
        places = np.unique(np.array([p for p in pos or () if p is not None], np.int64))
        if len(places):
            begins = np.flatnonzero(np.diff(places, prepend=places[0] - 2) != 1)
            yield from zip(places[begins].tolist(), np.diff(begins, append=len(places)).tolist(), strict=True)


def register(spark: SparkSession) -> None:
    """Define all functions in the session; defining them again changes nothing."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("rle_encode", udtf(RleEncode, returnType="start INT, length INT"))
