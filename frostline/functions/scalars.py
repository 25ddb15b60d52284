"""Scalar column functions: tolerant parsing, ids, units, coordinates. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of local date and time texts, tried in this order. Fixed values.
TIME_FORMATS = (
    "yyyy-M-d H:m:s",
    "yyyy/M/d H:m:s",
    "M/d/yyyy H:m:s",
    "yyyy-M-d H:m:s[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]",
    "M/d/yyyy H:m:s[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]",
)


def parse_local_time(date: Column, time: Column, zone: str = "UTC") -> Column:
    """UTC timestamp of local date and time texts; null where either is missing or no format fits. Clock gaps shift forward, overlaps take the first hour."""
    both = F.when((F.trim(date) != "") & (F.trim(time) != ""), F.concat_ws(" ", F.trim(date), F.trim(time)))
    return F.to_utc_timestamp(F.coalesce(*[F.try_to_timestamp(both, F.lit(f)) for f in TIME_FORMATS]), zone)


def number(x: Column) -> Column:
    """Double of a text or number; null for what is none. NaN counts as null."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d), d)


def centroid(text: Column) -> Column:
    """Struct (x, y) of texts like "(12.3, 45.6)"; null unless there are just two numbers. "nan" is a number."""
    parts = F.split(F.regexp_replace(F.trim(text), r"^[()\[\]]+|[()\[\]]+$", ""), ",")
    x, y = (F.trim(F.get(parts, F.lit(k))).try_cast("double") for k in range(2))
    return F.when((F.size(parts) == 2) & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def stable_id(prefix: str, **fields: Column) -> Column:
    """prefix_ and the first 16 hex digits of the sha256 of the fields as compact JSON with sorted keys."""
    body = F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(body, 256), 1, 16))


def iso(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6)


def shift_seconds(t: Column, seconds: float) -> Column:
    """t moved by an offset in seconds, to the microsecond."""
    return F.timestamp_micros(F.unix_micros(t) + F.lit(round(seconds * 1e6)))


def mass_to_depth(mass_mg: Column, area_mm2: Column | float) -> Column:
    """Water depth in mm of a mass over an area (1 mg of water is 1 mm3); null for negative masses and areas that are not positive."""
    area = area_mm2 if isinstance(area_mm2, Column) else F.lit(float(area_mm2))
    return F.when((mass_mg >= 0) & (area > 0), mass_mg / area)


def depth_to_mass(depth_mm: Column, area_mm2: Column | float) -> Column:
    area = area_mm2 if isinstance(area_mm2, Column) else F.lit(float(area_mm2))
    return F.when((depth_mm >= 0) & (area > 0), depth_mm * area)


def pixel(x: Column, y: Column, height: int, width: int) -> Column:
    """Struct (y, x) of the pixel nearest to a point, halves to even; null outside the frame."""
    py, px = F.bround(y).cast("int"), F.bround(x).cast("int")
    return F.when(py.between(0, height - 1) & px.between(0, width - 1), F.struct(py.alias("y"), px.alias("x")))


def linear_mass(energy: Column, slope: float = 3e-4, intercept: float = 0.0) -> Column:
    """Struct (mass, uncertainty) of an energy proxy; the uncertainty is a quarter of the mass."""
    mass = F.lit(slope) * energy + F.lit(intercept)
    return F.struct(mass.alias("mass"), (F.lit(0.25) * F.abs(mass)).alias("uncertainty"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
