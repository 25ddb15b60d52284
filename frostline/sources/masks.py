"""A store of events' masks: runs of pixels by event and frame, in Parquet that is sorted by event so that a lookup reads the row groups of one.

Two tables in a folder:

* ``runs`` (session_id, event_id, segment, first_frame, last_frame, height, width, frames, offsets, starts, lengths): the masks of an event's frames within
  one segment of the frame axis. The runs of all its frames stand one after another; those of the frame at place i of ``frames`` are the ones
  from ``offsets[i]`` up to ``offsets[i + 1]``.
* ``index`` (session_id, event_id, segments, first_frame, last_frame, n_frames, n_runs, height, width, encoding): what there is of each event.

Segments bound a row, however long an event lasts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.operators.frames import decoded, run_lengths
from frostline.operators.stream import by_key, flat_lists, lists

#: Frames of the axis in a segment, bytes of a row group.
SEGMENT, ROW_GROUP = 1024, 8 << 20
ENCODING = "rle_concat_v1"
KEYS = ["session_id", "event_id", "segment"]


def encode_masks(masks: DataFrame, height: int, width: int, segment: int = SEGMENT) -> DataFrame:
    """The rows of ``runs`` from masks (session_id, event_id, frame_idx, pos array).

    Places may stand in any order and more than once. Several rows of one frame are one mask, their union. A frame whose pos is null or empty is kept with no
    runs. A place outside height x width is an error. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (session, event, k), rows in by_key(batches, *KEYS):
            pos, sizes = flat_lists(rows["pos"])
            frame = rows["frame_idx"].to_numpy()
            if len(pos) and not (0 <= pos.min() and pos.max() < height * width):
                raise ValueError(f"event {event} has places outside {height} x {width}")
            frames = np.unique(frame)
            pair = np.unique(np.stack([np.repeat(np.searchsorted(frames, frame), sizes), pos.astype(np.int64)]), axis=1)
            start, length, owner = run_lengths(pair[1], pair[0])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner.astype(np.int64), minlength=len(frames)))])
            one = [lists(x.astype(np.int32), np.array([len(x)]), pa.int32()) for x in (frames, offsets, start, length)]
            fixed = [pa.array([x], pa.int32()) for x in (frames[0], frames[-1], height, width)]
            yield pa.RecordBatch.from_arrays([pa.array([session], pa.string()), pa.array([event], pa.string()), pa.array([k], pa.int32()), *fixed, *one], [*KEYS, "first_frame", "last_frame", "height", "width", "frames", "offsets", "starts", "lengths"])

    rows = masks.select("session_id", "event_id", F.floor(F.col("frame_idx") / F.lit(segment)).cast("int").alias("segment"), F.col("frame_idx").cast("int").alias("frame_idx"), F.col("pos").cast("array<int>").alias("pos"))
    shape = "session_id string, event_id string, segment int, first_frame int, last_frame int, height int, width int, frames array<int>, offsets array<int>, starts array<int>, lengths array<int>"
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "frame_idx").mapInArrow(run, shape)


def write_masks(masks: DataFrame, path: str, height: int, width: int, segment: int = SEGMENT) -> None:
    """Both tables of masks (session_id, event_id, frame_idx, pos array) into the folder ``path``, which they replace. Spark's committer writes each whole or not at all."""
    rows = encode_masks(masks, height, width, segment).repartitionByRange("event_id", "segment").sortWithinPartitions("event_id", "session_id", "segment")
    rows.write.mode("overwrite").option("parquet.block.size", str(ROW_GROUP)).parquet(f"{path}/runs")
    read_runs(masks.sparkSession, path).groupBy("session_id", "event_id").agg(
        F.count("*").cast("int").alias("segments"), F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), F.sum(F.size("frames")).alias("n_frames"), F.sum(F.size("starts")).alias("n_runs"),
        F.first("height").alias("height"), F.first("width").alias("width"), F.lit(ENCODING).alias("encoding"),
    ).write.mode("overwrite").parquet(f"{path}/index")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/runs")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def frames_of(runs: DataFrame) -> DataFrame:
    """(session_id, event_id, frame_idx, starts, lengths) of rows of ``runs``, a row a frame, cut out by the offsets."""
    at = runs.select("*", F.posexplode("frames").alias("i", "frame_idx"))
    low = F.element_at("offsets", F.col("i") + 1)
    cut = lambda c: F.slice(c, low + 1, F.element_at("offsets", F.col("i") + 2) - low).alias(c)
    return at.select("session_id", "event_id", "frame_idx", cut("starts"), cut("lengths"))


def read_masks(spark: SparkSession, path: str, session_id: str | None = None, event_id: str | None = None, frame_idx: int | None = None) -> DataFrame:
    """(session_id, event_id, frame_idx, pos array) of all masks, or of one session, event or frame: these reach the scan as filters, before anything is decoded."""
    rows = read_runs(spark, path)
    if session_id is not None:
        rows = rows.where(F.col("session_id") == session_id)
    if event_id is not None:
        rows = rows.where(F.col("event_id") == event_id)
    if frame_idx is not None:
        rows = rows.where((F.col("first_frame") <= frame_idx) & (F.col("last_frame") >= frame_idx))
    out = frames_of(rows)
    if frame_idx is not None:
        out = out.where(F.col("frame_idx") == frame_idx)
    return out.select("session_id", "event_id", "frame_idx", decoded(F.col("starts"), F.col("lengths")).alias("pos"))
