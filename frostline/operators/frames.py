"""Operators on image stacks: rows (session_id, frame_idx, pixels array). Frames stay arrays throughout; pixels become rows in results alone."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from frostline.functions.scalars import clip01
from frostline.operators.series import changepoints
from frostline.operators.stream import by_key, flat_lists, lists

MAD = 1.4826
#: Values of a tile of pixels over the frames of a session, most pixels of a tile, frames in a piece of a session, pixels opened at once.
TILE_VALUES, TILE, PIECE, DENSE = 4 << 20, 1024, 256, 32 << 20


def _array_median(a: Column) -> Column:
    """The median of an array's values, without leaving the row."""
    s = F.array_sort(a)
    n = F.size(s)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2.0


def frame_medians(frames: DataFrame) -> DataFrame:
    """(session_id, frame_idx, baseline): the median of each frame's pixels; no shuffle."""
    px = F.transform("pixels", lambda v: v.cast("double"))
    return frames.where(F.size("pixels") > 0).select("session_id", "frame_idx", _array_median(px).alias("baseline"))


def frame_activity(frames: DataFrame) -> DataFrame:
    """(session_id, frame_idx, activity): the mean distance of a frame's pixels from their median; no shuffle."""
    px = frames.where(F.size("pixels") > 0).select("session_id", "frame_idx", F.transform("pixels", lambda v: v.cast("double")).alias("p"))
    px = px.withColumn("m", _array_median(F.col("p")))
    total = F.aggregate("p", F.lit(0.0), lambda acc, v: acc + F.abs(v - F.col("m")))
    return px.select("session_id", "frame_idx", (total / F.size("p")).alias("activity"))


def quiescent_frames(activity: DataFrame, share: float = 0.2, least: int = 30) -> DataFrame:
    """The calmest frames of each session: max(round(share * n), least) of its n, ties to the earlier frame."""
    if not 0 < share <= 1:
        raise ValueError("share must be over 0 and 1 at most")
    calm = Window.partitionBy("session_id").orderBy("activity", "frame_idx")
    every = Window.partitionBy("session_id")
    k = F.greatest(F.bround(F.count("*").over(every) * F.lit(share)).cast("int"), F.lit(least))
    return activity.withColumn("rank", F.row_number().over(calm)).withColumn("k", k).where("rank <= k").select("session_id", "frame_idx", "activity")


def _stacked(rows: pa.Table, column: str) -> np.ndarray:
    """Lists as the rows of a matrix, short ones filled up with NaN."""
    flat, sizes = flat_lists(rows[column])
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.float64, copy=False)
    out = np.full((len(sizes), width), np.nan)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _median(values: np.ndarray) -> np.ndarray:
    """Of each column, without NaN; NaN for a column without values."""
    if not np.isnan(values).any():
        return np.median(values, axis=0)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        return np.nanmedian(values, axis=0)


def pixel_state(frames: DataFrame, dead_eps: float = 1e-6, values: int = TILE_VALUES) -> DataFrame:
    """(session_id, median, noise, nonuniformity, dead: arrays, one value a pixel) over the frames given (the quiescent ones, as a rule).

    noise is 1.4826 times the median absolute deviation; nonuniformity the median less the session's median of medians. Dead pixels have
    no noise or a median at either end of the sensor's range. Null and NaN pixels are left out; frames without pixels too. An empty table gives none.

    Frames are cut into tiles of neighbouring pixels, which are dealt out by (session, tile): a task holds one tile of all frames, of ``values`` values at
    most; more frames make tiles narrower, so no session is too long for a task until it has ``values`` frames.
    """
    frames = frames.where(F.size("pixels") > 0)
    most = frames.groupBy("session_id").count().agg(F.max("count")).first()[0] or 1
    if most > values:
        raise ValueError(f"a session has {most} frames to take the state from; {values} at most")
    tile = max(1, min(TILE, values // most))
    last = F.floor((F.size("pixels") - 1) / F.lit(tile)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(F.col("pixels").cast("array<double>"), k * tile + 1, F.lit(tile)))
    tiles = frames.select("session_id", F.posexplode(cut).alias("tile", "v")).repartition("session_id", "tile").sortWithinPartitions("session_id", "tile")

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (session, k), rows in by_key(batches, "session_id", "tile"):
            v = _stacked(rows, "v")
            m = _median(v)
            both = [lists(x, np.array([len(x)]), pa.float64()) for x in (m, MAD * _median(np.abs(v - m)))]
            yield pa.RecordBatch.from_arrays([pa.array([session]), pa.array([k], pa.int32()), *both], ["session_id", "tile", "m", "s"])

    def whole(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("tile")
        m, s = (flat_lists(rows[c])[0] for c in "ms")
        dead = (s <= dead_eps) | (m <= 0) | (m >= 65535)
        one = lambda x, kind: lists(x, np.array([len(x)]), kind)
        arrays = [one(m, pa.float64()), one(s, pa.float64()), one(m - _median(m[:, None])[0], pa.float64()), one(dead, pa.bool_())]
        return pa.Table.from_arrays([rows["session_id"].slice(0, 1).combine_chunks(), *arrays], ["session_id", "median", "noise", "nonuniformity", "dead"])

    done = tiles.mapInArrow(medians, "session_id string, tile int, m array<double>, s array<double>")
    return done.groupBy("session_id").applyInArrow(whole, "session_id string, median array<double>, noise array<double>, nonuniformity array<double>, dead array<boolean>")


def state_pixels(state: DataFrame, width: int) -> DataFrame:
    """(session_id, y, x, median, noise, nonuniformity, dead): the state a row a pixel."""
    out = state.select("session_id", F.posexplode(F.arrays_zip("median", "noise", "nonuniformity", "dead")).alias("pos", "p"))
    return out.select("session_id", F.expr(f"pos div {width}").cast("int").alias("y"), (F.col("pos") % width).alias("x"), "p.*")


def cold_frames(frames: DataFrame, state: DataFrame, k_sigma: float = 5.0, piece: int = PIECE) -> DataFrame:
    """(session_id, frame_idx, pos, c, v: arrays) of the pixels that lie more than k noises under nothing once corrected; frames without any have no row.

    c is the pixel less its frame's median and its own nonuniformity, 0 where it is dead; v the pixel, pos its row-major place. NaN is never cold. Frames of a
    session without a state are left out. Sessions are cut into pieces of frames, each of which gets the session's state, one row of arrays, as its first row: so
    frames travel once as arrays, and a long session is shared out.
    """
    at = F.floor(F.col("frame_idx") / F.lit(piece)).alias("piece")
    none = lambda kind: F.lit(None).cast(kind)
    some = frames.where(F.size("pixels") > 0)
    body = some.select("session_id", at, F.col("frame_idx").cast("int").alias("frame_idx"), F.col("pixels").cast("array<double>").alias("a"), none("array<double>").alias("noise"), none("array<boolean>").alias("dead"))
    heads = state.join(some.select("session_id", at).distinct(), "session_id").select("session_id", "piece", none("int").alias("frame_idx"), F.col("nonuniformity").alias("a"), "noise", "dead")
    dealt = heads.unionByName(body).repartition("session_id", "piece").sortWithinPartitions("session_id", "piece", F.asc_nulls_first("frame_idx"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (session, _), rows in by_key(batches, "session_id", "piece"):
            if rows["frame_idx"][0].is_valid:
                continue
            uneven, noise, dead = (flat_lists(rows[c].slice(0, 1))[0] for c in ("a", "noise", "dead"))
            rows = rows.slice(1)
            v = _stacked(rows, "a")
            if v.shape[1] != len(noise):
                raise ValueError(f"frames of session {session} have {v.shape[1]} pixels, its state {len(noise)}")
            c = v - _median(v.T)[:, None] - uneven
            c[:, dead.astype(bool)] = 0.0
            cold = c < -(k_sigma * noise)
            sizes, k = cold.sum(axis=1), cold.any(axis=1)
            where = np.nonzero(cold)
            columns = [lists(x, sizes[k], kind) for x, kind in ((where[1].astype(np.int32), pa.int32()), (c[where], pa.float64()), (v[where], pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array([session] * int(k.sum()), pa.string()), rows["frame_idx"].combine_chunks().filter(pa.array(k)), *columns], ["session_id", "frame_idx", "pos", "c", "v"])

    return dealt.mapInArrow(run, "session_id string, frame_idx int, pos array<int>, c array<double>, v array<double>")


def mask_pixels(mask: DataFrame, width: int, *values: str) -> DataFrame:
    """(session_id, frame_idx, pos, y, x, ...values): masks (session_id, frame_idx, pos array, ...) a row a pixel."""
    out = mask.select("session_id", "frame_idx", F.explode(F.arrays_zip("pos", *values)).alias("p")).select("session_id", "frame_idx", "p.*")
    return out.select("session_id", "frame_idx", "pos", F.expr(f"pos div {width}").cast("int").alias("y"), (F.col("pos") % width).alias("x"), *values)


def opened(mask: DataFrame, height: int, width: int) -> DataFrame:
    """3 x 3 opening of masks (session_id, frame_idx, pos array): erosion (all nine set), then dilation; outside counts as unset. Masks that vanish have no row."""

    def around(m: np.ndarray, how) -> np.ndarray:
        p = np.pad(m, ((0, 0), (1, 1), (1, 1)))
        return how.reduce([p[:, i : i + height, j : j + width] for i in range(3) for j in range(3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, DENSE // (height * width))
        for whole in batches:
            for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                pos, sizes = flat_lists(batch["pos"])
                m = np.zeros((batch.num_rows, height * width), bool)
                m[np.repeat(np.arange(batch.num_rows), sizes), pos.astype(np.int64)] = True
                m = around(around(m.reshape(-1, height, width), np.logical_and), np.logical_or).reshape(batch.num_rows, -1)
                k = m.any(axis=1)
                kept = batch.filter(pa.array(k))
                yield pa.RecordBatch.from_arrays([kept["session_id"], kept["frame_idx"], lists(np.nonzero(m)[1].astype(np.int32), m.sum(axis=1)[k], pa.int32())], ["session_id", "frame_idx", "pos"])

    return mask.select("session_id", "frame_idx", "pos").mapInArrow(run, "session_id string, frame_idx int, pos array<int>")


def run_lengths(pos: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, owner) of runs of consecutive places, which rise within each owner; owners rise too."""
    if not len(pos):
        return pos, pos, owner
    begins = np.flatnonzero((np.diff(pos, prepend=pos[0] - 2) != 1) | (np.diff(owner, prepend=-1) != 0))
    return pos[begins], np.diff(begins, append=len(pos)), owner[begins]


def rle_runs(mask: DataFrame) -> DataFrame:
    """(session_id, frame_idx, starts, lengths: arrays): runs of consecutive set pixels of masks (session_id, frame_idx, pos array in any order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, sizes = flat_lists(batch["pos"])
            pair = np.unique(np.stack([np.repeat(np.arange(batch.num_rows), sizes), pos.astype(np.int64)]), axis=1)
            start, length, owner = run_lengths(pair[1], pair[0])
            n = np.bincount(owner, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["session_id"], batch["frame_idx"], *(lists(x.astype(np.int32), n, pa.int32()) for x in (start, length))], ["session_id", "frame_idx", "starts", "lengths"])

    return mask.select("session_id", "frame_idx", "pos").mapInArrow(run, "session_id string, frame_idx int, starts array<int>, lengths array<int>")


def decoded(starts: Column, lengths: Column) -> Column:
    """The places of runs, as an array."""
    return F.flatten(F.transform(F.arrays_zip(starts.alias("s"), lengths.alias("n")), lambda r: F.when(r["n"] > 0, F.sequence(r["s"], r["s"] + r["n"] - 1)).otherwise(F.array().cast("array<int>"))))


def rle_decode(runs: DataFrame) -> DataFrame:
    """(session_id, frame_idx, pos array) of runs (session_id, frame_idx, starts, lengths)."""
    return runs.select("session_id", "frame_idx", decoded(F.col("starts"), F.col("lengths")).alias("pos"))


def instrument_health(baseline: DataFrame, state: DataFrame, activity: DataFrame) -> DataFrame:
    """One row a session: drift, noise, dead pixels, change-points, activity, flags and overall_score; state as pixel_state gives it."""
    q = lambda c, p: F.percentile(c, p)
    b = baseline.groupBy("session_id").agg((F.max("baseline") - F.min("baseline")).alias("drift_range"), (q("baseline", 0.75) - q("baseline", 0.25)).alias("drift_iqr"))
    pixels = state.select("session_id", F.explode(F.arrays_zip("noise", "dead")).alias("p")).select("session_id", "p.*")
    n = pixels.groupBy("session_id").agg(F.median("noise").alias("noise_median"), (q("noise", 0.9) - q("noise", 0.1)).alias("noise_spread"), F.avg(F.col("dead").cast("double")).alias("dead_fraction"))
    cps = changepoints(baseline, "baseline", "frame_idx").groupBy("session_id").agg(F.count("*").alias("n_changepoints"))
    act = activity.groupBy("session_id").agg(F.median("activity").alias("activity_median"), q("activity", 0.9).alias("activity_p90"))
    out = b.join(n, "session_id").join(cps, "session_id", "left").join(act, "session_id", "left").withColumn("n_changepoints", F.coalesce("n_changepoints", F.lit(0)))
    flags = [
        F.when(F.col("dead_fraction") > 0.01, "dead_pixels_detected"), F.when(F.col("drift_range") > 500, "large_baseline_drift"),
        F.when(F.col("n_changepoints") >= 3, "multiple_baseline_changepoints"), F.when(F.col("noise_median") <= 0, "invalid_noise_map"),
    ]
    penalty = (
        0.35 * clip01(F.col("dead_fraction") / 0.02) + 0.30 * clip01(F.col("drift_range") / 1000.0)
        + 0.20 * clip01(F.col("noise_spread") / (F.col("noise_median") * 4.0 + 1e-9)) + 0.15 * clip01(F.col("n_changepoints") / 5.0)
    )
    return out.withColumn("flags", F.array_join(F.array_sort(F.array_compact(F.array(*flags))), ",")).withColumn("overall_score", clip01(1.0 - penalty))
