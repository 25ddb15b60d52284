"""Events in image stacks: connected components of cooled pixels, tracks of components, event features, masks of events.

Components are found within each frame's row by runs of pixels. Tracks depend on two neighbouring frames at a time: pairs of frames are matched in blocks of
frames, each block with the last frame before it, and the pieces of tracks are joined over blocks by pointer doubling. So neither a long session nor a
long track is ever one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.functions.scalars import clip01
from frostline.operators.blocks import fresh
from frostline.operators.frames import run_lengths
from frostline.operators.stream import by_key, flat_lists, lists, run_starts
from frostline.sources.stage import Store

#: Frames whose components are matched by one task at once.
BLOCK = 64


def label_runs(start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """For each run of set places the first of the runs it is connected with, where a place touches the one ``width`` further on.

    Runs rise and do not touch one another. Runs that overlap when moved by one row are edges; each end of an edge hooks its root to the lesser root, and
    paths are halved until nothing moves: whole arrays at a time.
    """
    end = start + length
    low, high = np.searchsorted(end, start + width, "right"), np.searchsorted(start, end + width)
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(start)), n)
    b = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    root = np.arange(len(start))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def components(mask: DataFrame, width: int, least: int = 1) -> DataFrame:
    """(session_id, frame_idx, comp, area, cy, cx, deepest, energy, brightest, pos array) of masks (session_id, frame_idx, pos, c, v: arrays).

    Pixels are connected by shared edges. comp is the row-major place of the component's first pixel, pos its pixels in order; components under ``least``
    pixels are left out. Places may stand in any order; a place given twice counts once, by its first values. No shuffle: a frame is a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, sizes = flat_lists(batch["pos"])
            if not len(pos):
                continue
            pos = pos.astype(np.int64)
            frame = np.repeat(np.arange(batch.num_rows), sizes)
            # frames one after another in one plane, an unset column after each row and an unset row after each frame
            place = (frame * (int(pos.max()) // width + 2) + pos // width) * (width + 1) + pos % width
            place, order = np.unique(place, return_index=True)
            pos, frame = pos[order], frame[order]
            cold, seen = (flat_lists(batch[k])[0].astype(np.float64)[order] for k in "cv")
            start, length, _ = run_lengths(place, np.zeros(len(place), np.int64))
            root = label_runs(start, length, width + 1)
            of = np.repeat(root, length)
            order = np.argsort(of, kind="stable")
            of, pos, frame, cold, seen = of[order], pos[order], frame[order], cold[order], seen[order]
            begins = np.flatnonzero(np.diff(of, prepend=-1))
            area = np.diff(begins, append=len(of))
            total = lambda x: np.add.reduceat(x, begins)
            numbers = [pos[begins], area, total(pos // width) / area, total(pos % width) / area, np.maximum.reduceat(-cold, begins), total(-cold), np.maximum.reduceat(seen, begins)]
            at = pa.array(frame[begins])
            columns = [batch["session_id"].take(at), batch["frame_idx"].take(at), *map(pa.array, numbers), lists(pos.astype(np.int32), area, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["session_id", "frame_idx", "comp", "area", "cy", "cx", "deepest", "energy", "brightest", "pos"])

    shape = "session_id string, frame_idx int, comp long, area long, cy double, cx double, deepest double, energy double, brightest double, pos array<int>"
    out = mask.select("session_id", "frame_idx", "pos", "c", "v").mapInArrow(run, shape)
    return out.where(F.col("area") >= least)


def match_frames(cy: np.ndarray, cx: np.ndarray, before_y: np.ndarray, before_x: np.ndarray, reach: float) -> np.ndarray:
    """For each component, in order, the nearest one of the frame before that no earlier component took, the first on a tie, if within ``reach``; else -1.

    Distances are roots of sums of squares, as SQL writes them: hypot rounds otherwise, and ties would go to another component.
    """
    out, free = np.full(len(cy), -1), np.ones(len(before_y), bool)
    if not len(before_y):
        return out
    for i, (y, x) in enumerate(zip(cy, cx, strict=True)):
        d = np.where(free, np.sqrt((y - before_y) ** 2 + (x - before_x) ** 2), np.inf)
        k = int(d.argmin())
        if d[k] <= reach:
            out[i], free[k] = k, False
    return out


def link_tracks(comps: DataFrame, reach: float = 5.0, keep: Callable[[str, DataFrame], DataFrame] | None = None, block: int = BLOCK) -> DataFrame:
    """comps with track: each component, in order of frame and first pixel, goes on from the nearest unused component of the frame before, if within ``reach``.

    track is "frame:comp" of a track's first component; a frame without components ends all tracks. A row a component: (session_id, frame_idx, comp) must
    be unique. An empty table gives none. keep(name, df) writes tables between rounds (in spark.checkpoint.dir if not given).

    Which component goes on from which depends on two neighbouring frames alone. They are matched in blocks of ``block`` frames with the frame before,
    streamed a block at a time; within a block each component is named by its piece's first one. Pieces that begin at a block's edge point to
    the piece they go on from, and rounds of pointer doubling (each pointer jumps to where its target points) take them to their roots: as many
    rounds as the logarithm of the blocks that the longest track crosses.
    """
    keep = keep or Store(comps.sparkSession).keep
    columns = comps.columns
    mark = lambda k, edge: comps.where(edge).select(F.struct(*columns).alias("row"), "session_id", "frame_idx", "comp", "cy", "cx", (F.floor(F.col("frame_idx") / F.lit(block)) + k).alias("block"))
    both = mark(0, F.lit(True)).unionByName(mark(1, F.pmod("frame_idx", F.lit(block)) == block - 1))
    dealt = both.repartition("session_id", "block").sortWithinPartitions("session_id", "block", "frame_idx", "comp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, k), rows in by_key(batches, "session_id", "block"):
            frame, comp, cy, cx = (rows[c].to_numpy() for c in ("frame_idx", "comp", "cy", "cx"))
            begins = np.flatnonzero(np.diff(frame, prepend=frame[0] - 2))
            first, held = np.arange(len(frame)), slice(0, 0)
            for low, high in zip(begins.tolist(), [*begins[1:].tolist(), len(frame)], strict=True):
                now = slice(low, high)
                if low and frame[low - 1] == frame[low] - 1:
                    to = match_frames(cy[now], cx[now], cy[held], cx[held], reach)
                    first[now] = np.where(to >= 0, first[held][to] if high > low and held.stop > held.start else 0, first[now])
                held = now
            mine = frame >= k * block
            # a piece that goes on from the frame before the block is named by its own first component, and points to the one before
            over = mine & ~mine[first]
            begun: dict[int, int] = {}
            for i in np.flatnonzero(over).tolist():
                begun.setdefault(int(first[i]), i)
            own = np.array([begun[f] if o else f for f, o in zip(first.tolist(), over.tolist(), strict=True)], np.int64)
            out = rows.filter(pa.array(mine))
            names = [pa.array(frame[own[mine]], pa.int32()), pa.array(comp[own[mine]], pa.int64()), pa.array(np.where(over[mine], comp[first[mine]], -1), pa.int64())]
            yield from pa.Table.from_arrays([out["row"], *names], ["row", "pf", "pc", "bc"]).to_batches()

    shape = T.StructType([T.StructField("row", comps.schema), T.StructField("pf", T.IntegerType()), T.StructField("pc", T.LongType()), T.StructField("bc", T.LongType())])
    nodes = keep("linked", dealt.mapInArrow(run, shape))
    at = ["session_id", "pf", "pc"]
    pieces = nodes.where("bc >= 0 AND row.frame_idx = pf AND row.comp = pc").select("row.session_id", "pf", "pc", (F.col("pf") - 1).alias("frame_idx"), F.col("bc").alias("comp"))
    edge = nodes.where(F.pmod("row.frame_idx", F.lit(block)) == block - 1).select("row.session_id", "row.frame_idx", "row.comp", F.col("pf").alias("tf"), F.col("pc").alias("tc"))
    pointers = keep("pointers0", pieces.join(edge, ["session_id", "frame_idx", "comp"]).select(*at, "tf", "tc"))
    turn = 0
    while True:
        there = pointers.select("session_id", F.col("pf").alias("tf"), F.col("pc").alias("tc"), F.col("tf").alias("uf"), F.col("tc").alias("uc"))
        jumped = pointers.join(there, ["session_id", "tf", "tc"], "left")
        turn += 1
        pointers = keep(f"pointers{turn}", jumped.select(*at, F.coalesce("uf", "tf").alias("tf"), F.coalesce("uc", "tc").alias("tc"), F.col("uf").isNotNull().alias("moved")))
        if pointers.where("moved").isEmpty():
            break
        pointers = pointers.drop("moved")
    named = nodes.select("row", F.col("row.session_id").alias("session_id"), "pf", "pc").join(pointers.select(*at, "tf", "tc"), at, "left")
    track = F.concat(F.coalesce("tf", "pf").cast("string"), F.lit(":"), F.coalesce("tc", "pc").cast("string"))
    return named.select("row.*", track.alias("track"))


def event_catalog(tracked: DataFrame, height: int, width: int, dt: float | None = None, saturation: float = 60_000.0) -> DataFrame:
    """One row an event: frames, centroids, depth, energy, area, duration, motion and edge scores.

    The peak frame is the first of the deepest; it is moved inside the event, and events too short for a frame inside are left out.
    """
    start, end = F.min("frame_idx"), F.max("frame_idx")
    e = tracked.groupBy("session_id", "track").agg(
        start.alias("frame_start"), end.alias("frame_end"), F.min_by("frame_idx", F.struct(-F.col("deepest"), "frame_idx")).alias("peak"), F.max("deepest").alias("delta_peak"), F.max("area").cast("double").alias("area_peak_px"),
        F.sum("energy").alias("energy"), F.count("*").alias("n_frames"), F.min_by(F.struct("cy", "cx"), "frame_idx").alias("a"), F.max_by(F.struct("cy", "cx"), "frame_idx").alias("b"), F.avg("cy").alias("my"), F.avg("cx").alias("mx"), (F.max("brightest") >= saturation).alias("saturated"),
    )
    e = e.withColumn("frame_peak", F.least(F.greatest("peak", F.col("frame_start") + 1), F.col("frame_end") - 1)).where("frame_peak > frame_start and frame_peak < frame_end")
    edge = F.least("a.cy", "a.cx", (height - 1) - F.col("a.cy"), (width - 1) - F.col("a.cx"))
    return e.select(
        "session_id", "track", "frame_start", "frame_peak", "frame_end", F.col("a.cy").alias("start_y"), F.col("a.cx").alias("start_x"), F.col("b.cy").alias("end_y"), F.col("b.cx").alias("end_x"),
        "delta_peak", "area_peak_px", "energy", (F.col("n_frames") * dt if dt is not None else F.lit(None).cast("double")).alias("duration_s"),
        clip01(F.hypot(F.col("b.cy") - F.col("a.cy"), F.col("b.cx") - F.col("a.cx")) / (F.hypot(F.lit(float(height)), F.lit(float(width))) + 1e-9)).alias("motion_score"),
        clip01(1.0 - edge / (min(height, width) / 2.0 + 1e-9)).alias("edge_proximity"), F.bround("my").cast("int").alias("y"), F.bround("mx").cast("int").alias("x"), "saturated",
    )


def with_context(events: DataFrame, state: DataFrame, baseline: DataFrame) -> DataFrame:
    """events with the noise and nonuniformity at their mean place (state: a row a pixel), the baseline at their peak, and snr."""
    out = events.join(state.select("session_id", "y", "x", "noise", "nonuniformity"), ["session_id", "y", "x"], "left")
    out = out.join(baseline.select("session_id", F.col("frame_idx").alias("frame_peak"), "baseline"), ["session_id", "frame_peak"], "left")
    return out.withColumn("snr", F.col("delta_peak") / (F.col("noise") + 1e-6))


def catalog_violations(events: DataFrame) -> DataFrame:
    """(session_id, reason, n_bad): events whose frames are not in the order start < peak < end, and event_ids that stand more than once in a session.

    Null frames are no violation; null event_ids are compared as one id. A sound or empty catalog gives no row.
    """
    order = events.where("frame_start >= frame_peak or frame_peak >= frame_end").groupBy("session_id").agg(F.count("*").alias("n_bad"))
    twice = events.groupBy("session_id", "event_id").agg((F.count("*") - 1).alias("n")).where("n > 0").groupBy("session_id").agg(F.sum("n").alias("n_bad"))
    named = lambda df, reason: df.select("session_id", F.lit(reason).alias("reason"), "n_bad")
    return named(order, "frame_order").unionByName(named(twice, "duplicate_event_id"))


def discrepancies(matches: DataFrame, events: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
    """matches (event_id, point_id, ...) with the area and duration of either side and their differences.

    Without events and points, matches have area_event, duration_event, area_point, duration_point and mass_mg already (see interval_matches), and nothing is joined.
    """
    out = matches
    if events is not None:
        out = out.join(events.select("session_id", "event_id", F.col("area").alias("area_event"), F.col("duration_s").alias("duration_event")), ["session_id", "event_id"])
    if points is not None:
        out = out.join(points.select("session_id", "point_id", F.col("area").alias("area_point"), F.col("duration_s").alias("duration_point"), "mass_mg"), ["session_id", "point_id"])
    return out.withColumn("d_area", F.col("area_event") - F.col("area_point")).withColumn("d_duration", F.col("duration_event") - F.col("duration_point"))


def match_times(matches: DataFrame, events: DataFrame | None, points: DataFrame | None, dt: float) -> DataFrame:
    """matches with dt_s: the seconds between the event's peak and the point, or their distance in frames times ``dt`` where either time is null.

    events: (session_id, event_id, t_peak), points: (session_id, point_id, t); a match without its event or point has no such time either. Without them,
    matches have t_peak and t already (see interval_matches), and nothing is joined.
    """
    if events is None and points is None:
        return matches.withColumn("dt_s", _seconds_apart(F.unix_micros("t_peak"), F.unix_micros("t"), dt))
    peak, seen = fresh(matches, "peak", "seen")
    e = events.select("session_id", "event_id", F.unix_micros("t_peak").alias(peak))
    p = points.select("session_id", "point_id", F.unix_micros("t").alias(seen))
    out = matches.join(e, ["session_id", "event_id"], "left").join(p, ["session_id", "point_id"], "left")
    return out.withColumn("dt_s", _seconds_apart(F.col(peak), F.col(seen), dt)).drop(peak, seen)


def _seconds_apart(peak: Column, seen: Column, dt: float) -> Column:
    return F.coalesce(F.abs(seen - peak) / 1e6, F.col("dframes") * F.lit(float(dt)))


def validation_report(matches: DataFrame) -> DataFrame:
    """(session_id, n_matches, mean_dframes, mean_dxy), and mean_dt_s where matches have dt_s."""
    timed = [F.avg("dt_s").alias("mean_dt_s")] if "dt_s" in matches.columns else []
    return matches.groupBy("session_id").agg(F.count("*").alias("n_matches"), F.avg("dframes").alias("mean_dframes"), F.avg("dxy").alias("mean_dxy"), *timed)


def unmatched(rows: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    return rows.join(matches.select("session_id", key).distinct(), ["session_id", key], "left_anti")
