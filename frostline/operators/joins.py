"""Joins of time series: nearest in time, constant cadence, and intervals with distance. None needs a cross product."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from frostline.functions.scalars import seconds_between
from frostline.operators.blocks import fresh
from frostline.operators.stream import run_starts

#: Pairs of an event and a point that are looked at, and pairs that are passed on, at once.
CANDIDATES, MATCHES = 1 << 20, 1 << 16


def frame_of_time(t: Column, t0: Column, dt: Column | float, n_frames: Column | int) -> Column:
    """The nearest frame of a uniform axis, the earlier one on a tie, held within the axis."""
    place = seconds_between(t0, t) / dt
    return F.greatest(F.lit(0), F.least(F.ceil(place - 0.5), n_frames - 1 if isinstance(n_frames, Column) else F.lit(n_frames - 1))).cast("int")


def frame_of_cadence(t: Column, t0: Column, dt: Column | float) -> Column:
    """The nearest frame by cadence alone, halves to even, not held within the axis."""
    return F.bround(seconds_between(t0, t) / dt).cast("int")


def map_to_frames(rows: DataFrame, axis: DataFrame, t: str = "t", tolerance: float | None = 2.0, held: bool = True) -> DataFrame:
    """rows with frame_idx and residual (a row's time less its frame's, in seconds), by axis (session_id, t0, dt, n_frames); frame_idx is null where the two are further apart than ``tolerance`` seconds.

    held: times off the axis belong to its first or last frame, as the nearest of frames with times of their own; else the frame follows from the cadence alone, halves to
    even, and there is none before the first or after the last. axis has one row a session; rows of other sessions are left out. Columns of rows stay, whatever their
    names, but for frame_idx and residual, which are replaced.
    """
    of, place = fresh(rows, "axis", "frame")
    a = F.col(of)
    out = rows.join(axis.select("session_id", F.struct("t0", "dt", "n_frames").alias(of)), "session_id")
    if held:
        frame = frame_of_time(F.col(t), a["t0"], a["dt"], a["n_frames"])
    else:
        frame = F.bround(seconds_between(a["t0"], F.col(t)) / a["dt"])
        frame = F.when((frame >= 0) & (frame < a["n_frames"]), frame).cast("int")
    out = out.withColumn(place, frame)
    residual = seconds_between(a["t0"], F.col(t)) - F.col(place) * a["dt"]
    ok = F.abs(residual) <= tolerance if tolerance is not None else residual.isNotNull()
    kept = [c for c in rows.columns if c not in ("frame_idx", "residual")]
    return out.select(*[F.col(f"`{c}`") for c in kept], F.when(ok, F.col(place)).alias("frame_idx"), residual.alias("residual"))


def anchors(sessions: DataFrame, observed: DataFrame, reference: DataFrame, explicit: dict[str, str] | None = None, t: str = "t") -> DataFrame:
    """(session_id, t0, anchor_source): where each session's axis begins: at an explicit time (ISO text by session_id), else at its first observation, else at its first reference row, else at the epoch."""
    first = lambda df, name: df.groupBy("session_id").agg(F.min(t).alias(name))
    out = sessions.select("session_id").distinct().join(first(observed, "a"), "session_id", "left").join(first(reference, "b"), "session_id", "left")
    given = F.create_map(*[F.lit(x) for pair in (explicit or {}).items() for x in pair])[F.col("session_id")].cast("timestamp") if explicit else F.lit(None).cast("timestamp")
    out = out.withColumn("c", given)
    source = F.when(F.col("c").isNotNull(), "config.synthetic_t0_utc").when(F.col("a").isNotNull(), "particle.t_utc.min_raw").when(F.col("b").isNotNull(), "processed.t_utc.min").otherwise("epoch_fallback")
    return out.select("session_id", F.coalesce("c", "a", "b", F.timestamp_seconds(F.lit(0))).alias("t0"), source.alias("anchor_source"))


def frame_axis(axis: DataFrame) -> DataFrame:
    """(session_id, frame_idx, t): every frame of axis (session_id, t0, dt, n_frames)."""
    every = axis.withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)))
    return every.select("session_id", "frame_idx", F.timestamp_micros(F.unix_micros("t0") + F.round(F.col("frame_idx") * F.col("dt") * 1e6).cast("long")).alias("t"))


def nearest(left: DataFrame, right: DataFrame, key: str = "session_id", t: str = "t", order: str = "row_id", tolerance: float | None = None, piece_seconds: int = 86_400) -> DataFrame:
    """left (key, t, order, ...) with r: the nearest row of right (key, t, order, ...) in time as a struct, or null.

    Ties in time go to the earlier row; of right rows at one time, the one with the largest ``order`` counts.

    A key may hold a third of all rows, so each is cut into pieces of time: the last and next right row are running values inside a piece,
    and each piece's first and last right row (a row a piece) are carried over to its neighbours. The two sides are never joined.
    """
    body = F.struct(*[F.col(c) for c in right.columns])
    piece = F.floor(F.unix_micros(F.col(t)) / F.lit(piece_seconds * 1_000_000))
    lefts = left.select(key, F.col(t).alias("__t"), F.col(order).alias("__o"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(body.alias("b")).schema["b"].dataType).alias("__r"), piece.alias("__p"))
    rights = right.select(key, F.col(t).alias("__t"), F.col(order).alias("__o"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("b")).schema["b"].dataType).alias("__l"), body.alias("__r"), piece.alias("__p"))
    both = lefts.unionByName(rights).where(F.col("__t").isNotNull())
    inside = Window.partitionBy(key, "__p").orderBy("__t", "__side", "__o")
    both = both.withColumn("__a", F.last("__r", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # the next right row: at equal times later ones in order count, so look backwards
    back = Window.partitionBy(key, "__p").orderBy(F.desc("__t"), F.asc("__side"), F.asc("__o"))
    both = both.withColumn("__b", F.last("__r", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    ours = F.col("__side") == 0
    newest = F.max_by("__r", F.when(ours, F.struct("__t", "__o")))
    oldest = F.min_by("__r", F.when(ours, F.struct("__t", -F.col("__o").cast("double"))))
    ends = both.groupBy(key, "__p").agg(newest.alias("__z"), oldest.alias("__y"))
    over = Window.partitionBy(key).orderBy("__p")
    ends = ends.withColumn("__c", F.last("__z", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("__d", F.first("__y", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))).select(key, "__p", "__c", "__d")
    out = both.where("__side = 1").drop("__r").join(ends, [key, "__p"])
    before, after = F.coalesce("__a", "__c"), F.coalesce("__b", "__d")
    down, up = seconds_between(before[t], F.col("__t")), seconds_between(F.col("__t"), after[t])
    r = F.when(after.isNull() | (down <= up), before).otherwise(after)
    if tolerance is not None:
        r = F.when(F.abs(seconds_between(r[t], F.col("__t"))) <= tolerance, r)
    return out.select("__l.*", r.alias("r"))


def interval_matches(events: DataFrame, points: DataFrame, frames: float, pixels: float, width: int | None = None, event_columns: Sequence[str] = (), point_columns: Sequence[str] = ()) -> DataFrame:
    """All pairs of events (session_id, event_id, frame_start, frame_end, y, x) and points (session_id, point_id, frame_idx, y, x) that are near.

    Near: the point's frame lies in the event's interval or at most ``frames`` outside, and the places at most ``pixels`` apart. event_columns and
    point_columns are further columns that pairs take along, so that no table is joined once more to as many rows as there are pairs.

    The frame axis is cut into pieces of ``width`` and the plane into squares of four times ``pixels``: a point stands in one of each, an event in those that it reaches,
    mostly one to three. Both sides stream through a piece in order of frames, and only events that later points may still meet are held.
    """
    width = width or max(1, int(128 * frames))
    side = 4.0 * pixels if pixels > 0 else 1.0
    reached = lambda low, high, size: F.sequence(F.floor(low / size), F.floor(high / size))
    at = [F.col(c).cast("double").alias(f"__{c}") for c in ("y", "x")]
    finite = lambda *columns: reduce(lambda a, b: a & b, [F.abs(F.col(c).cast("double")) < float("inf") for c in columns])
    low, high = F.col("frame_start") - frames, F.col("frame_end") + frames
    body = F.struct("event_id", "frame_start", "frame_end", "y", "x", *event_columns)
    e = events.where(finite("frame_start", "frame_end", "y", "x") & (low <= high) & F.col("session_id").isNotNull())
    e = e.select("session_id", F.explode(reached(low, high, width)).alias("__b"), body.alias("__e"), low.cast("double").alias("__low"), high.cast("double").alias("__high"), *at)
    for c in ("y", "x"):
        e = e.withColumn(f"__s{c}", F.explode(reached(F.col(f"__{c}") - pixels, F.col(f"__{c}") + pixels, side)))
    place = F.col("frame_idx").cast("double")
    seen = F.struct("point_id", "frame_idx", "y", "x", *point_columns)
    p = points.where(finite("frame_idx", "y", "x") & F.col("session_id").isNotNull())
    p = p.select("session_id", F.floor(F.col("frame_idx") / width).alias("__b"), seen.alias("__p"), place.alias("__low"), place.alias("__high"), *at, *[F.floor(F.col(c) / side).alias(f"__s{c}") for c in ("y", "x")])
    keys = ["session_id", "__b", "__sy", "__sx"]
    # an event enters a piece at the piece's first frame at the earliest, ahead of the points of the frame it enters at
    rows = e.withColumn("__low", F.greatest("__low", (F.col("__b") * width).cast("double"))).unionByName(p, allowMissingColumns=True)
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "__low", F.col("__p").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            begins = run_starts(batch, *keys)
            begins_key = tuple(batch[k][0].as_py() for k in keys)
            of = np.repeat(np.arange(len(begins)), np.diff(begins, append=batch.num_rows))
            point = batch["__p"].is_valid().to_numpy(zero_copy_only=False)
            fields = [batch[c].to_numpy() for c in ("__low", "__high", "__y", "__x")]
            now = (of[~point], *[f[~point] for f in fields], pa.chunked_array([batch["__e"].filter(pa.array(~point))]))
            if held is not None and key == begins_key:
                now = (*[np.concatenate([a, b]) for a, b in zip(held[:5], now[:5], strict=True)], pa.chunked_array([*held[5].chunks, *now[5].chunks], now[5].type))
            g, f, _, y, x = (v[point] for v in (of, *fields))
            found = batch["__p"].filter(pa.array(point))
            eg, el, eh, ey, ex, es = now
            start, stop = np.zeros(len(eg), np.int64), np.zeros(len(eg), np.int64)
            edges = np.searchsorted(g, np.arange(len(begins) + 1))
            order = np.argsort(eg, kind="stable")
            cut = np.searchsorted(eg[order], np.arange(len(begins) + 1))
            for i in range(len(begins)):
                a, b, mine = edges[i], edges[i + 1], order[cut[i] : cut[i + 1]]
                if b > a and len(mine):
                    start[mine], stop[mine] = a + np.searchsorted(f[a:b], el[mine]), a + np.searchsorted(f[a:b], eh[mine], "right")
            n = np.maximum(stop - start, 0)
            some = np.flatnonzero(n)
            total = np.cumsum(n[some])
            low = 0
            while low < len(some):
                high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + CANDIDATES, "right")))
                part = some[low:high]
                k = np.repeat(part, n[part])
                j = np.arange(len(k)) - np.repeat(np.cumsum(n[part]) - n[part] - start[part], n[part])
                near = np.flatnonzero(np.hypot(ey[k] - y[j], ex[k] - x[j]) <= pixels * (1 + 1e-9))
                for a in range(0, len(near), MATCHES):
                    at = near[a : a + MATCHES]
                    left = es.take(pa.array(k[at])).combine_chunks()
                    sessions = batch["session_id"].take(pa.array(begins[eg[k[at]]]))
                    yield pa.RecordBatch.from_arrays([sessions, left if isinstance(left, pa.Array) else left.chunk(0), found.take(pa.array(j[at]))], ["session_id", "__e", "__p"])
                low = high
            last = len(begins) - 1
            keep = (eg == last) & (eh >= fields[0][-1])
            key = tuple(batch[k][batch.num_rows - 1].as_py() for k in keys)
            kept = es.filter(pa.array(keep)).combine_chunks()
            held = (np.zeros(int(keep.sum()), eg.dtype), *[v[keep] for v in (el, eh, ey, ex)], pa.chunked_array([kept]) if isinstance(kept, pa.Array) else kept)

    out = rows.select(*keys, "__low", "__high", "__y", "__x", "__e", "__p").mapInArrow(run, T.StructType([rows.schema[c] for c in ("session_id", "__e", "__p")]))
    out = out.select("session_id", *[F.col(f"__e.{c}").alias(c) for c in ("event_id", "frame_start", "frame_end", *event_columns)], *[F.col(f"__p.{c}").alias(c) for c in ("point_id", *point_columns)], F.col("__p.frame_idx").alias("__frame"), *[F.col(f"__{k}.{c}").alias(f"__{k}{c}") for k in "ep" for c in "yx"])
    gap = F.greatest(F.lit(0), F.col("frame_start") - F.col("__frame"), F.col("__frame") - F.col("frame_end"))
    out = out.withColumn("dframes", gap).withColumn("dxy", F.hypot(F.col("__ey") - F.col("__py"), F.col("__ex") - F.col("__px")))
    out = out.where((F.col("dframes") <= frames) & (F.col("dxy") <= pixels))
    conf = F.greatest(F.lit(0.0), 1.0 - 0.5 * F.col("dframes") / (frames + 1e-9) - 0.5 * F.col("dxy") / (pixels + 1e-9))
    return out.select("session_id", "event_id", "point_id", "dframes", "dxy", conf.alias("confidence"), *event_columns, *point_columns)
