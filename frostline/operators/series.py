"""Operators on irregular time series: rows (session_id, t, ...), one series a session; windows never cross sessions.

Long sessions are worked on in blocks with the rows around them (see blocks), and their medians are selected by rank (see selection).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window, WindowSpec

from frostline.functions.scalars import seconds_between
from frostline.operators.blocks import BLOCK, HELD, Keep, fresh, numbered, running_sum, spread, windowed
from frostline.operators.selection import has_large, medians
from frostline.operators.stream import by_key
from frostline.sources.stage import Store


def steps(series: DataFrame, t: str = "t") -> DataFrame:
    """(session_id, t_start, t_end, delta) between neighbours in time; null times are left out."""
    rows = series.where(F.col(t).isNotNull()).select("session_id", F.col(t).alias("t_end"))
    rows = windowed(rows, ["t_end"], 1, 0, lambda w: {"t_start": F.lag("t_end").over(w)}, bound=series).where("t_start is not null")
    return rows.select("session_id", "t_start", "t_end", seconds_between(F.col("t_start"), F.col("t_end")).alias("delta"))


def instants(series: DataFrame, t: str = "t") -> DataFrame:
    """(session_id, t, n_rows): each time once, and how many rows have it; null times too."""
    return series.groupBy("session_id", t).agg(F.count("*").alias("n_rows"))


def cadence(series: DataFrame, t: str = "t", rows: str | None = None) -> DataFrame:
    """(session_id, dt, n): the median of the positive steps; null below three times or two such steps. rows: a column that says how many rows a time stands for (see instants)."""
    n = series.groupBy("session_id").agg((F.count(t) if rows is None else F.coalesce(F.sum(F.when(F.col(t).isNotNull(), F.col(rows))), F.lit(0))).alias("n"))
    rises = steps(series, t).where("delta > 0")
    dts = medians(rises, ["session_id"], bound=series, m=F.col("delta")).join(rises.groupBy("session_id").agg(F.count("*").alias("k")), "session_id")
    return n.join(dts, "session_id", "left").select("session_id", F.when((F.col("n") >= 3) & (F.col("k") >= 2), F.col("m")).alias("dt"), "n")


def cadence_policy(observed: DataFrame, reference: DataFrame, configured: float | None = None) -> DataFrame:
    """(session_id, dt, confidence, source): a configured step first, then the observations' cadence, then the reference's."""
    both = observed.select("session_id", F.col("dt").alias("a"), F.col("n").alias("na")).join(reference.select("session_id", F.col("dt").alias("b"), F.col("n").alias("nb")), "session_id", "full")
    if configured is not None:
        if configured <= 0:
            raise ValueError("the configured step must be positive")
        return both.select("session_id", F.lit(float(configured)).alias("dt"), F.lit(0.95).alias("confidence"), F.lit("config").alias("source"))
    conf = F.when(F.col("a").isNotNull(), F.least(F.lit(0.9), 0.4 + 0.1 * (F.col("na") - 2))).when(F.col("b").isNotNull(), F.least(F.lit(0.8), 0.3 + 0.05 * (F.col("nb") - 2))).otherwise(F.lit(0.1))
    source = F.when(F.coalesce("a", "b").isNotNull(), "aligned_from_tables").otherwise("unknown")
    return both.select("session_id", F.coalesce("a", "b").alias("dt"), conf.alias("confidence"), source.alias("source"))


def duplicate_times(series: DataFrame, t: str = "t", rows: str | None = None) -> DataFrame:
    """(session_id, t, n_extra): times that stand more than once, and how often too many; rows as for cadence."""
    n = F.count("*") if rows is None else F.sum(rows)
    return series.where(F.col(t).isNotNull()).groupBy("session_id", F.col(t).alias("t")).agg((n - 1).alias("n_extra")).where("n_extra > 0")


def time_gaps(series: DataFrame, t: str = "t", factor: float = 5.0, hint: float | None = None, rows: str | None = None) -> DataFrame:
    """(session_id, t_start, t_end, delta, dt): steps of more than ``factor`` times the cadence, or times ``hint`` seconds where given; rows as for cadence."""
    dt = cadence(series, t, rows).where("n >= 3").select("session_id", (F.lit(float(hint)) if hint else F.col("dt")).alias("dt"))
    return steps(series, t).join(dt, "session_id").where(F.col("delta") > factor * F.col("dt"))


def monotonicity(series: DataFrame, value: str, order: str = "row_index") -> DataFrame:
    """(session_id, n_down, largest_drop) of values in their order of input: falls between neighbours; null values are left out, two rows are too few."""
    rows = series.where(F.col(value).isNotNull())
    diff = windowed(rows.select("session_id", F.col(value).alias("v"), F.col(order).alias("at")), ["at"], 1, 0, lambda w: {"d": F.col("v") - F.lag("v").over(w)})
    out = diff.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("d") < 0).alias("n_down"), F.min("d").alias("largest_drop"))
    return out.where("n >= 3 and n_down > 0").select("session_id", "n_down", "largest_drop")


def integrity_report(gaps: DataFrame, duplicates: DataFrame, falls: DataFrame) -> DataFrame:
    """(session_id, kind, t_start, t_end, amount): all findings of the three detectors in one table."""
    none = F.lit(None).cast("timestamp")
    return (
        gaps.select("session_id", F.lit("missing").alias("kind"), "t_start", "t_end", F.col("delta").alias("amount"))
        .unionByName(duplicates.select("session_id", F.lit("duplicate").alias("kind"), F.col("t").alias("t_start"), F.col("t").alias("t_end"), F.col("n_extra").cast("double").alias("amount")))
        .unionByName(falls.select("session_id", F.lit("non_monotonic").alias("kind"), none.alias("t_start"), none.alias("t_end"), F.col("largest_drop").alias("amount")))
    )


def sourced_integrity(observed: DataFrame, reference: DataFrame, value: str, order: str, t: str = "t", hint: float | None = None) -> DataFrame:
    """(session_id, source, kind, t_start, t_end, amount, place) of both tables: gaps and repeated times of either, falls of the reference's value. place orders a session's findings by source and start, those without a time last."""
    parts = []
    for name, df in (("particle", observed), ("processed", reference)):
        falls = monotonicity(df, value, order) if name == "processed" else None
        gaps, twice = time_gaps(df, t, hint=hint), duplicate_times(df, t)
        found = integrity_report(gaps, twice, falls if falls is not None else gaps.limit(0).select("session_id", F.lit(0.0).alias("largest_drop")))
        parts.append(found.withColumn("source", F.lit(name)))
    out = parts[0].unionByName(parts[1])
    w = Window.partitionBy("session_id").orderBy("source", F.asc_nulls_last("t_start"), "kind", "t_end")
    return out.select("session_id", "source", "kind", "t_start", "t_end", "amount", F.row_number().over(w).alias("place"))


#: The flag of each kind of finding.
FLAGS = {"duplicate": "duplicate_timestamps_detected", "missing": "time_gaps_detected", "non_monotonic": "swe_non_monotonic"}


def integrity_flags(report: DataFrame) -> DataFrame:
    """(session_id, flags): the sorted distinct flags of a session's findings; kinds without a flag give none, sessions without findings no row."""
    names = F.create_map(*[F.lit(x) for pair in FLAGS.items() for x in pair])
    return report.groupBy("session_id").agg(F.sort_array(F.collect_set(names[F.col("kind")])).alias("flags"))


def gap_fraction(report: DataFrame) -> DataFrame:
    """(session_id, gap_fraction): missing seconds over the span of the findings that have times; not held under 1."""
    missing = F.sum(F.when((F.col("kind") == "missing") & (F.col("amount") > 0), F.col("amount")).otherwise(0.0))
    span = seconds_between(F.min("t_start"), F.max("t_end"))
    out = report.groupBy("session_id").agg(missing.alias("m"), span.alias("s"))
    return out.select("session_id", F.when(F.col("m") <= 0, 0.0).when(F.col("s") > 0, F.col("m") / F.col("s")).alias("gap_fraction"))


def time_bins(rows: DataFrame, axis: DataFrame, t: str, seconds: int, *aggs: Column) -> DataFrame:
    """(session_id, bin, ...aggs) for every bin of ``seconds`` between a session's first and last time.

    axis: (session_id, t0, t1). Bins start at t0, floored to the second; bins without rows have the aggregates of none.
    """
    width = F.lit(seconds * 1_000_000)
    axis = axis.select("session_id", F.date_trunc("second", "t0").alias("t0"), "t1")
    number = lambda x: F.floor((F.unix_micros(x) - F.unix_micros(F.col("t0"))) / width).cast("int")
    every = axis.select("session_id", F.explode(F.sequence(F.lit(0), number(F.col("t1")))).alias("bin"))
    binned = rows.join(axis, "session_id").where(F.col(t).between(F.col("t0"), F.col("t1"))).withColumn("bin", number(F.col(t))).groupBy("session_id", "bin").agg(*aggs)
    return every.join(binned, ["session_id", "bin"], "left")


def axis_of(rows: DataFrame, t: str = "t") -> DataFrame:
    """(session_id, t0, t1)"""
    return rows.groupBy("session_id").agg(F.min(t).alias("t0"), F.max(t).alias("t1"))


def sliding_medians(values: np.ndarray, half: int) -> np.ndarray:
    """The median of up to ``half`` values on either side of each and itself; NaN are left out, and where there is nothing else the median is NaN.

    The values in the window are kept sorted: one goes in and one out a step.
    """
    n, held, out = len(values), [], np.full(len(values), np.nan)
    v, real = values.tolist(), (~np.isnan(values)).tolist()
    for k in range(min(half, n)):
        if real[k]:
            insort(held, v[k])
    for k in range(n):
        if k + half < n and real[k + half]:
            insort(held, v[k + half])
        if k - half - 1 >= 0 and real[k - half - 1]:
            del held[bisect_left(held, v[k - half - 1])]
        if m := len(held):
            out[k] = (held[(m - 1) // 2] + held[m // 2]) / 2.0
    return out


def rolling_median(rows: DataFrame, value: str, order: str, half: int = 50, name: str = "rolling", keep: Keep | None = None, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """rows with ``name``: the median over ``half`` rows on either side, fewer at the ends. Null and NaN values are left out; without others it is null.

    A session is dealt out in blocks of rows, each with ``half`` rows more at its ends, and the window slides over a block with its values kept sorted.
    """
    columns, (number, at, new) = rows.columns, fresh(rows, "number", "block", "median")
    if has_large(rows, ["session_id"], held):
        dealt = numbered(rows, [order], keep or Store(rows.sparkSession).keep, number)
    else:
        dealt = rows.withColumn(number, (F.row_number().over(Window.partitionBy("session_id").orderBy(order)) - 1).cast("long"))
    dealt = spread(dealt, number, half, half, block, at).repartition("session_id", at).sortWithinPartitions("session_id", at, number)
    shape = T.StructType([*rows.schema.fields, T.StructField(new, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, k), table in by_key(batches, "session_id", at):
            v = table[value].to_numpy().astype(np.float64)
            mine = table[number].to_numpy() // block == k
            found = sliding_medians(v, half)[mine]
            kept = table.select(columns).filter(pa.array(mine))
            yield from kept.append_column(new, pa.array(found, mask=np.isnan(found))).to_batches()

    out = dealt.mapInArrow(run, shape)
    return out.select(*[F.col(f"`{c}`") for c in columns if c != name], F.col(new).alias(name))


def separated(flagged: DataFrame, separation: int, keep: Keep, block: int = BLOCK) -> DataFrame:
    """flagged (session_id, row, ...) without those nearer than ``separation`` to the last one kept, taken in order from each session's first.

    What a block of rows keeps depends only on how many of its first rows are still too near: for each such number a block tells how many rows of
    the next are too near after it. These tables, one a block, are gone through in order of blocks; then each block is filtered.
    """
    step, wide = max(1, separation), max(block, separation, 1)
    columns, (at, k, sid, piece) = flagged.columns, fresh(flagged, "block", "near", "sid", "piece")
    rows = flagged.withColumn(at, F.floor(F.col("row") / F.lit(wide)))
    kind = flagged.schema["session_id"].dataType.simpleString()

    def walk(row: np.ndarray, first: int) -> list[int]:
        out, low = [], int(np.searchsorted(row, first))
        while low < len(row):
            out.append(low)
            low = int(np.searchsorted(row, row[low] + step))
        return out

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (session, b), table in by_key(batches, "session_id", at):
            row = table["row"].to_numpy().astype(np.int64)
            # the last one kept, going on from each flagged row; a block's ways soon meet
            after = np.searchsorted(row, row + step)
            last = np.arange(len(row))
            for i in range(len(row) - 1, -1, -1):
                if after[i] < len(row):
                    last[i] = last[after[i]]
            first = np.searchsorted(row, b * wide + np.arange(step))
            some = first < len(row)
            over = np.zeros(step, np.int64)
            over[some] = np.maximum(row[last[first[some]]] + step - (b + 1) * wide, 0)
            yield pa.RecordBatch.from_arrays([pa.array([session], table.schema.field("session_id").type), pa.array([b], pa.int64()), pa.array([over.tolist()], pa.list_(pa.int64()))], ["session_id", "b", "over"])

    def carried(table: pa.Table) -> pa.Table:
        table, near, next_block, out = table.sort_by("b"), 0, None, []
        for b, over in zip(table["b"].to_pylist(), table["over"].to_pylist(), strict=True):
            near = near if b == next_block else 0
            out.append(near)
            near, next_block = over[near], b + 1
        return pa.Table.from_arrays([table["session_id"], table["b"], pa.array(out, pa.int64())], [sid, piece, k])

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, b), table in by_key(batches, "session_id", at):
            keepers = walk(table["row"].to_numpy().astype(np.int64), b * wide + table[k][0].as_py())
            yield from table.select(columns).take(pa.array(keepers, pa.int64())).to_batches()

    rows = keep("flagged", rows)
    sort = lambda df: df.repartition("session_id", at).sortWithinPartitions("session_id", at, "row")
    tables = sort(rows.select("session_id", at, "row")).mapInArrow(left, f"session_id {kind}, b long, over array<long>")
    near = tables.groupBy("session_id").applyInArrow(lambda t: carried(t), f"`{sid}` {kind}, `{piece}` long, `{k}` long")
    joined = rows.join(near.hint("merge"), rows["session_id"].eqNullSafe(near[sid]) & (rows[at] == near[piece])).drop(sid, piece)
    return sort(joined).mapInArrow(filtered, flagged.schema)


def changepoints(rows: DataFrame, value: str, order: str, half: int = 50, z: float = 6.0, separation: int = 30, keep: Keep | None = None, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """(session_id, frame_idx, delta, confidence): rows that stand off their rolling median by more than z robust spreads.

    The spread is 1.4826 times the residuals' median absolute deviation, or their standard deviation where that is 0. Of candidates nearer than
    ``separation`` to the last accepted one, none is taken. Series of under ten rows have none. ``order`` must be unique in a session.
    """
    keep = keep or Store(rows.sparkSession).keep
    plain = rows.select("session_id", F.col(f"`{order}`").alias("at"), F.col(f"`{value}`").cast("double").alias("v"))
    if has_large(plain, ["session_id"], held):
        plain = numbered(plain, ["at"], keep, "row")
    else:
        plain = plain.withColumn("row", (F.row_number().over(Window.partitionBy("session_id").orderBy("at")) - 1).cast("long"))
    r = keep("residuals", rolling_median(plain, "v", "row", half, "m", keep, held, block).select("session_id", "at", "row", (F.col("v") - F.col("m")).alias("r")))
    spread_of = r.groupBy("session_id").agg(F.stddev_pop("r").alias("sd"), F.count("*").alias("n")).where("n >= 10").select(F.col("session_id").alias("sid"), "sd")
    mid = medians(r, ["session_id"], keep, held, m=F.col("r"))
    near = lambda left, right, c: left.join(F.broadcast(right) if right.count() <= held else right, left["session_id"].eqNullSafe(right[c])).drop(c)
    away = near(r, keep("mid", mid.withColumnRenamed("session_id", "sid")), "sid").select("session_id", F.abs(F.col("r") - F.col("m")).alias("d"))
    mad = medians(away, ["session_id"], keep, held, bound=r, mad=F.col("d"))
    limit = mad.join(spread_of, mad["session_id"].eqNullSafe(spread_of["sid"])).select("sid", (F.lit(z) * F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.col("sd") + 1e-9)).alias("limit"))
    flagged = near(r, keep("limit", limit), "sid").where(F.abs("r") > F.col("limit"))
    kept = separated(flagged, separation, keep, block)
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.abs("r") / (F.col("limit") + 1e-9)))
    return kept.select("session_id", F.col("at").alias("frame_idx"), F.col("r").alias("delta"), conf.alias("confidence"))


def cumulative(rows: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """rows with ``name``: the sum of value up to each row in its session."""
    return running_sum(rows, value, [order], name)


def first_difference(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """rows with ``diff``: the rise of value since the row before in its session; null for the first and beside a null."""
    return windowed(rows, list(order), 1, 0, lambda w: {"diff": F.col(value) - F.lag(value).over(w)})


def windowed_rate(rows: DataFrame, value: str, order: str, dt: float, window: int = 5) -> DataFrame:
    """rows with rate_windowed: the rise over ``window`` rows in units an hour; null for the first ones and where dt is not positive."""
    if dt <= 0:
        return rows.withColumn("rate_windowed", F.lit(None).cast("double"))
    return windowed(rows, [order], window, 0, lambda w: {"rate_windowed": (F.col(value) - F.lag(value, window).over(w)) / F.lit(window * dt) * 3600.0})


def robust_rate(rows: DataFrame, value: str, order: str, dt: float) -> DataFrame:
    """rows with rate_robust: the median of five neighbouring first differences in units an hour; null where one of them lacks."""
    if dt <= 0:
        return rows.withColumn("rate_robust", F.lit(None).cast("double"))
    v = lambda w, k: F.lag(value, -k).over(w)

    def make(w: WindowSpec) -> dict[str, Column]:
        five = F.array(*[v(w, k) - v(w, k - 1) for k in range(-2, 3)])
        return {"rate_robust": F.when(~F.exists(five, lambda d: d.isNull()), F.sort_array(five)[2] / dt * 3600.0)}

    return windowed(rows, [order], 3, 2, make)
