"""Series reconstruction, closure, regimes, gating and findings; state-space smoothing is in statespace."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from frostline.functions.scalars import clip01, mass_to_depth, stable_id
from frostline.operators import selection
from frostline.operators.blocks import windowed
from frostline.operators.series import cumulative, first_difference, time_bins
from frostline.sources.stage import Store


def reconstruct(events: DataFrame, axis: DataFrame, area_mm2: float = 1.0) -> DataFrame:
    """(session_id, frame_idx, t, depth, total, mass): depth of the events' mass_mg at each frame of axis, and its running sum. Events off the axis are dropped."""
    at = events.groupBy("session_id", F.col("frame_peak").alias("frame_idx")).agg(F.sum("mass_mg").alias("mass"))
    rows = axis.join(at, ["session_id", "frame_idx"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    return cumulative(rows.withColumn("depth", F.coalesce(mass_to_depth(F.col("mass"), area_mm2), F.lit(0.0))), "depth", "frame_idx", "total")


def event_rate(series: DataFrame, dt: float) -> DataFrame:
    """series with rate_event: the mass of a frame's events an hour."""
    return series.withColumn("rate_event", F.col("mass") / dt * 3600.0 if dt > 0 else F.lit(None).cast("double"))


def closure(series: DataFrame, a: str, b: str) -> DataFrame:
    """(session_id, nrmse, closure_score, residual_mean, residual_std, residual_max) of two columns; nulls count as 0."""
    x, y = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    out = series.groupBy("session_id").agg(
        (F.sqrt(F.avg((x - y) * (x - y))) / F.greatest(F.max(F.abs(y)), F.lit(1e-6))).alias("nrmse"), F.avg(x - y).alias("residual_mean"), F.stddev_pop(x - y).alias("residual_std"), F.max(F.abs(x - y)).alias("residual_max")
    )
    return out.withColumn("closure_score", F.greatest(F.lit(0.0), 1.0 - F.col("nrmse")))


def standardise(rows: DataFrame, columns: list[str], keep: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows with each column less its session's mean over its population deviation; nulls take the median (0 without values), deviation 0 counts as 1.

    Medians, means and deviations are a row a session: they are written (in spark.checkpoint.dir if keep is not given) and sent to the rows, so no session's rows are brought into one task.
    """
    keep = keep or Store(rows.sparkSession).keep
    one = selection.small(keep("medians", selection.medians(rows, ["session_id"], **{f"{c}__m": F.col(c) for c in columns}).na.fill(0.0)))
    filled = rows.join(one, "session_id").select(*[c for c in rows.columns if c not in columns], *[F.coalesce(F.col(c), F.col(f"{c}__m")).alias(c) for c in columns])
    stats = selection.small(keep("deviations", filled.groupBy("session_id").agg(*[f(c).alias(f"{c}__{k}") for c in columns for k, f in (("a", F.avg), ("s", F.stddev_pop))])))
    out = filled.join(stats, "session_id")
    z = [((F.col(c) - F.col(f"{c}__a")) / F.when(F.col(f"{c}__s") > 0, F.col(f"{c}__s")).otherwise(1.0)).alias(c) for c in columns]
    return out.select(*[c for c in rows.columns if c not in columns], *z)


def k_means(rows: DataFrame, key: str, columns: list[str], k: int = 4, rounds: int = 50, keep: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(session_id, key, regime, confidence): Lloyd's rounds in each session from its k first rows by key; an empty cluster keeps its centre.

    A session's rounds end when no row's regime changes, or after ``rounds``. The centres before and now are arrays in one row a session; each
    round is one aggregation over the rows of sessions that still move, which also counts the rows whose regime is not that by the centres before.
    confidence is 1 / (1 + d^2). keep(name, df) writes the rows once and the centres between rounds (in spark.checkpoint.dir if not given).
    """
    keep = keep or Store(rows.sparkSession).keep
    names = [f"x{i}" for i in range(len(columns))]
    x = rows.select("session_id", F.col(key).alias("key"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
    if rounds > 1:
        x = keep("points", x)
    # compared as it is, a row number lets each task hand on its k first rows alone
    first = x.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("key"))).where(F.col("n") <= k)
    first = first.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", F.array(*names).alias("c")))), lambda e: e["c"]).alias("now"))
    centres = keep("centres0", first.select("session_id", F.lit(None).cast("array<array<double>>").alias("was"), "now", F.lit(1).cast("long").alias("moved")))
    few = centres.count() <= selection.SMALL

    def placed(moving: DataFrame, *which: str) -> DataFrame:
        """Rows beside the centres of their sessions, a column a coordinate."""
        flat = moving.select("session_id", F.size("now").alias("n_centres"), *[F.get(F.get(w, F.lit(j)), F.lit(i)).alias(f"{w}{j}_{i}") for w in which for j in range(k) for i in range(len(names))])
        return x.join(F.broadcast(flat) if few else flat, "session_id")

    for turn in range(rounds):
        near = nearest_centre(placed(centres.where("moved > 0"), "now", *["was"] * bool(turn)), names, k, "now").withColumnRenamed("regime", "to")
        near = nearest_centre(near, names, k, "was") if turn else near.withColumn("regime", F.lit(-1))
        means = near.groupBy("session_id", "to").agg(F.array(*[F.avg(n) for n in names]).alias("c"), F.sum((F.col("to") != F.col("regime")).cast("long")).alias("moved"))
        new = means.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("to", "c"))).alias("m"), F.sum("moved").alias("moved"))
        new = centres.drop("moved").join(new, "session_id", "left").withColumn("moved", F.coalesce("moved", F.lit(0)))
        kept = F.when(F.col("moved") > 0, F.transform("now", lambda c, j: F.coalesce(F.col("m")[j], c))).otherwise(F.col("now"))
        centres = keep(f"centres{turn + 1}", new.select("session_id", F.col("now").alias("was"), kept.alias("now"), "moved"))
        if turn < rounds - 1 and centres.where("moved > 0").isEmpty():
            break
    out = nearest_centre(placed(centres, "now"), names, k, "now")
    return out.select("session_id", F.col("key").alias(key), "regime", (1.0 / (1.0 + F.col("d2"))).alias("confidence"))


def nearest_centre(rows: DataFrame, names: list[str], k: int, which: str) -> DataFrame:
    """rows with regime and d2 of the nearest of n_centres centres, k at most, the first on a tie; coordinate i of centre j is the column {which}{j}_{i}.

    Plain columns throughout, so that Spark compiles them. A distance that is null stands before all others.
    """
    there = [c for c in rows.columns if not c.startswith(which)]
    squares = lambda j: reduce(add, [(F.col(n) - F.col(f"{which}{j}_{i}")) * (F.col(n) - F.col(f"{which}{j}_{i}")) for i, n in enumerate(names)])
    d = [F.col(f"d_{j}") for j in range(k)]
    rows = rows.select(*there, *[squares(j).alias(f"d_{j}") for j in range(k)])
    rows = rows.withColumn("d2", F.least(*d) if k > 1 else d[0])
    unknown = [(F.col("n_centres") > j) & d[j].isNull() for j in range(k)]
    regime = F.coalesce(*[F.when(u, j) for j, u in enumerate(unknown)], *[F.when(d[j] == F.col("d2"), j) for j in range(k)])
    return rows.select(*there, regime.alias("regime"), F.when(~reduce(or_, unknown), F.col("d2")).alias("d2"))


def regime_timeline(assigned: DataFrame, k: int, seconds: int = 60) -> DataFrame:
    """(session_id, bin, n, f0..): shares of regimes in each bin of time that has rows; bins count from the session's first time. assigned: (session_id, t, regime)."""
    t0 = assigned.groupBy("session_id").agg(F.min("t").alias("t0"))
    bin_ = F.floor((F.unix_micros("t") - F.unix_micros("t0")) / F.lit(seconds * 1_000_000)).cast("int")
    shares = [F.avg((F.col("regime") == i).cast("double")).alias(f"f{i}") for i in range(k)]
    return assigned.join(t0, "session_id").groupBy("session_id", bin_.alias("bin")).agg(F.count("*").alias("n"), *shares)


def regime_shifts(timeline: DataFrame, k: int, threshold: float = 0.35) -> DataFrame:
    """(session_id, before, bin, regime, shift, confidence): neighbouring bins between which a regime's share moves by ``threshold``; the largest move, the first on a tie."""
    move = lambda w, i: F.struct(F.abs(F.col(f"f{i}") - F.lag(f"f{i}").over(w)).alias("d"), F.lit(-i).alias("r"))
    out = windowed(timeline, ["bin"], 1, 0, lambda w: {"before": F.lag("bin").over(w)} | {f"m{i}": move(w, i) for i in range(k)}).select("session_id", "before", "bin", *[f"m{i}" for i in range(k)])
    out = out.where("m0.d is not null").withColumn("m", F.greatest(*[F.col(f"m{i}") for i in range(k)]) if k > 1 else F.col("m0"))
    return out.where(F.col("m.d") >= threshold).select("session_id", "before", "bin", (-F.col("m.r")).alias("regime"), F.col("m.d").alias("shift"), F.least(F.lit(0.95), 0.5 + F.col("m.d")).alias("confidence"))


def latent_observations(axis: DataFrame, baseline: DataFrame, events: DataFrame, rates: DataFrame, reference: DataFrame, seconds: int = 10, proxy: str = "diff") -> DataFrame:
    """(session_id, bin, baseline, event_rate, swe_rate, processed_swe): what the latent driver is seen through, for every bin of ``seconds`` of axis (session_id, t0, t1).

    The others are (session_id, t, v), events (session_id, t). baseline is the median of its first differences in a bin, or of its values with proxy
    "level"; null values are left out. event_rate counts events, 0 without any; the other two are medians, null without values. Empty tables give
    such bins throughout.
    """
    if proxy not in ("diff", "level"):
        raise ValueError("proxy must be diff or level")
    end = F.date_trunc("second", "t1")
    axis = axis.select("session_id", "t0", F.when(F.col("t1") > end, end + F.expr("INTERVAL 1 SECOND")).otherwise(end).alias("t1"))
    level = baseline.where("v is not null")
    if proxy == "diff":
        level = first_difference(level, "v", "t").drop("v").withColumnRenamed("diff", "v")
    out = time_bins(level, axis, "t", seconds, F.median("v").alias("baseline"))
    counted = time_bins(events, axis, "t", seconds, F.count("*").cast("double").alias("event_rate")).fillna(0.0, ["event_rate"])
    for more in (counted, time_bins(rates, axis, "t", seconds, F.median("v").alias("swe_rate")), time_bins(reference, axis, "t", seconds, F.median("v").alias("processed_swe"))):
        out = out.join(more, ["session_id", "bin"])
    return out


#: What a latent driver is seen through.
LATENT = ["baseline", "event_rate", "swe_rate", "processed_swe"]


def quantiles(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row a session: the deciles 1, 5 and 9 of each column's finite values, as column_q10, _q50 and _q90."""
    finite = lambda c: F.when(~F.isnan(F.col(c)) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    return selection.quantiles(rows, ["session_id"], {f"{c}_q{p}": (finite(c), p / 100) for c in columns for p in (10, 50, 90)})


def phenotype(events: DataFrame, series: DataFrame, regimes: DataFrame, health: DataFrame, closures: DataFrame) -> DataFrame:
    """One row a session with all its summary features; sessions without events have n_events 0."""
    e = events.groupBy("session_id").agg(F.count("*").alias("n_events"), F.avg("motion_score").alias("motion_score_mean"), F.avg("edge_proximity").alias("edge_proximity_mean"))
    e = e.join(quantiles(events, ["snr", "delta_peak", "energy", "area_peak_px", "duration_s"]), "session_id")
    s = series.groupBy("session_id").agg(F.max_by("total", F.when(F.col("total").isNotNull(), F.col("frame_idx"))).alias("total_final"))
    s = s.join(quantiles(series, ["rate_windowed", "rate_robust", "rate_event"]), "session_id")
    n = Window.partitionBy("session_id")
    f = regimes.groupBy("session_id", "regime").count().withColumn("share", F.col("count") / F.sum("count").over(n))
    f = f.groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("regime", "share")))).alias("regime_shares"))
    out = health.select("session_id", F.col("overall_score").alias("health_score")).join(closures.select("session_id", "closure_score"), "session_id", "left")
    return out.join(e, "session_id", "left").join(s, "session_id", "left").join(f, "session_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def gate(scores: DataFrame, mode: str = "hard", health_min: float = 0.70, closure_min: float = 0.60, alignment_min: float = 0.60, gap_max: float = 0.05) -> DataFrame:
    """scores (session_id, health_score, closure_score, alignment_confidence, gap_fraction) with reasons, allow and penalty.

    A missing health score or confidence counts as 0 and is a reason of its own; a missing closure score or gap fraction never blocks. In hard mode any reason
    blocks; in soft mode none does, and each score off its limit multiplies the penalty by how far it is off, by 0.1 at the least.
    """
    h, a = F.coalesce("health_score", F.lit(0.0)), F.coalesce("alignment_confidence", F.lit(0.0))
    c, g = F.col("closure_score"), F.col("gap_fraction")
    low = [(h, health_min, "health"), (c, closure_min, "closure"), (a, alignment_min, "alignment")]
    text = lambda x, op, limit: F.concat(F.format_string("%.3f", x), F.lit(f"{op}{limit:.3f}"))
    reasons = [F.when(F.isnull("health_score"), "missing_health_score"), F.when(F.isnull("alignment_confidence"), "missing_alignment_confidence")]
    reasons += [F.when(x < limit, F.concat(F.lit(f"{name}_below_threshold:"), text(x, "<", limit))) for x, limit, name in low]
    reasons.append(F.when(g > gap_max, F.concat(F.lit("gap_fraction_above_threshold:"), text(g, ">", gap_max))))
    out = scores.withColumn("reasons", F.array_compact(F.array(*reasons)))
    if mode != "soft":
        return out.withColumn("allow", F.size("reasons") == 0).withColumn("penalty", F.lit(1.0))
    penalty = F.lit(1.0)
    for x, limit, _ in low:
        penalty = penalty * F.when(x < limit, clip01(F.greatest(F.lit(0.1), x / (limit + 1e-9)))).otherwise(1.0)
    penalty = penalty * F.when(g > gap_max, clip01(F.greatest(F.lit(0.1), F.lit(gap_max) / (g + 1e-9)))).otherwise(1.0)
    return out.withColumn("allow", F.lit(True)).withColumn("penalty", penalty)


def findings(shifts: DataFrame, gated: DataFrame) -> DataFrame:
    """(session_id, finding_id, title, confidence, evidence): regime shifts of sessions that may be inferred from, or a note that one was skipped. Each names its evidence."""
    ok = gated.select("session_id", "allow", "penalty", "reasons")
    moved = shifts.join(ok.where("allow"), "session_id").select(
        "session_id", stable_id("finding", bin=F.col("bin"), kind=F.lit("regime_shift"), regime=F.col("regime"), session=F.col("session_id")).alias("finding_id"),
        F.lit("Regime transition detected").alias("title"), (F.col("confidence") * F.col("penalty")).alias("confidence"), F.concat(F.lit("bin:"), F.col("bin").cast("string")).alias("evidence"),
    )
    skipped = ok.where("not allow").select(
        "session_id", stable_id("finding", kind=F.lit("inference_skipped"), session=F.col("session_id")).alias("finding_id"), F.lit("Inference skipped").alias("title"), F.lit(1.0).alias("confidence"), F.array_join("reasons", ";").alias("evidence")
    )
    return moved.unionByName(skipped)
