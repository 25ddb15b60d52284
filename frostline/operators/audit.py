"""What a finished session is judged by: differences of series, counts, ranges, signatures, summaries, and findings with their evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.scalars import iso, stable_id
from frostline.operators.selection import quantiles


def suffixed_join(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """The inner join on equal columns; other columns that both have get the suffixes. Rows that stand several times meet each of their partners; null keys meet none."""
    both = {c.lower() for c in left.columns} & {c.lower() for c in right.columns} - {c.lower() for c in on}
    named = lambda df, s: [F.col(f"`{c}`").alias(c + s if c.lower() in both else c) for c in df.columns]
    return left.select(*named(left, suffixes[0])).join(right.select(*named(right, suffixes[1])), on)


def series_difference(made: DataFrame, given: DataFrame, value: str, t: str = "t") -> DataFrame:
    """(session_id, n, mean, std, largest) of the differences of two series (session_id, t, value) where both have a row; std is a sample's, largest that of absolute differences.

    Sessions without such rows have no row; differences with a null are left out, but their rows counted.
    """
    d = F.col(f"{value}_made") - F.col(f"{value}_given")
    return suffixed_join(made, given, ["session_id", t], ("_made", "_given")).groupBy("session_id").agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.max(F.abs(d)).alias("largest"))


def event_ratio(points: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, n_points, n_events, ratio): events over points, to three digits; a session without points counts as one point."""
    n = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    out = n(points, "n_points").join(n(events, "n_events"), "session_id", "full").na.fill(0, ["n_points", "n_events"])
    return out.withColumn("ratio", F.round(F.col("n_events") / F.greatest("n_points", F.lit(1)), 3))


def feature_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(session_id, feature, n, mean, std, least, q25, q50, q75, largest): a row for each of the columns."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("e")
    long = rows.select("session_id", each).select("session_id", "e.*")
    key = ["session_id", "feature"]
    plain = long.groupBy(*key).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("largest"))
    q = quantiles(long, key, {f"q{p}": (F.col("v"), p / 100) for p in (25, 50, 75)})
    return plain.join(q, key).select(*key, "n", "mean", "std", "least", "q25", "q50", "q75", "largest")


def mapped_range(mapped: DataFrame, t: str = "t") -> DataFrame:
    """(session_id, n, n_mapped, t_first, t_last, frame_first, frame_last) of rows mapped to frames; the frames are null where none is mapped."""
    return mapped.groupBy("session_id").agg(
        F.count("*").alias("n"), F.count("frame_idx").alias("n_mapped"), F.min(t).alias("t_first"), F.max(t).alias("t_last"), F.min("frame_idx").alias("frame_first"), F.max("frame_idx").alias("frame_last")
    )


#: The numbers of a signature.
METRICS = ["event_count", "closure_score", "health_score", "baseline_drift_abs", "noise_mean", "noise_p95", "n_regimes"]


def signature(sessions: DataFrame, events: DataFrame, closures: DataFrame, health: DataFrame, baseline: DataFrame, state: DataFrame, regimes: DataFrame, gated: DataFrame) -> DataFrame:
    """One row for each of sessions (session_id): METRICS and inference_skipped, few numbers that change only when something does.

    baseline_drift_abs is the last frame's baseline from the first one's, 0 for a single frame. What a session lacks is null; counts are 0 then and inference_skipped false.
    """
    noise = state.select("session_id", F.explode("noise").alias("v")).where(~F.isnan("v"))
    tables = [
        events.groupBy("session_id").agg(F.count("*").alias("event_count")),
        closures.select("session_id", "closure_score"),
        health.select("session_id", F.col("overall_score").alias("health_score")),
        baseline.groupBy("session_id").agg(F.abs(F.max_by("baseline", "frame_idx") - F.min_by("baseline", "frame_idx")).alias("baseline_drift_abs")),
        noise.groupBy("session_id").agg(F.avg("v").alias("noise_mean")),
        quantiles(noise, ["session_id"], {"noise_p95": (F.col("v"), 0.95)}),
        regimes.groupBy("session_id").agg(F.countDistinct("regime").alias("n_regimes")),
        gated.select("session_id", (~F.col("allow")).alias("inference_skipped")),
    ]
    out = reduce(lambda a, b: a.join(b, "session_id", "left"), tables, sessions.select("session_id").distinct())
    return out.na.fill(0, ["event_count", "n_regimes"]).na.fill(False, ["inference_skipped"]).select("session_id", *METRICS, "inference_skipped")


def off_range(signatures: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(session_id, metric, value, low, high): numbers of signatures that do not lie within their ranges, ends included; a null never does."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")) for m, (low, high) in ranges.items()])
    return signatures.select("session_id", F.explode(each).alias("r")).select("session_id", "r.*").where("value IS NULL OR isnan(value) OR value < low OR value > high")


def qc_summary(health: DataFrame, closures: DataFrame) -> DataFrame:
    """(session_id, health_score, closure_score, failure_modes, recommendations): a session without a closure score has no reference series."""
    out = health.select("session_id", F.col("overall_score").alias("health_score")).join(closures.select("session_id", "closure_score"), "session_id", "full")
    modes = F.array_compact(F.array(F.when(F.col("closure_score").isNull(), "no_processed_series")))
    return out.withColumn("failure_modes", modes).withColumn("recommendations", F.array().cast("array<string>"))


def findings_report(shifts: DataFrame, gated: DataFrame, starts: DataFrame, seconds: int, refs: tuple[str, ...] = ("timeline",)) -> DataFrame:
    """One row a finding: finding_id, title, summary, t_start, t_end, event_ids, frame_indices, artifact_refs, confidence, qc_penalties, tags, supported, unsupported_reason.

    shifts as regime_shifts gives them, gated as gate does, starts (session_id, t0) where bins of ``seconds`` begin. A session that may be inferred from has a finding for each shift,
    supported by the tables in refs, its confidence lessened by the session's penalty; another has one that is not supported, with the gate's reasons.
    """
    strings, numbers = (lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")), F.array().cast("array<int>")
    ok = gated.select("session_id", "allow", "penalty", F.array_join("reasons", ";").alias("why"))
    at = lambda c: iso(F.timestamp_micros(F.unix_micros("t0") + F.col(c) * F.lit(seconds * 1_000_000)))
    moved = shifts.join(ok.where("allow"), "session_id").join(starts.select("session_id", "t0"), "session_id").withColumns({"t_start": at("before"), "t_end": at("bin")})
    regime = F.col("regime").cast("string")
    moved = moved.select(
        "session_id", stable_id("finding", d=F.round("shift", 3), kind=F.lit("regime_shift"), regime=regime, session=F.col("session_id"), t0=F.col("t_start"), t1=F.col("t_end")).alias("finding_id"),
        F.lit("Regime transition detected").alias("title"), F.concat(F.lit("Regime fraction shift of "), F.format_string("%.2f", "shift"), F.lit(" in regime "), regime, F.lit(" between adjacent time bins.")).alias("summary"),
        "t_start", "t_end", strings().alias("event_ids"), numbers.alias("frame_indices"), strings(*refs).alias("artifact_refs"), (F.col("confidence") * F.col("penalty")).alias("confidence"),
        F.create_map(F.lit("session"), F.col("penalty")).alias("qc_penalties"), strings("regimes", "transition").alias("tags"), F.lit(True).alias("supported"), F.lit(None).cast("string").alias("unsupported_reason"),
    )
    none = F.lit(None).cast("string")
    skipped = ok.where("NOT allow").select(
        "session_id", stable_id("finding", kind=F.lit("inference_skipped"), session=F.col("session_id")).alias("finding_id"), F.lit("Inference skipped").alias("title"), F.lit("The session is not inferred from.").alias("summary"),
        none.alias("t_start"), none.alias("t_end"), strings().alias("event_ids"), numbers.alias("frame_indices"), strings().alias("artifact_refs"), F.lit(1.0).alias("confidence"),
        F.create_map(F.lit("session"), F.col("penalty")).alias("qc_penalties"), strings("gate").alias("tags"), F.lit(False).alias("supported"), F.col("why").alias("unsupported_reason"),
    )
    return moved.unionByName(skipped)


def unsound_findings(report: DataFrame) -> DataFrame:
    """(session_id, finding_id, reason): supported findings without evidence, and others without a reason."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    bare: Column = none("event_ids") & none("frame_indices") & none("artifact_refs")
    reason = F.when(F.col("supported") & bare, "no_evidence").when(~F.col("supported") & (F.coalesce(F.trim("unsupported_reason"), F.lit("")) == ""), "no_reason")
    return report.select("session_id", "finding_id", reason.alias("reason")).where("reason IS NOT NULL")
