"""A whole session analysis as written tables: frames, observations and a reference series in, all products out.

Tables may hold many sessions; each operator works on all of them at once. Products that others read are written first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.operators import audit, events, frames, inference, joins, quality, series, statespace
from frostline.operators.protocols import Calibrator, Extractor, LinearCalibrator, ThresholdExtractor
from frostline.sources.stage import Store


@dataclass(frozen=True)
class Settings:
    """Parameters of an analysis; the defaults are those of the stages."""

    height: int
    width: int
    dt_seconds: float = 1.0
    quiescent_share: float = 0.2
    quiescent_least: int = 30
    k_sigma: float = 5.0
    link_reach: float = 5.0
    match_seconds: float = 2.0
    match_pixels: float = 6.0
    area_mm2: float = 1.0
    slope: float = 3e-4
    regimes: int = 4
    gate: str = "hard"
    bin_seconds: int = 10
    proxy: str = "diff"


FEATURES = ["snr", "delta_peak", "energy", "area_peak_px", "duration_s", "motion_score", "edge_proximity"]


def analyse(store: Store, frame_rows: DataFrame, observed: DataFrame, reference: DataFrame, axis: DataFrame, s: Settings, extractor: Extractor | None = None, calibrator: Calibrator | None = None) -> dict[str, DataFrame]:
    """All products by name; events are found by extractor and weighed by calibrator, the threshold one and the linear one of the settings if not given.

    frame_rows (session_id, frame_idx, pixels), observed (session_id, particle_event_id, t_utc, y_px, x_px, mass_mg),
    reference (session_id, t_utc, swe_mm), axis (session_id, t0, dt, n_frames).
    """
    out: dict[str, DataFrame] = {}
    timeline = joins.frame_axis(axis)
    out["baseline"] = store.keep("baseline", frames.frame_medians(frame_rows))
    out["activity"] = store.keep("activity", frames.frame_activity(frame_rows))
    calm = frames.quiescent_frames(out["activity"], s.quiescent_share, s.quiescent_least)
    out["pixel_state"] = store.keep("pixel_state", frames.pixel_state(frame_rows.join(calm.select("session_id", "frame_idx"), ["session_id", "frame_idx"], "left_semi")))
    out["health"] = store.keep("health", frames.instrument_health(out["baseline"], out["pixel_state"], out["activity"]))
    extractor = extractor or ThresholdExtractor(s.height, s.width, s.k_sigma, s.link_reach, dt_seconds=s.dt_seconds)
    calibrator = calibrator or LinearCalibrator(s.slope)
    catalog, out["masks"] = extractor.extract(frame_rows, out["pixel_state"], store.keep)
    catalog = calibrator.predict(events.with_context(catalog, frames.state_pixels(out["pixel_state"], s.width), out["baseline"]))
    catalog = out["events"] = store.keep("events", catalog)
    placed = store.keep("mapped", joins.map_to_frames(observed, axis, "t_utc"))
    mapped = placed.where("frame_idx is not null")
    out["mapped_range"] = audit.mapped_range(placed, "t_utc")
    when = catalog.join(timeline.withColumnRenamed("frame_idx", "frame_peak"), ["session_id", "frame_peak"]).select("session_id", "event_id", "t")
    points = mapped.select("session_id", F.col("particle_event_id").alias("point_id"), "frame_idx", F.col("y_px").alias("y"), F.col("x_px").alias("x"), F.col("t_utc").alias("t"))
    spans = catalog.select("session_id", "event_id", "frame_start", "frame_end", F.col("start_y").alias("y"), F.col("start_x").alias("x")).join(when.withColumnRenamed("t", "t_peak"), ["session_id", "event_id"], "left")
    # pairs take their times along, so that nothing is joined to as many rows as there are pairs; short pieces of frames share them out among the tasks
    reach = s.match_seconds / s.dt_seconds
    pairs = store.keep("matches", joins.interval_matches(spans, points, reach, s.match_pixels, max(1, int(8 * reach)), ["t_peak"], ["t"]))
    out["matches"] = pairs.drop("t_peak", "t")
    out["validation"] = store.keep("validation", events.validation_report(events.match_times(pairs, None, None, s.dt_seconds)))
    # gaps, repeats and the cadence follow from each time once, with how many rows have it
    seen_at = store.keep("instants", series.instants(observed, "t_utc"))
    falls = series.monotonicity(reference, "swe_mm", "t_utc")
    out["integrity"] = store.keep("integrity", series.integrity_report(series.time_gaps(seen_at, "t_utc", rows="n_rows"), series.duplicate_times(seen_at, "t_utc", "n_rows"), falls))
    out["integrity_flags"] = series.integrity_flags(out["integrity"])
    out["violations"] = events.catalog_violations(catalog)
    product = inference.event_rate(inference.reconstruct(catalog.where("mass_mg >= 0"), timeline, s.area_mm2), s.dt_seconds)
    product = series.robust_rate(series.windowed_rate(product, "total", "frame_idx", s.dt_seconds), "total", "frame_idx", s.dt_seconds)
    # of reference rows at one time the largest value counts, so that none of the product's rows is doubled
    product = product.join(reference.groupBy("session_id", F.col("t_utc").alias("t")).agg(F.max("swe_mm").alias("swe_mm")), ["session_id", "t"], "left")
    product = out["series"] = store.keep("series", product)
    out["closure"] = store.keep("closure", inference.closure(product, "total", "swe_mm"))
    z = inference.standardise(catalog.select("session_id", "event_id", *FEATURES), FEATURES)
    out["regimes"] = store.keep("regimes", inference.k_means(store.keep("features", z), "event_id", FEATURES, s.regimes, keep=store.keep))
    out["timeline"] = store.keep("timeline", inference.regime_timeline(out["regimes"].join(when, ["session_id", "event_id"]), s.regimes))
    out["phenotype"] = inference.phenotype(catalog, product, out["regimes"], out["health"], out["closure"])
    policy = series.cadence_policy(series.cadence(seen_at, "t_utc", "n_rows"), series.cadence(reference, "t_utc"))
    policy = axis.select("session_id").join(policy, "session_id", "left").na.fill(0.1, ["confidence"])
    confidence = store.keep("alignment", quality.alignment_confidence(placed, joins.map_to_frames(reference, axis, "t_utc"), policy)).select("session_id", "alignment_confidence")
    scores = out["health"].select("session_id", F.col("overall_score").alias("health_score")).join(out["closure"].select("session_id", "closure_score"), "session_id", "left").join(confidence, "session_id", "left")
    out["gate"] = store.keep("gate", inference.gate(scores.join(series.gap_fraction(out["integrity"]), "session_id", "left").na.fill(0.0, ["gap_fraction"]), s.gate))
    level = out["baseline"].join(timeline, ["session_id", "frame_idx"]).select("session_id", "t", F.col("baseline").alias("v"))
    rates = product.select("session_id", "t", F.col("rate_robust").alias("v"))
    seen = inference.latent_observations(series.axis_of(timeline), level, when, rates, reference.select("session_id", F.col("t_utc").alias("t"), F.col("swe_mm").alias("v")), s.bin_seconds, s.proxy)
    seen = seen.join(out["gate"].where("allow").select("session_id", "penalty"), "session_id")
    out["latent"] = store.keep("latent", statespace.kalman_smooth(seen, inference.LATENT, penalty="penalty", keep=store.keep))
    starts = out["regimes"].join(when, ["session_id", "event_id"]).groupBy("session_id").agg(F.min("t").alias("t0"))
    out["findings"] = audit.findings_report(inference.regime_shifts(out["timeline"], s.regimes), out["gate"], starts, 60)
    out["qc_summary"] = audit.qc_summary(out["health"], out["closure"])
    out["signature"] = audit.signature(axis, catalog, out["closure"], out["health"], out["baseline"], out["pixel_state"], out["regimes"], out["gate"])
    made = product.select("session_id", "t", F.col("total").alias("swe"))
    out["difference"] = audit.series_difference(made, reference.select("session_id", F.col("t_utc").alias("t"), F.col("swe_mm").alias("swe")), "swe")
    return out
