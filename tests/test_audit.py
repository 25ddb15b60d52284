"""Audits, anchors, coverage, protocols: odd tables and exchanged parts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.operators import audit, joins, protocols, quality, series
from frostline.plans import session as analysis
from frostline.sources import masks
from frostline.sources.stage import Store


def at(seconds: float) -> dt.datetime:
    return dt.datetime(2026, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=seconds)


def test_suffixes_and_repeated_rows(spark):
    left = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (None, "c", 7)], "k int, v string, only int")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, V string")
    out = audit.suffixed_join(left, right, ["k"], ("_l", "_r"))
    assert out.columns == ["k", "v_l", "only", "V_r"] and sorted(tuple(r) for r in out.collect()) == [(1, "a", 5, "x"), (1, "a", 5, "y"), (1, "b", 6, "x"), (1, "b", 6, "y")]
    series_of = lambda *r: spark.createDataFrame([("s", at(t), v) for t, v in r], "session_id string, t timestamp, swe double")
    got = audit.series_difference(series_of((0, 1.0), (1, 4.0), (2, None), (9, 0.0)), series_of((0, 2.0), (1, 2.0), (2, 5.0)), "swe").first()
    assert (got["n"], got["mean"], got["largest"]) == (3, 0.5, 2.0) and got["std"] == pytest.approx(np.std([-1, 2], ddof=1))
    assert audit.series_difference(series_of((0, 1.0)), series_of((5, 1.0)), "swe").isEmpty()


def test_off_range_and_nulls(spark):
    df = spark.createDataFrame([("a", 5, 0.5, None), ("b", 300, 1.0, 0.2)], "session_id string, event_count long, closure_score double, health_score double")
    got = sorted(tuple(r) for r in audit.off_range(df, {"event_count": (1, 200), "closure_score": (0, 1), "health_score": (0, 1)}).collect())
    assert got == [("a", "health_score", None, 0.0, 1.0), ("b", "event_count", 300.0, 1.0, 200.0)]


def test_findings_must_have_evidence_or_a_reason(spark):
    shape = "session_id string, finding_id string, event_ids array<string>, frame_indices array<int>, artifact_refs array<string>, supported boolean, unsupported_reason string"
    rows = [("s", "1", [], [], ["t"], True, None), ("s", "2", [], [], [], True, None), ("s", "3", [], [4], [], True, None), ("s", "4", [], [], [], False, " "), ("s", "5", [], [], [], False, "gate"), ("s", "6", None, None, None, True, None)]
    assert sorted((r["finding_id"], r["reason"]) for r in audit.unsound_findings(spark.createDataFrame(rows, shape)).collect()) == [("2", "no_evidence"), ("4", "no_reason"), ("6", "no_evidence")]


def test_anchors_fall_back(spark):
    sessions = spark.createDataFrame([(s,) for s in "abcd"], "session_id string")
    rows = lambda *r: spark.createDataFrame([(s, t if t is None else at(t)) for s, t in r], "session_id string, t timestamp")
    out = joins.anchors(sessions, rows(("a", 5), ("a", 3), ("b", None)), rows(("a", 1), ("b", 7)), {"d": "2026-01-01T00:00:09Z"}).select("session_id", F.unix_seconds("t0").alias("t0"), "anchor_source")
    base = int(at(0).timestamp())
    assert {r["session_id"]: (r["t0"] - base, r["anchor_source"]) for r in out.collect()} == {"a": (3, "particle.t_utc.min_raw"), "b": (7, "processed.t_utc.min"), "c": (-base, "epoch_fallback"), "d": (9, "config.synthetic_t0_utc")}


def test_mapping_keeps_columns_and_bounds(spark):
    axis = spark.createDataFrame([("s", at(0), 10.0, 3)], "session_id string, t0 timestamp, dt double, n_frames int")
    rows = spark.createDataFrame([("s", at(t), t) for t in (-20, -4, 0, 5, 15, 24, 25, 90)], "session_id string, t timestamp, k int").selectExpr("*", "1 AS t0", "2 AS dt", "3 AS n_frames", "4 AS axis", "5 AS frame")
    for held, want in ((True, [0, 0, 0, 0, 1, 2, 2, 2]), (False, [None, 0, 0, 0, 2, 2, 2, None])):
        out = joins.map_to_frames(rows, axis, tolerance=None, held=held)
        assert [r["frame_idx"] for r in out.orderBy("k").collect()] == want and set(rows.columns) <= set(out.columns)
        assert out.select("t0", "dt", "n_frames", "axis", "frame").distinct().collect() == [(1, 2, 3, 4, 5)]


def test_coverage_is_the_greater_of_two(spark):
    mapped = lambda *r: spark.createDataFrame([("s", f) for f in r], "session_id string, frame_idx int")
    cadence = spark.createDataFrame([("s", 0.5), ("none", 1.0)], "session_id string, confidence double")
    got = {r["session_id"]: (r["coverage"], r["alignment_confidence"]) for r in quality.alignment_confidence(mapped(1, None), mapped(1, 1, None, 2), cadence).collect()}
    assert got == {"s": (0.75, pytest.approx(0.6)), "none": (0.0, pytest.approx(0.6))}


def test_sourced_findings_of_empty_tables(spark):
    none = spark.createDataFrame([], "session_id string, t timestamp, v double, k int")
    assert series.sourced_integrity(none, none, "v", "k").isEmpty()
    rows = spark.createDataFrame([("s", at(t), float(-t), t) for t in (0, 1, 1, 2, 60)], "session_id string, t timestamp, v double, k int")
    got = [(r["source"], r["kind"], r["place"]) for r in series.sourced_integrity(rows, rows, "v", "k").orderBy("place").collect()]
    assert got == [("particle", "duplicate", 1), ("particle", "missing", 2), ("processed", "duplicate", 3), ("processed", "missing", 4), ("processed", "non_monotonic", 5)]


class Doubled(protocols.Calibrator):
    version = "doubled"

    def predict(self, catalog):
        return catalog.withColumn("mass_mg", F.lit(2.0)).withColumn("mass_uncertainty_mg", F.lit(1.0))


class First(protocols.ThresholdExtractor):
    """Only the first event of a session."""

    def extract(self, frame_rows, state, keep):
        events, found = super().extract(frame_rows, state, keep)
        first = events.groupBy("session_id").agg(F.min_by("event_id", "frame_start").alias("event_id"))
        return events.join(first, ["session_id", "event_id"], "left_semi"), found.join(first, ["session_id", "event_id"], "left_semi")


def test_extractors_and_calibrators_can_be_exchanged(spark):
    with pytest.raises(TypeError):
        protocols.Extractor()
    rng = np.random.default_rng(3)
    stack = 30_000 + rng.normal(0, 8, (60, 12, 12))
    for first, y in ((10, 2), (40, 7)):
        stack[first : first + 5, y : y + 3, 5:8] -= 900
    frame_rows = spark.createDataFrame([("s", k, f.ravel().tolist()) for k, f in enumerate(stack)], "session_id string, frame_idx int, pixels array<double>")
    axis = spark.createDataFrame([("s", at(0), 1.0, 60)], "session_id string, t0 timestamp, dt double, n_frames int")
    seen = spark.createDataFrame([("s", "p", at(12), 3.0, 6.0, 2.0)], "session_id string, particle_event_id string, t_utc timestamp, y_px double, x_px double, mass_mg double")
    ref = spark.createDataFrame([("s", at(k), 2.0) for k in range(60)], "session_id string, t_utc timestamp, swe_mm double")
    settings = analysis.Settings(12, 12, k_sigma=8.0, gate="soft")
    out = analysis.analyse(Store(spark), frame_rows, seen, ref, axis, settings, First(12, 12, 8.0, dt_seconds=1.0), Doubled())
    assert [(e["frame_start"], e["mass_mg"]) for e in out["events"].collect()] == [(10, 2.0)]
    path = f"{Store(spark).root}/m"
    masks.write_masks(out["masks"], path, 12, 12)
    held = masks.read_masks(spark, path).orderBy("frame_idx").collect()
    assert [r["frame_idx"] for r in held] == [10, 11, 12, 13, 14] and all(r["pos"] == [y * 12 + x for y in (2, 3, 4) for x in (5, 6, 7)] for r in held)
    mark = out["signature"].first()
    assert (mark["event_count"], mark["n_regimes"], mark["inference_skipped"]) == (1, 1, False) and 0 <= mark["health_score"] <= 1
    assert audit.off_range(out["signature"], {"event_count": (1, 200), "closure_score": (0, 1), "health_score": (0, 1), "n_regimes": (1, 10)}).isEmpty()
    assert out["mapped_range"].first()["frame_first"] == 12 and out["difference"].first()["n"] == 60
    assert out["qc_summary"].first()["failure_modes"] == [] and audit.unsound_findings(out["findings"]).isEmpty()
