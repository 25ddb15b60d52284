"""Operators against hand-computed values."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.functions import scalars as S
from frostline.operators import events, frames, inference, joins, series, statespace
from frostline.sources import tables

UTC = dt.UTC


def at(seconds: float) -> dt.datetime:
    return dt.datetime(2026, 1, 1, tzinfo=UTC) + dt.timedelta(seconds=seconds)


def test_local_times_shift_to_utc_and_bad_ones_are_null(spark):
    df = spark.createDataFrame([("2026-01-05", "10:00:00"), ("01/05/2026", "10:00:00.25"), ("2026/01/05", "1:2:3"), ("bad", "1:2:3"), (None, "1:2:3")], "d string, t string")
    got = [r[0] for r in df.select(F.unix_micros(S.parse_local_time(F.col("d"), F.col("t"), "America/New_York"))).collect()]
    base = int(dt.datetime(2026, 1, 5, 15, tzinfo=UTC).timestamp() * 1e6)
    assert got == [base, base + 250_000, int(dt.datetime(2026, 1, 5, 6, 2, 3, tzinfo=UTC).timestamp() * 1e6), None, None]


def test_centroids(spark):
    df = spark.createDataFrame([("(1.5, 2)",), ("[3,4]",), ("1,2,3",), ("nan,nan",), (None,), ("",)], "c string")
    got = [r[0] for r in df.select(S.centroid(F.col("c"))).collect()]
    assert got[0] == (1.5, 2.0) and got[1] == (3.0, 4.0) and got[2] is None and np.isnan(got[3][0]) and got[4] is None and got[5] is None


def test_quarantine_takes_the_first_reason(spark):
    raw = spark.createDataFrame([("bad", "x", "1,2"), ("2026-01-05", "10:00:00", "1"), ("2026-01-05", "10:00:00", "1,2")], f"Date string, Time string, `{tables.CENTROID}` string").withColumn("row_index", F.lit(0)).withColumn("source_file", F.lit("f"))
    good, bad = tables.normalise_observations(raw, "UTC")
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["centroid_parse_failed", "time_parse_failed"]


def test_nearest_ties_go_back_and_later_duplicates_count(spark):
    left = spark.createDataFrame([("a", at(10), 1), ("a", at(90_000), 2), ("b", at(0), 3)], "session_id string, t timestamp, row_id int")
    right = spark.createDataFrame([("a", at(5), 1), ("a", at(15), 2), ("a", at(5), 4), ("a", at(200_000), 5)], "session_id string, t timestamp, row_id int")
    got = {r["row_id"]: r["r"] and r["r"]["row_id"] for r in joins.nearest(left, right).collect()}
    assert got == {1: 4, 2: 2, 3: None}


def test_changepoints_keep_their_distance(spark):
    values = [0.0 + 0.01 * (i % 3) for i in range(60)]
    values[20] = values[22] = values[50] = 100.0
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "session_id string, frame_idx int, baseline double")
    got = sorted(r["frame_idx"] for r in series.changepoints(df, "baseline", "frame_idx", half=5, separation=10).collect())
    assert got == [20, 50]
    assert series.changepoints(df.limit(5), "baseline", "frame_idx").isEmpty()


def labels_by_hand(mask: np.ndarray) -> dict[tuple[int, int], int]:
    """Each set pixel's component, by flooding."""
    out: dict[tuple[int, int], int] = {}
    for y, x in zip(*np.nonzero(mask), strict=True):
        todo = [(int(y), int(x))]
        while todo:
            p = todo.pop()
            if p in out or not (0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1]) or not mask[p]:
                continue
            out[p] = int(y) * mask.shape[1] + int(x)
            todo += [(p[0] - 1, p[1]), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1)]
    return out


def spiral(n: int) -> np.ndarray:
    """One arm that winds inwards, two pixels apart: the longest path of runs."""
    out = np.zeros((n, n), bool)
    for k in range(0, n // 2, 2):
        out[k, max(0, k - 1) : n - k] = out[k : n - k, n - k - 1] = out[n - k - 1, k : n - k] = True
        out[k + 2 : n - k, k] = True
    return out


def test_components_equal_flooding(spark):
    rng = np.random.default_rng(2)
    masks = [rng.random((9, 7)) < p for p in (0.1, 0.4, 0.6, 0.9, 1.0, 0.5)] + [spiral(21)[:, :7], np.eye(7, dtype=bool)]
    rows = []
    for k, m in enumerate(masks):
        pos = rng.permutation(np.flatnonzero(m.ravel()))  # any order
        rows.append(("s", k, [*pos.tolist(), *pos[:1].tolist()], [-float(p) - 1 for p in [*pos, *pos[:1]]], [float(p) for p in [*pos, *pos[:1]]]))
    df = spark.createDataFrame([*rows, ("s", 99, [], [], []), (None, 1, [5], [-1.0], [2.0])], "session_id string, frame_idx int, pos array<int>, c array<double>, v array<double>")
    got = {(r["session_id"], r["frame_idx"], r["comp"]): r for r in events.components(df, 7).collect()}
    want = {}
    for k, m in enumerate(masks):
        for (y, x), c in labels_by_hand(m).items():
            want.setdefault(("s", k, c), []).append(y * 7 + x)
    assert set(got) == {*want, (None, 1, 5)}
    for key, pos in want.items():
        r = got[key]
        assert r["pos"] == sorted(pos) and r["area"] == len(pos) and r["brightest"] == max(pos) and r["deepest"] == max(pos) + 1
        assert np.allclose((r["cy"], r["cx"], r["energy"]), (np.mean([p // 7 for p in pos]), np.mean([p % 7 for p in pos]), sum(pos) + len(pos)))
    assert events.components(df.limit(0), 7).isEmpty() and events.components(df, 7, least=4).where("area < 4").isEmpty()


def test_labels_of_a_long_spiral():
    m = spiral(201)
    at = np.flatnonzero(np.pad(m, ((0, 0), (0, 1))).ravel())
    start, length, _ = frames.run_lengths(at, np.zeros(len(at), np.int64))
    assert len(set(labels_by_hand(m).values())) == len(set(events.label_runs(start, length, 202).tolist()))


def test_tracks_link_the_nearest_free_component(spark):
    comps = spark.createDataFrame([("s", f, c, y, 0.0, 1.0) for f, c, y in [(0, 0, 0.0), (0, 9, 9.0), (1, 0, 1.0), (1, 9, 8.0), (3, 0, 1.0)]], "session_id string, frame_idx int, comp long, cy double, cx double, deepest double")
    got = {(r["frame_idx"], r["comp"]): r["track"] for r in events.link_tracks(comps, 5.0).collect()}
    assert got == {(0, 0): "0:0", (0, 9): "0:9", (1, 0): "0:0", (1, 9): "0:9", (3, 0): "3:0"}
    assert events.link_tracks(comps.limit(0)).isEmpty()


def tracks_by_hand(rows: list[tuple], reach: float) -> dict[tuple, str]:
    """rows (session, frame, comp, cy, cx): one pass over frames, as the definition has it."""
    out: dict[tuple, str] = {}
    for s in {r[0] for r in rows}:
        active, last = [], None
        for f in sorted({r[1] for r in rows if r[0] == s}):
            if last is not None and f != last + 1:
                active = []
            now, used = [], set()
            for _, _, c, y, x in sorted(r for r in rows if r[0] == s and r[1] == f):
                free = [(float(np.hypot(y - a, x - b)), k) for k, (a, b, _) in enumerate(active) if k not in used]
                d, k = min(free, default=(np.inf, -1))
                name = active[k][2] if d <= reach else f"{f}:{c}"
                used |= {k} if d <= reach else set()
                out[s, f, c] = name
                now.append((y, x, name))
            active, last = now, f
    return out


@pytest.mark.parametrize("block", [1, 3, 64])
def test_tracks_equal_a_plain_loop_whatever_the_blocks(spark, block):
    rng = np.random.default_rng(11)
    rows = [(s, f, int(c), float(rng.integers(0, 12)), float(rng.integers(0, 12))) for s in "ab" for f in range(-5, 60) if rng.random() < 0.93 for c in rng.choice(50, rng.integers(1, 7), replace=False)]
    rows += [("long", f, 0, 0.01 * f, 0.0) for f in range(150)]  # one track over many blocks
    df = spark.createDataFrame(rows, "session_id string, frame_idx int, comp long, cy double, cx double").selectExpr("*", "'x' AS tf", "1 AS block")
    got = {(r["session_id"], r["frame_idx"], r["comp"]): r["track"] for r in events.link_tracks(df, 4.0, block=block).collect()}
    assert got == tracks_by_hand(rows, 4.0)


def test_kalman_equals_the_matrix_form(spark):
    y = [1.0, None, 2.5, 2.0, None, 4.0]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(y)], "session_id string, bin int, y double")
    got = [(r["filtered"], r["smoothed"]) for r in statespace.kalman_smooth(df, ["y"]).orderBy("bin").collect()]
    x, p, keep = 0.0, 1.0, []
    for v in y:
        xp, pp = x, p + 1
        x, p = (xp, pp) if v is None else (xp + pp / (pp + 1) * (v - xp), pp / (pp + 1))
        keep.append((xp, pp, x, p))
    xs = [keep[-1][2]]
    for k in range(len(y) - 2, -1, -1):
        xs.insert(0, keep[k][2] + keep[k][3] / keep[k + 1][1] * (xs[0] - keep[k + 1][0]))
    assert np.allclose(got, [(k[2], s) for k, s in zip(keep, xs, strict=True)])


def test_k_means_goes_on_until_regimes_rest(spark):
    from frostline.sources.stage import Store

    v = np.array([float(i * i) for i in range(40)])
    centres, labels, turns = v[:4].copy(), None, 0
    while labels is None or (new != labels).any():
        labels = np.abs(v[:, None] - centres).argmin(1) if labels is None else new
        centres = np.array([v[labels == j].mean() for j in range(4)])
        new, turns = np.abs(v[:, None] - centres).argmin(1), turns + 1
    assert 10 < turns < 50
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)], "session_id string, k int, v double")
    got = inference.k_means(df, "k", ["v"], keep=Store(spark).keep).orderBy("k").collect()
    assert [r["regime"] for r in got] == labels.tolist()
    assert np.allclose([r["confidence"] for r in got], 1 / (1 + (v - centres[labels]) ** 2))


def test_gate_modes(spark):
    df = spark.createDataFrame([("a", 0.9, None, 0.9, 0.0), ("b", 0.35, 0.3, 0.9, 0.1)], "session_id string, health_score double, closure_score double, alignment_confidence double, gap_fraction double")
    hard = {r["session_id"]: r["allow"] for r in inference.gate(df).collect()}
    soft = {r["session_id"]: r["penalty"] for r in inference.gate(df, "soft").collect()}
    assert hard == {"a": True, "b": False} and soft["a"] == 1.0 and abs(soft["b"] - 0.5**3) < 1e-6


def test_empty_tables(spark):
    none = spark.createDataFrame([], "session_id string, frame_idx int, pixels array<int>")
    assert frames.frame_medians(none).isEmpty() and frames.quiescent_frames(frames.frame_activity(none)).isEmpty()
    with pytest.raises(ValueError):
        tables.read_raw(spark, "/tmp/x.xlsx")


def test_a_shifted_clock_shows_in_the_signed_residual(spark):
    from frostline.operators import joins, quality

    axis = spark.createDataFrame([("s", 10.0, 5)], "session_id string, dt double, n_frames int").selectExpr("session_id", "timestamp_seconds(0) AS t0", "dt", "n_frames")
    rows = spark.createDataFrame([("s", 9), ("s", 19), ("s", 28), ("s", 36)], "session_id string, at long").selectExpr("session_id", "timestamp_seconds(at) AS t")
    mapped = joins.map_to_frames(rows, axis, tolerance=2.0)
    assert sorted((r["frame_idx"], r["residual"]) for r in mapped.where("frame_idx IS NOT NULL").collect()) == [(1, -1.0), (2, -1.0), (3, -2.0)]
    got = quality.mapping_quality(mapped).first()
    assert (got["n"], got["n_mapped"], got["median_residual"]) == (4, 3, -1.0)


def test_penalties_off_the_unit_interval_change_nothing(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([1.0, 3.0, 2.0])], "session_id string, bin int, y double")
    run = lambda p: [(r["smoothed"], r["smoothed_var"]) for r in statespace.kalman_smooth(df, ["y"], penalties=p).orderBy("bin").collect()]
    assert run({"y": 0.0}) == run({"y": 2.0}) == run(None) != run({"y": 0.5})


def test_first_difference_has_none_for_the_first_row_nor_beside_nulls(spark):
    df = spark.createDataFrame([("s", 1, 5.0), ("s", 2, None), ("s", 3, 4.0), ("s", 4, 6.0)], "session_id string, at int, v double")
    assert [r["diff"] for r in series.first_difference(df, "v", "at").orderBy("at").collect()] == [None, None, None, 2.0]


def test_catalog_violations_and_flags_of_empty_tables(spark):
    empty = spark.createDataFrame([], "session_id string, event_id long, frame_start int, frame_peak int, frame_end int")
    assert events.catalog_violations(empty).isEmpty()
    assert series.integrity_flags(spark.createDataFrame([], "session_id string, kind string")).isEmpty()


def test_latent_observations_by_hand(spark):
    from frostline.operators import series

    rows = lambda *r: spark.createDataFrame([("s", at(t), v) for t, v in r], "session_id string, t timestamp, v double")
    axis = series.axis_of(rows((0.5, 0.0), (20.5, 0.0)))
    level = rows((0.5, 1.0), (4, 3.0), (8, 9.0), (12, None), (15, 10.0))
    none = spark.createDataFrame([], "session_id string, t timestamp, v double")
    out = inference.latent_observations(axis, level, rows((1, 0.0), (2, 0.0), (25, 0.0)).drop("v"), rows((10, 4.0), (11, 8.0)), none).orderBy("bin")
    got = [(r["bin"], r["baseline"], r["event_rate"], r["swe_rate"], r["processed_swe"]) for r in out.collect()]
    assert got == [(0, 4.0, 2.0, None, None), (1, 1.0, 0.0, 6.0, None), (2, None, 0.0, None, None)]


def test_a_sessions_penalty_equals_that_of_all_its_columns(spark):
    df = spark.createDataFrame([(s, i, v, p) for s, p in (("a", 0.5), ("b", 0.0), ("c", 1.0)) for i, v in enumerate([1.0, None, 2.0])], "session_id string, bin int, y double, p double")
    run = lambda s, **k: [(r["smoothed"], r["smoothed_var"]) for r in statespace.kalman_smooth(df.where(F.col("session_id") == s), ["y"], **k).orderBy("bin").collect()]
    assert run("a", penalty="p") == run("a", penalties={"y": 0.5})
    assert run("b", penalty="p") == run("c", penalty="p") == run("a")


def test_match_times_fall_back_on_frames(spark):
    matches = spark.createDataFrame([("s", 1, 1, 3.0, 0.0), ("s", 2, 1, 3.0, 0.0)], "session_id string, event_id int, point_id int, dframes double, dxy double")
    peaks = spark.createDataFrame([("s", 1, at(10)), ("s", 2, None)], "session_id string, event_id int, t_peak timestamp")
    points = spark.createDataFrame([("s", 1, at(7.5))], "session_id string, point_id int, t timestamp")
    out = events.match_times(matches, peaks, points, 4.0)
    assert {r["event_id"]: r["dt_s"] for r in out.collect()} == {1: 2.5, 2: 12.0}
    assert events.validation_report(out).first()["mean_dt_s"] == 7.25 and "mean_dt_s" not in events.validation_report(matches).columns


def test_a_session_with_a_known_event(spark):
    """A cold spot of 3 x 3 pixels over six frames among 60 is the one event, and every product has rows that fit it."""
    from frostline.plans import session as analysis
    from frostline.sources.stage import Store

    rng = np.random.default_rng(3)
    stack = 30_000 + rng.normal(0, 8, (60, 12, 12))
    for k in range(30, 36):
        stack[k, 4:7, 5:8] -= 900
    rows = [("s", k, [float(v) for v in f.ravel()]) for k, f in enumerate(stack)]
    frame_rows = spark.createDataFrame(rows, "session_id string, frame_idx int, pixels array<double>")
    axis = spark.createDataFrame([("s", at(0), 1.0, 60)], "session_id string, t0 timestamp, dt double, n_frames int")
    seen = spark.createDataFrame([("s", "p", at(31), 5.0, 6.0, 2.0)], "session_id string, particle_event_id string, t_utc timestamp, y_px double, x_px double, mass_mg double")
    ref = spark.createDataFrame([("s", at(k), 2.0 * (k >= 31)) for k in range(60)], "session_id string, t_utc timestamp, swe_mm double")
    out = analysis.analyse(Store(spark), frame_rows, seen, ref, axis, analysis.Settings(12, 12, k_sigma=8.0, gate="soft"))
    event = out["events"].collect()
    assert [(e["frame_start"], e["frame_end"], e["area_peak_px"], e["start_y"], e["start_x"]) for e in event] == [(30, 35, 9.0, 5.0, 6.0)]
    match = out["matches"].collect()
    assert [(m["event_id"], m["point_id"], m["dframes"], m["dxy"]) for m in match] == [(event[0]["event_id"], "p", 0, 0.0)]
    assert out["validation"].first()["mean_dt_s"] == abs(31 - event[0]["frame_peak"])
    assert out["latent"].count() == 6 and out["violations"].isEmpty() and out["integrity"].isEmpty()
    assert out["phenotype"].first()["n_events"] == 1 and out["gate"].first()["allow"]


def test_clock_changes(spark):
    """In spring an hour lacks and times in it go forward; in autumn one comes twice and the first counts."""
    df = spark.createDataFrame([("2026-03-08", "01:59:59"), ("2026-03-08", "02:30:00"), ("2026-03-08", "03:00:00"), ("2026-11-01", "01:30:00"), ("2026-11-01", "02:00:00")], "d string, t string")
    got = [r[0].strftime("%m-%dT%H:%M:%S") for r in df.select(F.date_format(S.parse_local_time(F.col("d"), F.col("t"), "America/New_York"), "yyyy-MM-dd HH:mm:ss").cast("timestamp")).collect()]
    assert got == ["03-08T06:59:59", "03-08T07:30:00", "03-08T07:00:00", "11-01T05:30:00", "11-01T07:00:00"]


def test_a_configured_step_comes_first(spark):
    one = spark.createDataFrame([("a", 2.0, 9), ("b", None, 1)], "session_id string, dt double, n long")
    other = spark.createDataFrame([("a", 3.0, 5), ("c", 4.0, 100)], "session_id string, dt double, n long")
    got = {r["session_id"]: (r["dt"], r["confidence"], r["source"]) for r in series.cadence_policy(one, other).collect()}
    assert got == {"a": (2.0, 0.9, "aligned_from_tables"), "b": (None, 0.1, "unknown"), "c": (4.0, 0.8, "aligned_from_tables")}
    assert {tuple(r)[1:] for r in series.cadence_policy(one, other, 5.0).collect()} == {(5.0, 0.95, "config")}
    with pytest.raises(ValueError):
        series.cadence_policy(one, other, 0.0)


def test_saturated_events_and_events_too_short(spark):
    rows = [("s", "t", f, 0, 1.0, 1.0, 3.0, 5.0, 100.0 if f < 2 else 60_000.0, 1) for f in range(4)] + [("s", "short", f, 0, 1.0, 1.0, 3.0, 5.0, 1.0, 1) for f in range(2)] + [("s", "flat", f, 0, 1.0, 1.0, 3.0, 5.0, 59_999.0, 1) for f in range(3)]
    df = spark.createDataFrame(rows, "session_id string, track string, frame_idx int, comp long, cy double, cx double, deepest double, energy double, brightest double, area long")
    got = {r["track"]: (r["saturated"], r["frame_peak"], r["duration_s"]) for r in events.event_catalog(df, 8, 8, 2.0).collect()}
    assert got == {"t": (True, 1, 8.0), "flat": (False, 1, 6.0)}


def test_ties_of_tracks_are_those_of_sql():
    """Both components before are equally far by the root of the sum of squares; hypot puts the second nearer."""
    y, x, by, bx = [19 / 3], [19 / 3], [8 / 3, 2.5], [29 / 6, 16 / 3]
    d = duckdb.execute("SELECT sqrt((? - ?::DOUBLE) ** 2 + (? - ?::DOUBLE) ** 2) = sqrt((? - ?::DOUBLE) ** 2 + (? - ?::DOUBLE) ** 2)", [y[0], by[0], x[0], bx[0], y[0], by[1], x[0], bx[1]])
    assert d.fetchall() == [(True,)]
    assert events.match_frames(*map(np.array, (y, x, by, bx)), 5.0).tolist() == [0]


def test_regimes_and_features_bring_no_session_into_one_task(spark):
    """Their plans used to shuffle the rows by session."""
    df = spark.range(0, 300, 1, 3).selectExpr("'s' AS session_id", "id AS k", "CAST(id % 7 AS double) AS v")
    for out in (inference.standardise(df, ["v"]), inference.k_means(df, "k", ["v"], k=2, rounds=2)):
        assert "hashpartitioning" not in out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    got = inference.k_means(df, "k", ["v"], k=2, rounds=1).groupBy("regime").count().count()
    assert got == 2
