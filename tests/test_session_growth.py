"""What a session analysis does with many rows at few times."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from frostline.operators import series
from frostline.plans import session as analysis
from frostline.sources.stage import Store


def at(seconds: float) -> datetime:
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


def test_each_time_once_with_its_rows_tells_what_all_rows_tell(spark):
    times = [("a", t) for t in (0, 0, 1, 2, 2, 2, 3, 60, 61, None)] + [("b", 5), ("b", 5), ("c", None), ("d", 0), ("d", 7), ("d", 7)]
    rows = spark.createDataFrame([(s, None if t is None else at(t)) for s, t in times], "session_id string, t timestamp")
    once = series.instants(rows)
    assert once.count() == 11
    for one, all_ in (
        (series.cadence(once, rows="n_rows"), series.cadence(rows)),
        (series.time_gaps(once, rows="n_rows"), series.time_gaps(rows)),
        (series.duplicate_times(once, rows="n_rows"), series.duplicate_times(rows)),
    ):
        assert one.schema.simpleString() == all_.schema.simpleString() and sorted(map(str, one.collect())) == sorted(map(str, all_.collect()))


def test_no_table_is_joined_to_the_pairs_and_gaps_are_found_on_few_rows(spark):
    stack = [[30_000.0 + (k * 7 + p * 13) % 17 - (900 if 20 <= k < 24 and p in (26, 27, 38, 39) else 0) for p in range(144)] for k in range(60)]
    frame_rows = spark.createDataFrame([("s", k, f) for k, f in enumerate(stack)], "session_id string, frame_idx int, pixels array<double>")
    axis = spark.createDataFrame([("s", at(0), 1.0, 60)], "session_id string, t0 timestamp, dt double, n_frames int")
    seen = spark.createDataFrame([("s", str(k), at(20 + k % 3), 2.0, 2.0, 1.0) for k in range(300)], "session_id string, particle_event_id string, t_utc timestamp, y_px double, x_px double, mass_mg double")
    ref = spark.createDataFrame([("s", at(k), 2.0) for k in range(60)], "session_id string, t_utc timestamp, swe_mm double")
    plans, kept = {}, {}

    class Noted(Store):
        def keep(self, name, df):
            plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
            kept[name] = super().keep(name, df)
            return kept[name]

    out = analysis.analyse(Noted(spark), frame_rows, seen, ref, axis, analysis.Settings(12, 12, k_sigma=8.0, gate="soft"))
    assert "Join" not in plans["validation"]
    assert kept["instants"].count() == 3
    assert "t_peak" not in out["matches"].columns and out["matches"].count() >= 300
    when = out["events"].select("session_id", "event_id", (F.unix_seconds(F.lit(at(0))) + F.col("frame_peak")).alias("peak"))
    timed = seen.select(F.col("particle_event_id").alias("point_id"), F.unix_seconds("t_utc").alias("t"))
    wanted = out["matches"].join(when, ["session_id", "event_id"]).join(timed, "point_id").agg(F.avg(F.abs(F.col("t") - F.col("peak"))), F.count("*")).first()
    got = out["validation"].first()
    assert abs(got["mean_dt_s"] - wanted[0]) < 1e-9 and got["n_matches"] == wanted[1]
