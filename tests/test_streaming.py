"""Streams in shuffled micro-batches give what the batch operators give."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.operators import events
from frostline.sources.stage import Store
from frostline.streaming import backfill, monitor

START = dt.datetime(2026, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def streamed(spark, tmp_path, rows: list[tuple], shape: str, operator, cut: list[int]) -> list[tuple]:
    """The operator's rows over the rows in batches: row i is in batch cut[i]; a last batch far ahead moves the watermark over all."""
    for k in range(max(cut) + 1):
        spark.createDataFrame([r for r, c in zip(rows, cut, strict=True) if c == k], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = START + dt.timedelta(days=400)
    spark.createDataFrame([("end", end, *[None] * (len(rows[0]) - 2))], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = operator(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(240), "the stream did not end"
    finally:
        query.stop()
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("session_id != 'end'").collect())


def batches(rng, seconds: list[float], late: float, size: float) -> list[int]:
    """Batches of rows that come up to ``late`` seconds after others of their time."""
    return [int((s + rng.uniform(0, late)) // size) for s in seconds]


@pytest.mark.parametrize("seed", [1, 2])
def test_the_running_level_equals_a_loop_in_order_of_time(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    seconds = {s: rng.choice(400, 60, replace=False) for s in "ab"}
    rows = [(s, START + dt.timedelta(seconds=int(k)), None if rng.random() < 0.1 else float(rng.normal(3, 2))) for s, ks in seconds.items() for k in ks]
    cut = batches(rng, [(r[1] - START).total_seconds() for r in rows], 50, 110)
    order = rng.permutation(len(rows))
    got = streamed(spark, tmp_path, [rows[i] for i in order], "session_id string, t timestamp, value double", lambda x: monitor.running_level(x, "120 seconds", q=0.5, r=2.0), [cut[i] for i in order])
    want = []
    for s in "ab":
        x, p = 0.0, 1.0
        for n, (_, t, y) in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: r[1]), 1):
            p += 0.5
            if y is not None:
                x, p = x + p / (p + 2.0) * (y - x), p * 2.0 / (p + 2.0)
            want.append((s, t, n, x, p))
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3:] for r in got], [r[3:] for r in want])


def test_streamed_tracks_equal_linked_ones(spark, tmp_path):
    rng = np.random.default_rng(8)
    comps = [(s, f, int(c), float(rng.integers(0, 10)), float(rng.integers(0, 10))) for s in "ab" for f in range(50) if rng.random() < 0.9 for c in rng.choice(40, rng.integers(1, 5), replace=False)]
    at = lambda f: START + dt.timedelta(seconds=4 * f)
    rows = [(s, at(f), f, c, y, x) for s, f, c, y, x in comps]
    cut = batches(rng, [4.0 * r[2] for r in rows], 40, 60)
    got = streamed(spark, tmp_path, rows, "session_id string, t timestamp, frame_idx int, comp long, cy double, cx double", lambda x: monitor.tracks(x, 4.0, "120 seconds"), cut)
    linked = events.link_tracks(spark.createDataFrame(comps, "session_id string, frame_idx int, comp long, cy double, cx double"), 4.0)
    assert got == sorted((r["session_id"], at(r["frame_idx"]), r["frame_idx"], r["comp"], r["track"]) for r in linked.collect())


@pytest.mark.parametrize("cut", [[0, 0, 3, 1, 2, 2], [0, 0, 0, 0, 0, 0]])
def test_a_silent_session_is_forgotten_however_batches_are_cut(spark, tmp_path, cut):
    """After an hour of silence the filter begins anew."""
    rows = [("a", START + dt.timedelta(seconds=s), v) for s, v in ((0, 5.0), (10, 5.0), (9000, 5.0))] + [("b", START + dt.timedelta(seconds=s), 1.0) for s in (6000, 7000, 8000)]
    got = streamed(spark, tmp_path, rows, "session_id string, t timestamp, value double", lambda x: monitor.running_level(x, "1 second", "1 hour"), cut)
    assert [r[2] for r in got if r[0] == "a"] == [1, 2, 1] and [r[2] for r in got if r[0] == "b"] == [1, 2, 3]


def test_bins_and_bursts_equal_those_of_a_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(s, START + dt.timedelta(seconds=int(k)), float(k % 7)) for s in "ab" for k in rng.choice(600, 40, replace=False)]
    cut = batches(rng, [(r[1] - START).total_seconds() for r in rows], 50, 200)
    shape = "session_id string, t timestamp, value double"
    for name, operator in (("bins", lambda x: monitor.binned(x, 60, "120 seconds")), ("bursts", lambda x: monitor.bursts(x, "20 seconds", "120 seconds"))):
        (tmp_path / name).mkdir()
        got = streamed(spark, tmp_path / name, rows, shape, operator, cut)
        assert got == sorted(tuple(r) for r in operator(spark.createDataFrame(rows, shape)).collect())


def test_backfills_of_few_rows_and_of_none(spark):
    rows = spark.createDataFrame([("end", START, 1.0), ("a", None, 2.0), (None, START, 3.0), ("a", START + dt.timedelta(days=900), 4.0)], "session_id string, t timestamp, value double")
    own = backfill.stateful_session(spark)
    got = backfill.backfill(own, rows, lambda x: monitor.binned(x, 60), f"{Store(spark).root}/b")
    assert sorted(((r["session_id"], r["n"]) for r in got.collect()), key=str) == [("a", 1), ("end", 1), (None, 1)]
    level = backfill.backfill(own, rows, monitor.running_level, f"{Store(spark).root}/l", batches=1)
    assert sorted(((r["session_id"], r["n"], r["level"] > 0) for r in level.collect()), key=str) == [("a", 1, True), ("end", 1, True), (None, 1, True)]
    assert backfill.backfill(own, rows.limit(0), monitor.running_level, f"{Store(spark).root}/n").isEmpty()
