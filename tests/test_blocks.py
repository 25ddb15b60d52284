"""Windows in blocks against windows over whole sessions, sliding medians and separation against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.operators import blocks, series
from frostline.sources.stage import Store


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    out = []
    for s, n in (("long", 700), ("b", 40), (None, 60), ("one", 1), ("c", 130)):
        at = rng.permutation(n) * 3 - 50
        out += [(s, int(a), None if rng.random() < 0.1 else float(rng.integers(0, 30)), int(k)) for k, a in enumerate(at)]
    return spark.createDataFrame(out, "session_id string, at long, v double, id int").selectExpr("*", "7 AS number", "8 AS block", "9 AS part", "10 AS `place`", "11 AS before", "12 AS sid", "13 AS piece", "14 AS total_").repartition(6).cache()


def table(df) -> list[str]:
    return sorted(str(r) for r in df.select(*sorted(df.columns)).collect())


def test_numbers_are_dense_in_order(spark, rows):
    got = blocks.numbered(rows, ["at"], Store(spark).keep, "n")
    want = rows.selectExpr("*", "row_number() OVER (PARTITION BY session_id ORDER BY at) - 1L AS n")
    assert table(got) == table(want)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_windows_in_blocks_equal_whole_ones(spark, rows, block):
    make = lambda w: {"up": F.lag("v", 2).over(w), "down": F.lead("v").over(w), "near": F.sum("v").over(w.rowsBetween(-3, 4))}
    got, want = (blocks.windowed(rows, ["at"], 3, 4, make, held=held, block=block) for held in (100, 10_000))
    assert table(got) == table(want)
    got, want = (blocks.running_sum(rows, "v", ["at"], "total", held=held, block=block) for held in (100, 10_000))
    assert table(got) == table(want) and got.count() == rows.count()


@pytest.mark.parametrize(("half", "held", "block"), [(0, 10_000, 4096), (2, 100, 16), (5, 10_000, 1), (900, 100, 64)])
def test_rolling_medians_equal_numpys(spark, rows, half, held, block):
    got = {(r["session_id"], r["at"]): r["m"] for r in series.rolling_median(rows, "v", "at", half, "m", held=held, block=block).collect()}
    whole = {}
    for r in rows.collect():
        whole.setdefault(r["session_id"], []).append((r["at"], r["v"]))
    for s, pairs in whole.items():
        pairs.sort()
        for k, (at, _) in enumerate(pairs):
            near = [v for _, v in pairs[max(0, k - half) : k + half + 1] if v is not None]
            assert got[s, at] == (float(np.median(near)) if near else None)
    assert series.rolling_median(rows.limit(0), "v", "at").isEmpty()


def test_sliding_medians_leave_out_nan():
    v = np.array([np.nan, np.nan, 1.0, 5.0, np.nan, np.nan, np.nan])
    assert np.array_equal(series.sliding_medians(v, 1), [np.nan, 1.0, 3.0, 3.0, 5.0, np.nan, np.nan], equal_nan=True)


@pytest.mark.parametrize(("separation", "block"), [(1, 4), (5, 5), (30, 64), (30, 1), (0, 3), (1000, 8)])
def test_separation_equals_a_plain_loop(spark, separation, block):
    rng = np.random.default_rng(separation)
    flagged = {s: sorted(rng.choice(2000, n, replace=False).tolist()) for s, n in (("a", 300), ("b", 2), ("c", 1500), (None, 40))}
    df = spark.createDataFrame([(s, r, float(r)) for s, rows in flagged.items() for r in rows], "session_id string, row long, x double").selectExpr("*", "1 AS block", "2 AS near", "3 AS b").repartition(5)
    got: dict = {}
    for r in series.separated(df, separation, Store(spark).keep, block).collect():
        assert r["x"] == r["row"]
        got.setdefault(r["session_id"], []).append(r["row"])
    for s, rows in flagged.items():
        want, last = [], -(10**9)
        for r in rows:
            if r - last >= separation:
                want.append(r)
                last = r
        assert sorted(got[s]) == want
    assert series.separated(df.limit(0), 30, Store(spark).keep).isEmpty()


def test_changepoints_of_split_sessions_equal_those_of_whole_ones(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, 900)
    v[[100, 110, 140, 500, 899]] += 60.0
    df = spark.createDataFrame([("s", 7 * k, float(x)) for k, x in enumerate(v)], "session_id string, frame_idx int, baseline double")
    cut, whole = (sorted(map(tuple, series.changepoints(df, "baseline", "frame_idx", 20, held=held, block=block).collect())) for held, block in ((50, 64), (10_000, 1 << 16)))
    assert cut == whole and [r[1] for r in whole] == [700, 980, 3500, 6293]


def test_steps_and_rates_of_split_sessions_equal_those_of_whole_ones(spark, monkeypatch):
    df = spark.range(500).selectExpr("'s' AS session_id", "id AS at", "CAST(pmod(xxhash64(id), 50) AS double) AS v", "timestamp_seconds(id * 3 - pmod(id, 2)) AS t")

    def all_of():
        return [table(x) for x in (series.steps(df), series.cadence(df), series.monotonicity(df, "v", "at"), series.windowed_rate(df, "v", "at", 2.0), series.robust_rate(df, "v", "at", 2.0), series.first_difference(df, "v", "at"))]

    whole = all_of()
    for name in ("windowed", "medians"):
        monkeypatch.setattr(series, name, lambda *a, f=getattr(series, name), **k: f(*a, **k, held=60))
    assert all_of() == whole
