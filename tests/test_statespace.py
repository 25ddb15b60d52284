"""Scans against the plain recursions, over pieces of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.operators import statespace


def plainly(ys: list[list[float]], noises: list[float], q: float, x: float, p: float) -> tuple[list[tuple], float]:
    """Filter and smoother step by step, observations of a step one after another."""
    kept, loglik = [], 0.0
    for row in ys:
        xp, pp = x, p + q
        x, p = xp, pp
        for y, v in zip(row, noises, strict=True):
            if y is not None and np.isfinite(y):
                s = p + v
                loglik -= 0.5 * (np.log(2 * np.pi * s) + (y - x) ** 2 / s)
                x, p = x + p / s * (y - x), p * v / s
        kept.append((xp, pp, x, p))
    xs, ps = kept[-1][2:]
    out = [(xs, ps)]
    for k in range(len(kept) - 2, -1, -1):
        c = kept[k][3] / kept[k + 1][1] if kept[k + 1][1] > 0 else 0.0
        xs, ps = kept[k][2] + c * (xs - kept[k + 1][0]), kept[k][3] + c * c * (ps - kept[k + 1][1])
        out.insert(0, (xs, ps))
    return [(*k[2:], *o) for k, o in zip(kept, out, strict=True)], loglik


@pytest.mark.parametrize(("piece", "q"), [(1, 1.0), (3, 0.2), (4096, 1.0), (7, 0.0)])
def test_scans_equal_the_recursions(spark, piece, q):
    rng = np.random.default_rng(7)
    odd = [None, float("nan"), float("inf")]
    value = lambda: odd[rng.integers(3)] if rng.random() < 0.3 else float(rng.normal(3, 5))
    series = {"a": [[value(), value()] for _ in range(53)], "b": [[value(), value()]], "c": [[None, None]] * 5, None: [[value(), None] for _ in range(9)]}
    rows = [(s, 5 * k - 40, *y) for s, ys in series.items() for k, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "session_id string, bin long, `u.v` double, w double").selectExpr("*", "'x' AS k", "1 AS h", "2 AS at").repartition(3)
    got: dict = {}
    for r in statespace.kalman_smooth(df, ["u.v", "w"], q=q, r=2.0, x0=1.0, p0=0.5, penalties={"w": 0.5}, piece=piece).orderBy("bin").collect():
        got.setdefault(r["session_id"], []).append(r)
    assert set(got) == set(series)
    for s, ys in series.items():
        want, loglik = plainly(ys, [2.0, 8.0], q, 1.0, 0.5)
        assert np.allclose([(r["filtered"], r["filtered_var"], r["smoothed"], r["smoothed_var"]) for r in got[s]], want, rtol=1e-9, atol=1e-12)
        assert np.allclose([r["loglik"] for r in got[s]], loglik)
    assert statespace.kalman_smooth(df.limit(0), ["w"]).isEmpty()


@pytest.fixture
def apart(spark):
    """Partitions stay as they are dealt, however small, and small files are not read together."""
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "1m"}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k in small:
        spark.conf.unset(k)


def test_a_session_of_a_million_steps_is_shared_out(spark, apart):
    n = 1_000_000
    df = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("bin"), F.when(F.col("id") % 7 != 0, F.sin(F.col("id") / 1000.0) + F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).alias("y"))
    out = statespace.kalman_smooth(df, ["y"], q=0.1)
    rows = out.withColumn("task", F.spark_partition_id()).agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks"), F.max(F.abs(F.col("smoothed") - F.sin(F.col("bin") / 1000.0) - 0.5)).alias("away")).first()
    assert rows["n"] == n and rows["tasks"] > 1 and rows["away"] < 0.8
    y = np.array([r["y"] if r["y"] is not None else np.nan for r in df.where("bin < 20000").collect()])
    x, p = 0.0, 1.0
    for v in y:
        p += 0.1
        if v == v:
            x, p = x + p / (p + 1) * (v - x), p / (p + 1)
    assert np.isclose(out.where("bin = 19999").first()["filtered"], x, rtol=1e-9)


def test_variances_are_checked(spark):
    df = spark.createDataFrame([("s", 0, 1.0)], "session_id string, bin long, y double")
    for bad in ({"r": 0.0}, {"q": -1.0}, {"p0": -1.0}):
        with pytest.raises(ValueError):
            statespace.kalman_smooth(df, ["y"], **bad)
