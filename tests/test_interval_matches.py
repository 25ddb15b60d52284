"""Pairs of intervals and points against brute force, with batches that cut pieces and pieces that cut intervals."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.operators import joins

EVENTS = "session_id string, event_id long, frame_start long, frame_end long, y double, x double, tag string"
POINTS = "session_id string, point_id long, frame_idx long, y double, x double, note string"


def tables(spark):
    rng = np.random.default_rng(5)
    e = [("ab"[k % 2], k, int(f), int(f + n), float(y), float(x), f"e{k}") for k, (f, n, y, x) in enumerate(zip(rng.integers(-40, 300, 400), rng.choice([-6, -2, 0, 3, 90], 400), rng.integers(-20, 60, 400), rng.integers(-20, 60, 400), strict=True))]
    p = [("ab"[k % 2], k, int(f), float(y), float(x), f"p{k}") for k, (f, y, x) in enumerate(zip(rng.integers(-40, 300, 900), rng.integers(-20, 60, 900) + 0.5, rng.integers(-20, 60, 900), strict=True))]
    e += [("a", 9000, None, 5, 1.0, 1.0, "null"), ("a", 9001, 5, 5, float("nan"), 1.0, "nan"), (None, 9002, 5, 5, 1.0, 1.0, "none"), e[0]]
    p += [("a", 9000, None, 1.0, 1.0, "null"), ("a", 9001, 5, None, 1.0, "null"), ("a", 9002, 5, float("inf"), 1.0, "inf")]
    return e, p, spark.createDataFrame(e, EVENTS), spark.createDataFrame(p, POINTS)


def by_hand(events, points):
    out = []
    for s, k, a, z, y, x, tag in events:
        for t, n, f, v, u, note in points:
            if s is not None and s == t and None not in (a, z, f, v) and np.isfinite([y, v]).all() and max(0, a - f, f - z) <= 2 and np.hypot(y - v, x - u) <= 6:
                out.append((s, k, n, max(0, a - f, f - z), round(float(np.hypot(y - v, x - u)), 9), tag, note))
    return sorted(out)


@pytest.mark.parametrize(("width", "batch"), [(None, 10_000), (8, 7), (64, 1)])
def test_pairs_equal_brute_force_and_take_columns_along(spark, width, batch):
    e, p, events, points = tables(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = joins.interval_matches(events, points, 2.0, 6.0, width, ["tag"], ["note"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r["session_id"], r["event_id"], r["point_id"], r["dframes"], round(r["dxy"], 9), r["tag"], r["note"]) for r in got) == by_hand(e, p)


def test_one_shuffle_and_no_join(spark):
    """Each event used to be shuffled once for each of nine squares and each of two or three buckets of frames."""
    *_, events, points = tables(spark)
    text = io.StringIO()
    with redirect_stdout(text):
        joins.interval_matches(events, points, 2.0, 6.0).agg(F.count("*")).explain()
    assert text.getvalue().count("hashpartitioning") == 1 and "Join" not in text.getvalue()
