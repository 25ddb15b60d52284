"""Quantiles by selection against percentile."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.operators import selection

WANTED = {"q10": 0.1, "q50": 0.5, "q90": 0.9, "least": 0.0, "most": 1.0, "odd": 0.123}


def both(df, keys, held, sort):
    wanted = {n: (F.col("v"), p) for n, p in WANTED.items()} | {"w50": (F.col("w") * 2, 0.5)}
    got = selection.quantiles(df, keys, wanted, held=held, sort=sort)
    want = df.groupBy(*keys).agg(*[F.percentile(c.cast("double"), p).alias(n) for n, (c, p) in wanted.items()])
    plain = lambda x: sorted(((*(str(r[k]) for k in keys), *((-1e300 if r[n] is None else r[n]) for n in wanted)) for r in x.collect()), key=str)
    return plain(got), plain(want)


@pytest.mark.parametrize(("sort", "keys"), [(0, ["g"]), (7, ["g", "h"])])
def test_selection_equals_percentile(spark, sort, keys):
    rng = np.random.default_rng(3)
    rows = []
    for g in ("normal", "ties", "wide", "negative", "tiny", None, "one"):
        n = 1 if g == "one" else int(rng.integers(150, 400))
        v = {"normal": rng.normal(size=n), "ties": rng.integers(0, 3, n).astype(float), "wide": 10.0 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n), "negative": -rng.random(n) * 1e6, "tiny": rng.integers(-5, 5, n) * 5e-324}.get(g, rng.random(n))
        rows += [(g, k % 3, float(x) if rng.random() < 0.9 else None, int(k)) for k, x in enumerate(v)]
    rows += [("empty", 0, None, None)] * 200 + [("zeros", 0, z, 1) for z in (0.0, -0.0) * 80]
    df = spark.createDataFrame(rows, "g string, h int, v double, w long").selectExpr("*", "1 AS b", "2 AS prefix", "3 AS name", "4 AS rank").repartition(5)
    got, want = both(df, keys, 50, sort)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[: len(keys)] == b[: len(keys)] and np.allclose(a[len(keys) :], b[len(keys) :], rtol=1e-12, atol=0)


def test_selection_of_one_huge_group(spark):
    df = spark.range(3_000_000).select(F.lit("s").alias("g"), F.pmod(F.xxhash64("id"), F.lit(10_000_019)).cast("double").alias("v"), F.col("id").alias("w"))
    got, want = both(df, ["g"], 100_000, 1 << 16)
    assert got == want


def test_small_groups_and_empty_tables_go_to_percentile(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 4), ("b", None, None)], "g string, v double, w long")
    got, want = both(df, ["g"], 10, 10)
    assert got == want and selection.quantiles(df.limit(0), ["g"], {"m": (F.col("v"), 0.5)}).isEmpty()
    assert [tuple(r) for r in selection.medians(df, ["g"], m=F.col("v")).orderBy("g").collect()] == [("a", 2.0), ("b", None)]


def test_bits_are_ordered_as_numbers_are(spark):
    v = [float("-inf"), -1e308, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1.5, 1e308, float("inf")]
    df = spark.createDataFrame([(x,) for x in v], "v double").select("v", selection.ordered_bits("v").alias("b"))
    rows = df.orderBy("b").select("v", selection.from_bits("b").alias("back")).collect()
    assert [r["v"] for r in rows] == v == [r["back"] for r in rows]
