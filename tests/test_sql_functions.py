"""SQL functions against the column functions they repeat."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.functions import scalars as S
from frostline.functions import sql
from frostline.operators import joins


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    sql.register(spark)
    sql.register(spark)


def same(df, text: str, column) -> bool:
    rows = df.select(F.expr(text).alias("a"), column.alias("b")).collect()
    return len(rows) > 0 and all(str(r["a"]) == str(r["b"]) for r in rows)


def test_texts(spark):
    df = spark.createDataFrame([("(1.5, 2)",), ("[3,4]",), ("1,2,3",), ("nan,nan",), (None,), ("",), ("a,1",), (" ( 7 , -8e2 ) ",)], "c string")
    assert same(df, "parse_centroid(c)", S.centroid(F.col("c")))
    assert same(df, "stable_id('x', to_json(named_struct('c', c), map('ignoreNullFields', 'false')))", S.stable_id("x", c=F.col("c")))


def test_times(spark):
    df = spark.createDataFrame([("2026-01-05", "10:00:00"), ("01/05/2026", "10:00:00.25"), ("2026/01/05", "1:2:3"), ("bad", "1:2:3"), (None, "1:2:3"), (" 2026-03-08 ", " 02:30:00 "), ("2026-11-01", "01:30:00")], "d string, t string")
    for zone in ("UTC", "America/New_York"):
        assert same(df, f"parse_local_time(d, t, '{zone}')", S.parse_local_time(F.col("d"), F.col("t"), zone))
    at = spark.range(200).selectExpr("timestamp_millis(id * 777 - 20000) AS t", "timestamp_seconds(0) AS t0")
    assert same(at, "frame_of_time(t, t0, 2.0D, 50)", joins.frame_of_time(F.col("t"), F.col("t0"), 2.0, 50))


def test_numbers(spark):
    df = spark.createDataFrame([(v,) for v in (None, -1.0, 0.0, 0.3, 1.0, 7.5)], "x double")
    assert same(df, "clip01(x)", S.clip01(F.col("x")))
    assert same(df, "mass_to_depth(x, 4D)", S.mass_to_depth(F.col("x"), 4.0)) and same(df, "depth_to_mass(x, 0D)", S.depth_to_mass(F.col("x"), 0.0))


def test_runs_there_and_back(spark):
    rng = np.random.default_rng(3)
    masks = [np.flatnonzero(rng.random(60) < p).tolist() for p in (0.1, 0.5, 0.9, 1.0)] + [[], [5], [3, 1, 2, 2]]
    spark.createDataFrame([(k, m) for k, m in enumerate(masks)] + [(99, None)], "k int, pos array<int>").createOrReplaceTempView("m")
    runs = spark.sql("SELECT k, r.start, r.length FROM m, LATERAL rle_encode(m.pos) r")
    assert runs.where("k = 6").collect()[0][1:] == (1, 3) and runs.where("k IN (4, 99)").isEmpty()
    back = runs.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("r")).select("k", F.expr("rle_decode(r.start, r.length)").alias("pos"))
    assert {r["k"]: r["pos"] for r in back.collect()} == {k: sorted(set(m)) for k, m in enumerate(masks) if m}
