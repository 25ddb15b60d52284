"""The mask store: round trips, lookups, odd masks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.sources import masks
from frostline.sources.stage import Store

SHAPE = "session_id string, event_id string, frame_idx int, pos array<int>"


def held(df) -> dict[tuple, list[int]]:
    return {(r["session_id"], r["event_id"], r["frame_idx"]): r["pos"] for r in df.collect()}


def test_masks_come_back_whole_and_singly(spark):
    rng = np.random.default_rng(4)
    rows = [("s", f"e{e}", int(f), np.flatnonzero(rng.random(63) < rng.choice([0.1, 0.6, 1.0])).tolist()) for e in range(20) for f in rng.choice(200, 12, replace=False) - 50]
    rows += [("s", "none", 3, []), ("s", "null", 3, None), ("other", "e1", 7, [0, 62]), (None, "e1", 7, [5])]
    path = f"{Store(spark).root}/m"
    shuffled = [(s, e, f, p and rng.permutation([*p, p[0]]).tolist()) for s, e, f, p in rows]
    masks.write_masks(spark.createDataFrame(shuffled, SHAPE).repartition(4), path, 7, 9, segment=8)
    want = {(s, e, f): p or [] for s, e, f, p in rows}
    assert held(masks.read_masks(spark, path)) == want
    one = rows[17]
    found = masks.read_masks(spark, path, "s", one[1], one[2])
    assert held(found) == {one[:3]: one[3]}
    assert held(masks.read_masks(spark, path, event_id="e1")) == {k: v for k, v in want.items() if k[1] == "e1"}
    index = {(r["session_id"], r["event_id"]): r for r in masks.read_index(spark, path).collect()}
    mine = [r for r in rows if r[1] == "e3"]
    assert index["s", "e3"]["n_frames"] == 12 and index["s", "e3"]["first_frame"] == min(r[2] for r in mine) and index["s", "e3"]["segments"] == len({r[2] // 8 for r in mine})
    assert index["s", "none"]["n_runs"] == 0 == index["s", "null"]["n_runs"] and index["s", "e3"]["encoding"] == "rle_concat_v1"


def test_a_lookup_filters_in_the_scan_and_skips_files_of_other_events(spark, capsys):
    path = f"{Store(spark).root}/m"
    masks.write_masks(spark.range(4000).select(F.lit("s").alias("session_id"), F.format_string("e%05d", "id").alias("event_id"), F.lit(1).alias("frame_idx"), F.array(F.lit(3), F.lit(4)).alias("pos")), path, 3, 3)
    masks.read_masks(spark, path, event_id="e00007", frame_idx=1).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(event_id,e00007)" in plan and "LessThanOrEqual(first_frame,1)" in plan
    files = masks.read_runs(spark, path).select("event_id", F.input_file_name().alias("f")).groupBy("f").agg(F.min("event_id").alias("a"), F.max("event_id").alias("z")).orderBy("a").collect()
    assert all(x["z"] < y["a"] for x, y in zip(files, files[1:], strict=False))  # ranges of events do not overlap, so their statistics prune


def test_rows_of_one_frame_unite_and_bad_places_are_refused(spark):
    path = f"{Store(spark).root}/m"
    twice = spark.createDataFrame([("s", "e", 1, [0, 1]), ("s", "e", 1, [2]), ("s", "e", 1, [1])], SHAPE)
    masks.write_masks(twice, path, 2, 2)
    assert held(masks.read_masks(spark, path)) == {("s", "e", 1): [0, 1, 2]} and masks.read_index(spark, path).first()["n_runs"] == 1
    masks.write_masks(twice.limit(0), path, 2, 2)
    assert masks.read_masks(spark, path).isEmpty() and masks.read_index(spark, path).isEmpty()
    with pytest.raises(Exception, match="outside 2 x 2"):
        masks.encode_masks(spark.createDataFrame([("s", "e", 1, [4])], SHAPE), 2, 2).collect()
