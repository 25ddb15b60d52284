"""Row numbers under any splits, manifests of large files, artifacts and optional tables."""

import hashlib
import json
import os
import resource

import pytest
from pyspark.sql import functions as F

from frostline.sources import files, tables

PAYLOAD = "a long, b array<double>"


@pytest.fixture
def splits(spark):
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_row_numbers_do_not_depend_on_splits(spark, splits, tmp_path):
    for name, n in (("x.csv", 20_000), ("y.csv", 3), ("empty.csv", 0)):
        (tmp_path / "in.csv").mkdir(exist_ok=True)
        (tmp_path / "in.csv" / name).write_text("path,start,v\n" + "".join(f"{name},{i},{'x' * (i % 40)}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    seen = []
    for size in ("128m", "70k", "9k"):
        splits(size)
        rows = tables.read_raw(spark, str(tmp_path / "in.csv"))
        assert rows.rdd.getNumPartitions() > (1 if size != "128m" else 0)
        got = sorted((r["path"], int(r["start"]), r["row_index"], os.path.basename(r["source_file"])) for r in rows.collect())
        assert all(k == i and f == p for p, k, i, f in got) and len(got) == 20_003
        seen.append(got)
    assert seen[0] == seen[1] == seen[2]


def test_parquet_rows_have_their_numbers_too(spark, splits, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5000).coalesce(1).write.parquet(path)
    splits("4k")
    assert tables.read_raw(spark, path).where("id != row_index").isEmpty()


def test_manifest_hashes_a_large_file_in_chunks(spark, tmp_path):
    large = tmp_path / "in" / "large.bin"
    large.parent.mkdir()
    with large.open("wb") as f:  # over 2 GB, most of it a hole
        f.write(b"head")
        f.seek((2 << 30) + 7)
        f.write(b"tail")
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "sub" / "small name.txt").write_bytes(b"abc")
    (tmp_path / "in" / "none").write_bytes(b"")
    want = {}
    for p in (large, tmp_path / "in" / "sub" / "small name.txt"):
        with p.open("rb") as f:
            want[p.name] = (p.stat().st_size, hashlib.file_digest(f, "sha256").hexdigest())

    def opener(path: str):
        resource.setrlimit(resource.RLIMIT_DATA, (2 << 30, resource.getrlimit(resource.RLIMIT_DATA)[1]))  # the file would not fit
        return files.local_file(path)

    got = {os.path.basename(r["path"]).replace("%20", " "): (r["size"], r["sha256"]) for r in files.input_manifest(spark, str(tmp_path / "in"), opener).collect()}
    assert got == want


def artifact(**more) -> dict:
    return {"header": {"schema_version": "v1", "config_hash": "c", "input_hashes": {"f": "1"}, "created_at_utc": "t"}, "payload": {"a": 1, "b": [1.5]}} | more


def test_artifacts_are_checked(spark, tmp_path):
    good = json.loads(tables.wrap({"a": 2, "b": [0.5, 1.0], "c": "left out"}, "v1", "hash", {"x": "y"}))
    texts = {
        "good": json.dumps(good, indent=2), "part": json.dumps(artifact(payload={"a": 3})), "broken": "{ not json", "list": "[1]", "no_header": json.dumps({"payload": {"a": 1}}), "no_payload": json.dumps(artifact(payload=None)),
        "no_time": json.dumps(artifact(header={**artifact()["header"], "created_at_utc": None})), "old": json.dumps(artifact(header={**artifact()["header"], "schema_version": "v0"})), "type": json.dumps(artifact(payload={"a": "text"})), "empty": " \n",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    sound, rejected = files.read_artifacts(spark, str(tmp_path), PAYLOAD, "v1")
    got = {os.path.basename(r["source_file"])[:-5]: (r["payload"]["a"], r["payload"]["b"], r["config_hash"]) for r in sound.collect()}
    assert got == {"good": (2, [0.5, 1.0], "hash"), "part": (3, None, "c")}
    reasons = {os.path.basename(r["source_file"])[:-5]: r["reason"] for r in rejected.collect()}
    assert reasons == {"broken": "not_json", "list": "not_json", "no_header": "missing_header", "no_payload": "missing_payload", "no_time": "missing_created_at_utc", "old": "wrong_schema_version", "type": "not_json"}
    assert {r["record"] for r in rejected.where(F.col("reason") == "wrong_schema_version").collect()} == {texts["old"]}


def test_optional_tables(spark, tmp_path):
    none = files.read_optional(spark, str(tmp_path / "none"), "a long, b string")
    assert none.isEmpty() and none.dtypes == [("a", "bigint"), ("b", "string")]
    spark.range(3).write.parquet(str(tmp_path / "some"))
    assert files.read_optional(spark, str(tmp_path / "some"), "id long").count() == 3
    with pytest.raises(Exception, match="nonsense"):
        files.read_optional(spark, str(tmp_path / "some"), "id long", kind="nonsense")


def test_artifacts_go_out_and_come_back(spark, tmp_path):
    from frostline.plans.session import Settings

    mark = tables.config_hash(Settings(75, 90))
    assert mark == tables.config_hash(Settings(75, 90)) != tables.config_hash(Settings(75, 90, gate="soft"))
    assert tables.canonical({"b": 1, "a": [1.5, "é"]}) == '{"a":[1.5,"é"],"b":1}'
    with pytest.raises(ValueError):
        tables.canonical({"a": float("nan")})
    tables.write_artifact(spark, str(tmp_path / "a"), tables.wrap({"a": 7, "b": None}, "v1", mark, {"in": "x"}, "regimes", stage="inference"))
    sound, rejected = files.read_artifacts(spark, str(tmp_path / "a"), PAYLOAD, "v1")
    assert [(r["payload"]["a"], r["config_hash"], r["input_hashes"]) for r in sound.collect()] == [(7, mark, {"in": "x"})] and rejected.isEmpty()
    raw = json.loads("".join(r["value"] for r in spark.read.text(str(tmp_path / "a"), wholetext=True).collect()))
    assert raw["header"]["artifact_type"] == "regimes" and raw["header"]["provenance"] == {"stage": "inference"}
