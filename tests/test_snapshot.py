"""Golden rows, wrong plans that must differ, and invariance of the watermark."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import compact, snapshot
from tidemark.plans import front
from tidemark.sources import derived, manifest, schemas

BASE = [(1, "OPEN", "west", 100, 1, 5), (2, "OPEN", "west", 90, 1, 5), (4, "OPEN", "east", 200, 1, 8), (5, "CLOSED", "east", 300, 1, 8), (6, "OPEN", "east", 60, 1, 8), (7, "OPEN", "west", 500, 1, 5), (8, "OPEN", "west", 40, 1, 5)]
TAIL = [
    (1, 8, "UPDATE", "west", "CLOSED", "west", 100, 1, 2),
    (1, 12, "UPDATE", "west", "CLOSED", "west", 110, 1, 2),
    (2, 9, "DELETE", "west", None, None, None, None, 2),
    (3, 10, "INSERT", None, "OPEN", "west", 80, 0, 2),
    (4, 12, "UPDATE", "east", "OPEN", "east", 210, 2, 2),
    (6, 7, "INSERT", None, "OPEN", "east", 60, 0, 2),
    (7, 11, "UPDATE", "west", "OPEN", "east", 505, 7, 2),
    (8, 6, "UPDATE", "west", "OPEN", "west", 45, 0, 2),
    (9, 13, "INSERT", None, "OPEN", "west", 70, 0, 2),
]
GOLDEN = [(1, "CLOSED", "west", 110, 1), (3, "OPEN", "west", 80, 0), (4, "OPEN", "east", 210, 2), (5, "CLOSED", "east", 300, 0), (6, "OPEN", "east", 60, 0), (7, "OPEN", "east", 505, 7), (8, "OPEN", "west", 45, 0)]


@pytest.fixture(scope="module")
def fixture(spark):
    return spark.createDataFrame(BASE, schemas.BASE_V1), spark.createDataFrame(TAIL, schemas.TAIL_V2)


def rows(df):
    return [tuple(r) for r in df.orderBy("id", "part").collect()]


def test_golden(fixture):
    base, tail = fixture
    assert rows(snapshot.overlay(base, tail, 12, 5)) == GOLDEN
    assert rows(snapshot.overlay_single_pass(base, tail, 12, 5)) == GOLDEN


def test_by_partition_with_a_trimmed_tail(fixture):
    base, tail = fixture
    assert rows(snapshot.overlay_by_partition(base, tail, 12, {"west": 5, "east": 8})) == GOLDEN


def test_poisons_differ(fixture):
    base, tail = fixture
    early = snapshot.overlay(base, tail.where("status = 'OPEN'"), 12, 5).where("status = 'OPEN'")
    assert rows(early) != [r for r in GOLDEN if r[1] == "OPEN"]
    assert (8, "OPEN", "west", 40, 0) in rows(snapshot.overlay(base, tail, 12, 8))  # the largest watermark is wrong
    local = schemas.normalize(base.join(tail.where("commit_version <= 12").select("id", "part"), ["id", "part"], "left_anti"), 1)
    assert (7, "OPEN", "west", 500, 0) in rows(local)  # invalidating inside a partition keeps the old place


def test_continuation(fixture):
    base, tail = fixture
    identity = {"table": "o", "target_version": 12, "schema_version": 2, "partition_epoch": 0}
    token = snapshot.Continuation(**identity, last_id=5, last_part="east")
    assert [r[0] for r in rows(snapshot.page(snapshot.overlay(base, tail, 12, 5), 10, token, **identity))] == [6, 7, 8]
    with pytest.raises(ValueError):
        snapshot.page(snapshot.overlay(base, tail, 13, 5), 10, token, **identity | {"target_version": 13})


def test_filters_reach_the_base_only(spark, fixture, tmp_path):
    base, tail = fixture
    base.write.parquet(f"{tmp_path}/b")
    tail.write.parquet(f"{tmp_path}/t")
    out = snapshot.overlay(spark.read.parquet(f"{tmp_path}/b"), spark.read.parquet(f"{tmp_path}/t"), 12, 5).where("status = 'OPEN'")
    plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
    filters = [line.split("PushedFilters: ")[1] for line in plan if "PushedFilters" in line]
    assert sum("EqualTo(status,OPEN)" in x for x in filters) == 1
    hiding = [line for line in plan if "ReadSchema: struct<id:bigint,commit_version:bigint>" in line]
    assert hiding and all("status" not in line for line in hiding)


@pytest.mark.parametrize("watermark", [6, 8, 10, 12])
def test_result_does_not_depend_on_the_watermark(spark, watermark):
    folder = "/root/testdata/sf0.001"
    base, tail = derived.base(spark, folder), derived.tail(spark, folder)
    want = snapshot.overlay(base, tail, 12, 5)
    rebuilt = compact.objectify(snapshot.overlay(base, tail, watermark, 5), watermark)
    got = snapshot.overlay(rebuilt, tail, 12, watermark)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_manifest(spark, fixture, tmp_path):
    base, tail = fixture
    base.write.parquet(f"{tmp_path}/b")
    for after, through in ((5, 9), (9, 13)):
        compact.segment(tail, after, through).write.parquet(f"{tmp_path}/s{through}")
    made = manifest.Manifest({"west": 5, "east": 8}, 13, base_files=[f"{tmp_path}/b"], segments=[manifest.Segment(5, 9, f"{tmp_path}/s9"), manifest.Segment(9, 13, f"{tmp_path}/s13")])
    path = f"{tmp_path}/m.json"
    stored = manifest.store(made, path, 0)
    assert manifest.load(path) == stored and json.load(open(path))["epoch"] == 1
    with pytest.raises(RuntimeError):
        manifest.store(made, path, 0)
    assert rows(snapshot.snapshot(spark, stored, 12)) == GOLDEN
    assert front.at_version(spark, "SELECT max(amount_cents) AS m FROM {orders}", {"orders": stored}, 12).first()["m"] == 505
    for target in (7, 14):
        with pytest.raises(manifest.SnapshotUnavailable):
            snapshot.snapshot(spark, stored, target)
    with pytest.raises(manifest.SnapshotUnavailable):
        manifest.Manifest({"west": 5}, 13, segments=[manifest.Segment(6, 13, "x")]).needed(12)
    with pytest.raises(manifest.VersionExpired):
        manifest.Manifest({"west": 5}, 13, floor=9).check(8)


def test_validation(spark, fixture):
    base, tail = fixture
    assert schemas.tail_problems(tail).isEmpty() and schemas.base_problems(base, {"west": 5, "east": 8}).isEmpty()
    bad = spark.createDataFrame([(1, 2, "MERGE", None, "x", "west", 1, 1, 2), (2, 2, "UPDATE", None, None, "west", 1, 1, 2), (3, 3, "DELETE", None, None, None, None, None, 1), (4, 4, "DELETE", None, None, None, None, None, 2), (4, 4, "DELETE", None, None, None, None, None, 2)], schemas.TAIL_V2)
    assert {r["reason"] for r in schemas.tail_problems(bad).collect()} == {"unknown operation", "incomplete after-image", "unknown writer schema", "two effects at one version"}
    assert schemas.base_problems(base, {"west": 5, "east": 9}).count() == 3
    with pytest.raises(ValueError):
        schemas.normalize(base, 3)
    assert snapshot.large_groups(tail, 1).collect()[0]["id"] == 1
    wide = spark.range(1).select(F.lit("9223372036854775807").cast("decimal(20,0)").alias("x"))
    assert schemas.signed(wide).first()["x"] == 2**63 - 1
