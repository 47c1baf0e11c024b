"""Views over base and tail, sets, order checks and floors on small made inputs."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ordered
from tidemark.operators import compact, mvcc, sets, txlog
from tidemark.sources.manifest import Manifest

LOG = "v long, op string, k long, s long, e long, val long"
ROWS = [(1, "SET", 1, 0, 0, 10), (2, "SET", 2, 0, 0, 20), (3, "SET", 5, 0, 0, 50), (4, "CLEAR_RANGE", 0, 2, 4, 0), (5, "SET", 3, 0, 0, 30), (6, "CLEAR", 1, 0, 0, 0), (7, "CLEAR_RANGE", 0, 4, 9, 0), (8, "SET", 6, 0, 0, 60)]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(ROWS, LOG).cache()


@pytest.mark.parametrize("covered", [0, 3, 5, 8])
@pytest.mark.parametrize("at", [2, 4, 6, 8])
def test_view_equals_scan(log, covered, at):
    found = mvcc.view_scan(log.where(F.col("v") <= covered), log, covered, at)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, mvcc.scan(log, at).collect()))


def test_view_limit_reverse_and_get(log):
    base = log.where("v <= 4")
    assert [r["k"] for r in mvcc.view_scan(base, log, 4, 8, 2, 7, 1, True).collect()] == [6]
    assert [r["val"] for r in mvcc.view_get(base, log, 4, 3, 8).collect()] == [30]
    assert mvcc.view_get(base, log, 4, 5, 8).count() == 0 and mvcc.view_get(base, log, 4, 5, 6).count() == 1


def test_ranges_are_cut_before_they_are_spelt_out(spark):
    wide = spark.createDataFrame([(1, "SET", 7, 0, 0, 1), (2, "CLEAR_RANGE", 0, 0, 1 << 40, 0), (3, "SET", 8, 0, 0, 2)], LOG)
    assert [(r["k"], r["val"]) for r in mvcc.scan(wide, 3, 5, 10).collect()] == [(8, 2)]


def test_sets(spark):
    left, right = (spark.createDataFrame(x, "g int, m string") for x in ([(1, "a"), (1, "a"), (1, None), (2, "b"), (3, "c")], [(1, "a"), (1, None), (2, "b"), (2, "d")]))
    assert sorted(map(tuple, sets.same_sets(left, right, "g", "m").collect())) == [(1, True, True), (2, False, True), (3, False, False)]
    assert tuple(sets.same_multisets(left, right).first()) == (False, 2, 1)
    assert tuple(sets.same_multisets(left, left.orderBy("m")).first()) == (True, 0, 0)
    assert tuple(sets.same_multisets(left.limit(0), right.limit(0)).first()) == (True, 0, 0)


def test_unsorted_across_stretches(spark):
    rows = spark.createDataFrame([(0, 1, 1), (1 << 20, 1, 0), ((1 << 20) + 1, 2, 0), (1 << 21, 2, 0)], "seq long, id int, version int")
    assert [tuple(r) for r in ordered.unsorted(rows, "seq", ["id", "version"]).collect()] == [(1 << 20, 1, 0)]


def test_floor_advances_only():
    manifest = Manifest({"a": 3}, 9, 2)
    assert manifest.retain_from(5).floor == 5 and manifest.retain_from(2).floor == 2
    for floor in (1, 10):
        with pytest.raises(ValueError):
            manifest.retain_from(floor)


def test_six_counters_and_causal_reads(spark):
    entries = spark.createDataFrame([(1, 1, "SET", False), (1, 2, "CLEAR", None), (1, 9, "SET", False), (None, 3, "SET", False), (2, 4, None, False), (2, 5, "x", True)], "k long, v long, op string, meta boolean")
    assert tuple(compact.retention_stats(entries, 5, F.col("meta")).first()) == (3, 1, 1, 1, 1, 2)
    commits = spark.createDataFrame([(1, 5), (3, 7)], "step long, commit_version long")
    asks = spark.createDataFrame([(1, 0, 1), (2, 1, 5), (3, 2, 6), (4, 3, 6)], "request long, step long, minimum long")
    assert sorted(map(tuple, txlog.causal_reads(commits, asks).collect())) == [(1, 0, "Behind"), (2, 5, "Ok"), (3, 5, "Behind"), (4, 7, "Ok")]
