"""Random histories, compaction, the authority fold, codecs, objects and streams."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codecs, ordered
from tidemark.operators import authority, compact, mvcc, pages, txlog
from tidemark.sources import objects, schemas
from tidemark.streaming import tail as stream_tail
from tidemark.streaming import windows

LOG = "v long, op string, k long, s long, e long, val long"


def history(seed, n=250, keys=16):
    rng, out = random.Random(seed), []
    for v in range(1, n + 1):
        kind = rng.random()
        if kind < 0.5:
            out.append((v, "SET", rng.randrange(keys), None, None, rng.randrange(1000)))
        elif kind < 0.8:
            out.append((v, "CLEAR", rng.randrange(keys), None, None, None))
        else:
            a, b = sorted((rng.randrange(keys), rng.randrange(keys + 1)))
            out.append((v, "CLEAR_RANGE", None, a, b, None))
            if rng.random() < 0.5:
                out.append((v, "SET", rng.randrange(keys), None, None, rng.randrange(1000)))
    return out


def replay(log, at):
    state = {}
    for v in range(1, at + 1):
        now = [m for m in log if m[0] == v]
        for _, op, _, s, e, _ in now:
            if op == "CLEAR_RANGE":
                for k in range(s, e):
                    state.pop(k, None)
        for _, op, k, _, _, val in now:
            if op == "SET":
                state[k] = val
            elif op == "CLEAR":
                state.pop(k, None)
    return state


@pytest.mark.parametrize("seed", [1103, 2207])
def test_random_histories(spark, seed):
    log = history(seed)
    df = spark.createDataFrame(log, LOG).cache()
    for at in (1, 60, 133, 250):
        want = replay(log, at)
        assert {r["k"]: r["val"] for r in mvcc.scan(df, at).collect()} == want
        clears = {r["k"]: r["cleared_at"] for r in mvcc.latest_clear_by_key(df, at).collect()}
        keys = spark.range(16).select(F.col("id").alias("k"))
        assert {r["k"]: r["cleared_at"] for r in mvcc.covered_by(keys, mvcc.clears(df), at).collect()} == {k: v for k, v in clears.items() if k < 16}
    wanted = spark.createDataFrame([(k, at) for k in range(16) for at in (20, 90, 250)], "k long, at long")
    got = {(r["k"], r["at"]): r["val"] for r in mvcc.get_many(df, wanted).collect()}
    assert got == {(k, at): replay(log, at).get(k) for k in range(16) for at in (20, 90, 250)}
    # range clears ignored, or the tombstone anchor dropped, must show
    assert any({r["k"]: r["val"] for r in mvcc.scan(df.where("op <> 'CLEAR_RANGE'"), at).collect()} != replay(log, at) for at in (133, 250))


def test_compaction_keeps_reads_and_tombstones(spark):
    log = [m for m in history(3301) if m[1] != "CLEAR_RANGE"]
    df = spark.createDataFrame(log, LOG)
    kept = compact.retained(mvcc.points(df), 120).withColumns({"s": F.lit(None).cast("long"), "e": F.lit(None).cast("long")})
    for at in (120, 150, 250):
        assert {r["k"]: r["val"] for r in mvcc.scan(kept, at).collect()} == {r["k"]: r["val"] for r in mvcc.scan(df, at).collect()}
    counts = compact.retention_counts(mvcc.points(df), 120).first()
    assert counts["inspected"] == counts["kept_newer"] + counts["floor_anchors"] + counts["dropped"] == len(log)
    poisoned = kept.where("not (op = 'CLEAR' and v <= 120)").unionByName(df.where("v <= 60").select(*kept.columns))
    assert mvcc.scan(poisoned, 120).count() >= mvcc.scan(df, 120).count()


def test_read_your_writes_goes_by_call_order(spark):
    log = spark.createDataFrame([(1, "SET", 1, None, None, 10), (2, "SET", 2, None, None, 20)], LOG)
    pending = spark.createDataFrame([(0, "SET", 3, None, None, 30), (1, "CLEAR_RANGE", None, 2, 4, None), (2, "SET", 2, None, None, 21)], "op_index long, op string, k long, s long, e long, val long")
    assert {r["k"]: r["val"] for r in mvcc.read_your_writes(log, 2, pending).collect()} == {1: 10, 2: 21}
    with pytest.raises(ValueError):
        mvcc.scan(log, 2, 5, 5)


def test_occ_execution_against_a_plain_fold(spark):
    rng, txns = random.Random(5), []
    for v in range(1, 200):
        txns.append((v % 3, v, v, max(0, v - 1 - rng.randrange(9)), [(k, k + 2) for k in rng.sample(range(12), 2)], rng.sample(range(12), 2)))
    df = spark.createDataFrame(txns, "domain long, commit_version long, txn long, read_version long, reads array<struct<s:long,e:long>>, writes array<long>")
    newest, want = {}, {}
    for d, v, t, r, reads, writes in txns:
        hit = any(newest.get((d, k), -1) > r for a, b in reads for k in range(a, b))
        want[t] = "Conflict" if hit else "Committed"
        if not hit:
            newest.update({(d, k): v for k in writes})
    assert {r["txn"]: r["outcome"] for r in txlog.execute(df).collect()} == want


def test_authority(spark):
    steps = [("advance", None, 100, None), ("acquire", "a", 40, 10), ("acquire", "b", 200, 10), ("retain", None, 20, None), ("acquire", "c", 10, 10), ("expire", None, 10, None), ("retain", None, 20, None), ("prepare", None, 60, 2), ("publish", "r1", None, 2), ("publish", "r1", None, 3), ("renew", "a", None, 5), ("bogus", None, None, None)]
    df = spark.createDataFrame([(7, i, *s) for i, s in enumerate(steps)], "range_id long, step long, action string, name string, value long, other long")
    got = [(r["status"], r["floor"]) for r in authority.fold(df).orderBy("step").collect()]
    assert got == [("Ok", 0), ("Ok", 0), ("AheadOfFrontier", 0), ("Ok", 40), ("BelowFloor", 40), ("Expired1", 40), ("Ok", 80), ("Ok", 80), ("Ok", 80), ("NothingPrepared", 80), ("NoLease", 80), ("UnknownAction", 80)]


def test_order_helpers_cross_stretches(spark):
    rng = random.Random(2)
    values = [(i, rng.randrange(100) if rng.random() < 0.5 else None) for i in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(values, "i long, x long")
    listed = sorted(values)
    before = {i: None if n == 0 else listed[n - 1][0] for n, (i, _) in enumerate(listed)}
    assert {r["i"]: r["previous"] and r["previous"]["i"] for r in ordered.with_previous(df, "i", ["i"], 37).collect()} == before
    last, most, filled, running = None, None, {}, {}
    for i, x in listed:
        last = x if x is not None else last
        most = x if most is None else max(most, x) if x is not None else most
        filled[i], running[i] = last, most
    assert {r["i"]: r["x"] for r in ordered.filled_forward(df.withColumn("z", F.lit(0)), "i", "z", "x", 37).collect()} == filled
    assert {r["i"]: r["m"] for r in ordered.running(df, "i", "m", F.max, F.col("x"), width=37).collect()} == running


def test_codecs_keep_order(spark):
    keys = [b"", b"\0", b"\0\0", b"\0\xff", b"a", b"a\0", b"a\0b", b"ab", b"\xff"]
    df = spark.createDataFrame([(k,) for k in keys], "k binary")
    got = df.select("k", codecs.escape_key(F.col("k")).alias("e"), codecs.unescape_key(codecs.escape_key(F.col("k"))).alias("b")).collect()
    assert all(bytes(r["b"]) == bytes(r["k"]) for r in got)
    assert [bytes(r["k"]) for r in sorted(got, key=lambda r: bytes(r["e"]))] == sorted(keys)
    number = spark.range(3).select(codecs.u64(F.col("id")).alias("u"), codecs.u64_descending(F.col("id")).alias("d")).collect()
    assert bytes(number[2]["u"]) == bytes(7) + b"\2" and bytes(number[0]["d"]) > bytes(number[1]["d"])
    kinds = spark.createDataFrame([(b"\1x",), (b"\0",), (b"\0x",), (b"",), (b"\7",)], "r binary").select(codecs.envelope_kind(F.col("r")).alias("t"))
    assert [r["t"] for r in kinds.collect()] == ["SET", "TOMBSTONE", "CORRUPT", "CORRUPT", "CORRUPT"]


def test_objects(spark, tmp_path):
    path = f"{tmp_path}/o"
    assert objects.put_if_absent(path, b"one") and not objects.put_if_absent(path, b"one")
    with pytest.raises(objects.Conflict):
        objects.put_if_absent(path, b"two")
    objects.compare_and_put(path, b"two", objects.digest(b"one"))
    with pytest.raises(objects.Conflict):
        objects.compare_and_put(path, b"three", objects.digest(b"one"))
    with pytest.raises(objects.Corrupt):
        objects.get_verified(path, objects.digest(b"one"))
    assert objects.get_range_verified(path, 1, 3, objects.digest(b"two")) == b"wo"
    want = spark.createDataFrame([(path, objects.digest(b"two"), 3), (f"{tmp_path}/gone", "x", 1)], "path string, sha256 string, length long")
    assert [tuple(r) for r in objects.audit(spark, str(tmp_path), want).collect()] == [(f"{tmp_path}/gone", "missing")]
    with pytest.raises(objects.Conflict):
        objects.delete_reserved(path, set())
    assert objects.delete_reserved(path, {path})


def test_reachable_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "parent long, child long")
    got = compact.reachable(spark.createDataFrame([(1,)], "id long"), edges)
    assert {(r["id"], r["depth"]) for r in got.collect()} == {(1, 0), (2, 1), (3, 2)}


def test_pages(spark):
    found = spark.createDataFrame([(3,), (5,)], "block long")
    assert {tuple(r) for r in pages.vector_problems(found, 3, 2).collect()} == {(4, "missing"), (5, "extra")}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 5, 6 + (i * 7) % 23, "UPDATE", "west", "OPEN", "west", i, i % 3, 2) for i in range(20)]
    tail = spark.createDataFrame(rows, schemas.TAIL_V2).dropDuplicates(["id", "commit_version"]).cache()
    for n in range(3):
        tail.where(F.col("commit_version") % 3 == n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/tail")
    want = {r["id"]: r["commit_version"] for r in stream_tail.newest_in_batch(tail).collect()}
    started = stream_tail.merge_batches(stream_tail.read(spark, f"{tmp_path}/tail"), f"{tmp_path}/base", f"{tmp_path}/c1")
    started.awaitTermination()
    last = started.lastProgress["batchId"]
    assert {r["id"]: r["commit_version"] for r in spark.read.parquet(f"{tmp_path}/base/generation={last}").collect()} == want
    effects = stream_tail.newest(stream_tail.read(spark, f"{tmp_path}/tail"), 100)
    effects.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    emitted = spark.read.parquet(f"{tmp_path}/out")
    assert {r["id"]: r["v"] for r in emitted.groupBy("id").agg(F.max("commit_version").alias("v")).collect()} == want


def test_windows_on_a_stream(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 7 as int)) AS ts, id % 2 AS k FROM range(60)")
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    windows.tumbling(stream, "1 hour", ["k"], "10 minutes").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, windows.tumbling(events, "1 hour", ["k"]).collect()))
