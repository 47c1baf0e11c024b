"""The registered queries: each operator over the derived tables, with an independent SQL statement for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, ordered, stats
from ..operators import authority, compact, mvcc, pages, routing, sets, snapshot, txlog
from ..sources import derived as D
from ..streaming import windows
from .front import sql as run_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
T, LOWER = D.TARGET, D.LOWER


def query(statement: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if statement:
            SQL[function.__name__] = statement
        return function

    return register


# --- snapshots ------------------------------------------------------------------------------

_SNAP = f"WITH {D.SNAPSHOT_SQL}, {D.snapshot_sql('snap', T)} "


def _snap(spark: SparkSession, folder: str, target: int = T) -> DataFrame:
    return snapshot.overlay(D.base(spark, folder), D.tail(spark, folder), target, LOWER)


@query(_SNAP + "SELECT * FROM snap")
def snap_all_at_t(spark, folder):
    return _snap(spark, folder)


@query(_SNAP + "SELECT * FROM snap")
def snap_single_pass(spark, folder):
    return snapshot.overlay_single_pass(D.base(spark, folder), D.tail(spark, folder), T, LOWER)


@query(_SNAP + "SELECT * FROM snap WHERE status = 'OPEN' AND part = 'west' ORDER BY amount_cents DESC, id LIMIT 1")
def snap_filtered_topk(spark, folder):
    return _snap(spark, folder).where("status = 'OPEN' and part = 'west'").orderBy(F.desc("amount_cents"), "id").limit(1)


@query(_SNAP + "SELECT * FROM snap WHERE id = 28")
def snap_point(spark, folder):
    return _snap(spark, folder).where("id = 28")


@query(_SNAP + "SELECT amount_cents FROM snap")
def snap_projection(spark, folder):
    return _snap(spark, folder).select("amount_cents")


@query(_SNAP + "SELECT status, part, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS amount_cents FROM snap GROUP BY status, part")
def snap_status_agg(spark, folder):
    return _snap(spark, folder).groupBy("status", "part").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("amount_cents"))


@query(_SNAP + "SELECT * FROM snap WHERE id > 100 OR (id = 100 AND part > 'east') ORDER BY id, part LIMIT 50")
def snap_continuation_page(spark, folder):
    identity = {"table": "orders", "target_version": T, "schema_version": 2, "partition_epoch": 0}
    return snapshot.page(_snap(spark, folder), 50, snapshot.Continuation(**identity, last_id=100, last_part="east"), **identity)


@query("SELECT min(w) AS lower, max(w) AS upper FROM (SELECT CASE WHEN o_custkey % 2 = 0 THEN 5 ELSE 8 END AS w FROM orders WHERE o_orderkey % 10 <> 3) x")
def snap_min_watermark(spark, folder):
    return D.base(spark, folder).agg(F.min("base_watermark").alias("lower"), F.max("base_watermark").alias("upper"))


@query(_SNAP + "SELECT s.id, b.part AS old_part, s.part AS new_part FROM snap s JOIN base b ON s.id = b.id WHERE s.part <> b.part")
def snap_moved_rows(spark, folder):
    old = D.base(spark, folder).select("id", F.col("part").alias("old_part"))
    return _snap(spark, folder).select("id", F.col("part").alias("new_part")).join(old, "id").where("old_part <> new_part").select("id", "old_part", "new_part")


@query(_SNAP + "SELECT id FROM base WHERE id NOT IN (SELECT id FROM snap)")
def snap_deleted_ids(spark, folder):
    return D.base(spark, folder).join(_snap(spark, folder), "id", "left_anti").select("id")


@query(_SNAP + f", win AS (SELECT * FROM tail WHERE commit_version > {LOWER} AND commit_version <= {T}) SELECT id, commit_version, operation FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY commit_version DESC) AS rn FROM win) x WHERE rn = 1")
def snap_tail_effects(spark, folder):
    return snapshot.latest_effects(snapshot.window(D.tail(spark, folder), LOWER, T)).select("id", "commit_version", "operation")


@query(f"WITH {D.SNAPSHOT_SQL}, {D.snapshot_sql('a', 8)}, {D.snapshot_sql('b', T)} SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'ADDED' WHEN b.id IS NULL THEN 'REMOVED' WHEN a.status <> b.status OR a.part <> b.part OR a.amount_cents <> b.amount_cents OR a.priority <> b.priority THEN 'CHANGED' END AS change FROM a FULL JOIN b ON a.id = b.id) x WHERE change IS NOT NULL")
def snap_diff_t1_t2(spark, folder):
    return snapshot.difference(_snap(spark, folder, 8), _snap(spark, folder, T))


@query(_SNAP + "SELECT n_name, s.status, count(*) AS n, CAST(sum(s.amount_cents) AS BIGINT) AS amount_cents FROM snap s JOIN orders o ON s.id = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation ON c.c_nationkey = n_nationkey GROUP BY n_name, s.status")
def snap_two_tables_join(spark, folder):
    o = D.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c_custkey"))
    c = D.table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = D.table(spark, folder, "nation").select("n_nationkey", "n_name")
    return _snap(spark, folder).join(o, "id").join(c, "c_custkey").join(n, "n_nationkey").groupBy("n_name", "status").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("amount_cents"))


@query("SELECT t AS target, CASE WHEN t > 16 THEN 'future' WHEN t < 8 THEN 'behind' ELSE 'available' END AS status FROM range(0, 20) r(t)")
def snap_availability(spark, folder):
    highest = D.base(spark, folder).agg(F.max("base_watermark").alias("w"))
    status = F.when(F.col("id") > D.AVAILABLE, "future").when(F.col("id") < F.col("w"), "behind").otherwise("available")
    return spark.range(20).crossJoin(F.broadcast(highest)).select(F.col("id").alias("target"), status.alias("status"))


@query(_SNAP + "SELECT 'id=' || id || chr(124) || 'status=' || status || chr(124) || 'part=' || part || chr(124) || 'amount_cents=' || amount_cents || chr(124) || 'priority=' || priority AS row FROM snap")
def snap_canonical_rows(spark, folder):
    return snapshot.canonical_rows(_snap(spark, folder))


@query("WITH d AS (SELECT o_custkey % 50 AS certificate, o_orderkey % 40 AS resource, CASE WHEN o_custkey % 50 % 3 = 0 THEN o_orderkey % 40 % 3 ELSE o_orderkey % 3 END AS token, CASE WHEN o_custkey % 50 % 3 = 0 THEN o_orderkey % 7 ELSE o_orderkey % 9 END AS used FROM orders) SELECT certificate, CASE WHEN bool_and(token = resource % 3 AND used <= 6) THEN 'Approve' ELSE 'Retry' END AS verdict FROM d GROUP BY certificate")
def snap_certificates(spark, folder):
    needs = D.table(spark, folder, "orders").selectExpr("o_custkey % 50 AS certificate", "o_orderkey % 40 AS resource", "CASE WHEN o_custkey % 50 % 3 = 0 THEN o_orderkey % 40 % 3 ELSE o_orderkey % 3 END AS token", "CASE WHEN o_custkey % 50 % 3 = 0 THEN o_orderkey % 7 ELSE o_orderkey % 9 END AS used")
    current = spark.range(40).selectExpr("id AS resource", "id % 3 AS current_token", "6 AS most")
    return snapshot.tokens_hold(needs, current)


_BOTH = f"{_SNAP}, {D.accounts_sql('accounts', T)} "
_JOINED = "SELECT s.status, a.status AS account_status, count(*) AS n, CAST(sum(a.amount_cents) AS BIGINT) AS balance FROM {snap} s JOIN {orders} ON s.id = o_orderkey JOIN {accounts} a ON o_custkey = a.id GROUP BY s.status, a.status"


@query(_BOTH + _JOINED.replace("{", "").replace("}", ""))
def snap_join_two_watermarks(spark, folder):
    """Two versioned tables, each from its own watermark, at one version."""
    accounts = snapshot.overlay(D.accounts_base(spark, folder), D.accounts_tail(spark, folder), T, D.ACCOUNTS_LOWER)
    return run_sql(spark, _JOINED, {"snap": _snap(spark, folder), "accounts": accounts, "orders": D.table(spark, folder, "orders")})


@query(f"WITH {D.SNAPSHOT_SQL}, {D.snapshot_sql('a', 8)}, {D.snapshot_sql('b', T)}, n AS (SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x) AS left_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) y) AS right_only) SELECT left_only + right_only = 0 AS same, left_only, right_only FROM n")
def snap_multiset_compare(spark, folder):
    return sets.same_multisets(_snap(spark, folder, 8), _snap(spark, folder, T))


@query("SELECT event_id, id, version FROM (SELECT *, lag(id) OVER (ORDER BY event_id) AS i, lag(version) OVER (ORDER BY event_id) AS w FROM (SELECT event_id, event_id // 10 - CASE WHEN event_id % 370 = 0 THEN 3 ELSE 0 END AS id, CASE WHEN event_id % 41 = 0 THEN 0 ELSE event_id % 10 END AS version FROM events) x) y WHERE i > id OR (i = id AND w > version)")
def input_order_check(spark, folder):
    rows = D.table(spark, folder, "events").selectExpr("event_id", "event_id div 10 - CASE WHEN event_id % 370 = 0 THEN 3 ELSE 0 END AS id", "CASE WHEN event_id % 41 = 0 THEN 0 ELSE event_id % 10 END AS version")
    return ordered.unsorted(rows, "event_id", ["id", "version"])


# --- multi-version reads --------------------------------------------------------------------

_LOG = f"WITH {D.LOG_SQL}"
_AT = 6000


@query(f"{_LOG}, {D.visible_sql('vis', str(_AT))} SELECT k, v, val FROM vis")
def kv_scan_range_clears(spark, folder):
    return mvcc.scan(D.log(spark, folder), _AT)


@query(f"{_LOG}, {D.visible_sql('vis', str(_AT))} SELECT k, v, val FROM vis WHERE k = 9")
def kv_get_at_t(spark, folder):
    return mvcc.get(D.log(spark, folder), 9, _AT)


@query(f"{_LOG}, {D.visible_sql('vis', str(_AT))} SELECT k, v, val FROM vis WHERE k >= 10 AND k < 90")
def kv_scan_range_at_t(spark, folder):
    return mvcc.scan(D.log(spark, folder), _AT, 10, 90)


_COVERED = 400


@query(f"{_LOG}, {D.visible_sql('vis', str(_AT))} SELECT k, v, val FROM vis")
def kv_view_scan(spark, folder):
    log = D.log(spark, folder)
    return mvcc.view_scan(log.where(F.col("v") <= _COVERED), log, _COVERED, _AT)


@query(f"{_LOG}, {D.visible_sql('vis', str(_AT))} SELECT k, v, val FROM vis WHERE k >= 3 AND k < 120 ORDER BY k LIMIT 20")
def kv_view_scan_limit(spark, folder):
    log = D.log(spark, folder)
    return mvcc.view_scan(log.where(F.col("v") <= _COVERED), log, _COVERED, _AT, 3, 120, 20)


@query(f"{_LOG}, {D.visible_sql('vis', str(_AT))} SELECT k, v, val FROM vis WHERE k = 9")
def kv_view_get(spark, folder):
    log = D.log(spark, folder)
    return mvcc.view_get(log.where(F.col("v") <= _COVERED), log, _COVERED, 9, _AT)


@query("SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def prefix_scan(spark, folder):
    return mvcc.with_prefix(D.table(spark, folder, "customer"), "c_name", "Customer#00000001").select("c_custkey")


@query("SELECT k FROM (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer) x WHERE starts_with(k, '12') OR starts_with('12', k)")
def prefix_overlap(spark, folder):
    return mvcc.meeting_prefix(D.table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("k")), "k", "12")


@query(f"{_LOG}, {D.visible_sql('vis', str(_AT))} SELECT k, v, val FROM vis WHERE k >= 10 ORDER BY k LIMIT 20")
def kv_scan_limit(spark, folder):
    return mvcc.scan(D.log(spark, folder), _AT, 10, limit=20)


@query(f"{_LOG}, {D.visible_sql('vis', str(_AT))} SELECT k, v, val FROM vis ORDER BY k DESC LIMIT 20")
def kv_scan_reverse(spark, folder):
    return mvcc.scan(D.log(spark, folder), _AT, limit=20, reverse=True)


@query(f"{_LOG} SELECT w.k, w.at, CASE WHEN p.op = 'SET' AND p.v >= coalesce(c.v, 0) THEN p.val END AS val FROM (SELECT k, CAST(a AS BIGINT) AS at FROM (SELECT DISTINCT k FROM log) x CROSS JOIN (SELECT unnest([100, 1000, 2500, 4000, 6000, 9000]) AS a) y) w LEFT JOIN LATERAL (SELECT l.v, l.op, l.val FROM log l WHERE l.k = w.k AND l.op <> 'CLEAR_RANGE' AND l.v <= w.at ORDER BY l.v DESC LIMIT 1) p ON true LEFT JOIN LATERAL (SELECT max(l.v) AS v FROM log l WHERE l.op = 'CLEAR_RANGE' AND l.s <= w.k AND w.k < l.e AND l.v <= w.at) c ON true")
def kv_multi_get_many_t(spark, folder):
    log = D.log(spark, folder)
    wanted = log.select("k").distinct().withColumn("at", F.explode(F.array(*[F.lit(x) for x in (100, 1000, 2500, 4000, 6000, 9000)])))
    return mvcc.get_many(log, wanted)


@query(f"{_LOG} SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS rn FROM log WHERE op <> 'CLEAR_RANGE' AND v <= {_AT}) x WHERE rn = 1 AND op = 'CLEAR'")
def kv_tombstones_at_t(spark, folder):
    return mvcc.latest_points(D.log(spark, folder), _AT).where("op = 'CLEAR'").select("k", "v")


@query(f"{_LOG} SELECT k, max(c.v) AS cleared_at FROM (SELECT DISTINCT k FROM log) x JOIN (SELECT v, s, e FROM log WHERE op = 'CLEAR_RANGE' AND v <= {_AT}) c ON c.s <= k AND k < c.e GROUP BY k")
def kv_covering_clear(spark, folder):
    log = D.log(spark, folder)
    return mvcc.covered_by(log.select("k"), mvcc.clears(log), _AT)


@query(f"{_LOG} SELECT k, count(*) AS versions FROM log WHERE op <> 'CLEAR_RANGE' GROUP BY k")
def kv_history_depth(spark, folder):
    return mvcc.history_depth(D.log(spark, folder))


_PENDING = "(op_index, op, k, s, e, val)"


@query(f"{_LOG}, {D.visible_sql('vis', str(_AT))}, own AS (SELECT event_id AS v, CASE WHEN event_type = 'error' THEN 'CLEAR' WHEN event_type = 'signup' THEN 'CLEAR_RANGE' ELSE 'SET' END AS op, user_id AS k, user_id AS s, user_id + 5 AS e, CAST(round(value * 100) AS BIGINT) AS val FROM events WHERE event_id >= {_AT} AND event_id < {_AT} + 200), {D.visible_sql('mine', '1000000000', 'own')} SELECT k, val FROM mine UNION ALL SELECT k, val FROM vis WHERE k NOT IN (SELECT k FROM own WHERE op <> 'CLEAR_RANGE') AND NOT EXISTS (SELECT 1 FROM own c WHERE c.op = 'CLEAR_RANGE' AND c.s <= vis.k AND vis.k < c.e)")
def kv_read_your_writes(spark, folder):
    log = D.log(spark, folder)
    pending = log.where(f"v > {_AT} and v <= {_AT + 200}").withColumn("op_index", F.col("v") - 1).drop("v")
    return mvcc.read_your_writes(log, _AT, pending)


@query("WITH s AS (SELECT user_id AS k, event_id AS at, CAST(round(value * 100) AS BIGINT) AS x FROM events WHERE event_type = 'click'), w AS (SELECT user_id AS k, event_id AS at FROM events WHERE event_type = 'purchase') SELECT w.k, w.at, s.x FROM w ASOF LEFT JOIN s ON w.k = s.k AND w.at >= s.at")
def kv_asof_latest(spark, folder):
    e = D.table(spark, folder, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("at"), "event_type", F.round(F.col("value") * 100).cast("long").alias("x"))
    return mvcc.as_of(e.where("event_type = 'click'").select("k", "at", "x"), e.where("event_type = 'purchase'").select("k", "at"), ["k"], "at", "x")


_MULTI = "multi AS (SELECT DISTINCT event_id // 40 + 1 AS v, CASE WHEN event_type = 'error' THEN 'CLEAR' ELSE 'SET' END AS op, user_id AS k, CAST(round(value) AS BIGINT) AS val FROM events WHERE event_type <> 'signup')"


def _multi(spark, folder):
    """Several mutations a version, repeats included."""
    log = D.log(spark, folder).where("op <> 'CLEAR_RANGE'")
    e = D.table(spark, folder, "events").select((F.col("event_id") + 1).alias("v"), F.round("value").cast("long").alias("val"))
    return log.drop("val").join(e, "v").withColumn("v", F.floor((F.col("v") - 1) / 40) + 1)


@query(f"WITH {_MULTI} SELECT v, op, k, val FROM multi")
def canonical_dedup(spark, folder):
    return mvcc.canonical(_multi(spark, folder)).select("v", "op", "k", "val")


@query(f"WITH {_MULTI} SELECT v, k FROM multi GROUP BY v, k HAVING count(*) > 1")
def ambiguous_mutations(spark, folder):
    return mvcc.problems(_multi(spark, folder))


@query("WITH b AS (SELECT event_id AS seq, CASE WHEN event_id % 50 = 0 THEN 0 WHEN event_id % 11 = 0 THEN event_id - 10 WHEN event_id % 17 = 0 THEN event_id + 5 ELSE event_id END AS v, event_id % 2 AS identity, user_id % 2 AS fingerprint FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY seq) AS rn, first_value(identity) OVER (PARTITION BY v ORDER BY seq) AS i, first_value(fingerprint) OVER (PARTITION BY v ORDER BY seq) AS f, max(v) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM b) SELECT seq, v, CASE WHEN v = 0 THEN 'Invalid' WHEN rn > 1 THEN CASE WHEN i = identity AND f = fingerprint THEN 'AlreadyApplied' ELSE 'ConflictingReplay' END WHEN above > v THEN 'NonMonotonic' ELSE 'Applied' END AS outcome FROM r")
def apply_batches(spark, folder):
    e = D.table(spark, folder, "events")
    return mvcc.admit(e.selectExpr("event_id AS seq", "CASE WHEN event_id % 50 = 0 THEN 0 WHEN event_id % 11 = 0 THEN event_id - 10 WHEN event_id % 17 = 0 THEN event_id + 5 ELSE event_id END AS v", "event_id % 2 AS identity", "user_id % 2 AS fingerprint"))


# --- compaction and collection --------------------------------------------------------------

_FLOOR = 7000
_FATES = f"{_LOG}, fates AS (SELECT k, v, op, val, CASE WHEN v > {_FLOOR} THEN 'kept_newer' WHEN row_number() OVER (PARTITION BY k, v <= {_FLOOR} ORDER BY v DESC) = 1 THEN 'floor_anchor' ELSE 'dropped' END AS fate FROM log WHERE op <> 'CLEAR_RANGE')"


@query(_FATES + " SELECT k, v, op, val FROM fates WHERE fate <> 'dropped'")
def gc_retained_rows(spark, folder):
    return compact.retained(mvcc.points(D.log(spark, folder)), _FLOOR)


@query(_FATES + " SELECT count(*) AS inspected, count(*) FILTER (fate = 'kept_newer') AS kept_newer, count(*) FILTER (fate = 'floor_anchor') AS floor_anchors, count(*) FILTER (fate = 'dropped') AS dropped FROM fates")
def gc_stats_counters(spark, folder):
    return compact.retention_counts(mvcc.points(D.log(spark, folder)), _FLOOR)


_ENTRIES = "CASE WHEN v % 53 = 0 THEN NULL ELSE k END AS k, v, CASE WHEN v % 59 = 0 THEN 'OTHER' ELSE op END AS op, v % 13 = 0 AS meta"


@query(f"{_LOG}, entries AS (SELECT {_ENTRIES} FROM log WHERE op <> 'CLEAR_RANGE'), kinds AS (SELECT *, CASE WHEN meta THEN 'metadata' WHEN k IS NULL OR op = 'OTHER' THEN 'malformed' ELSE 'user' END AS kind FROM entries), ranked AS (SELECT *, row_number() OVER (PARTITION BY kind, k, v <= {_FLOOR} ORDER BY v DESC) AS rn FROM kinds) SELECT count(*) FILTER (kind = 'user') AS inspected, count(*) FILTER (kind = 'user' AND v > {_FLOOR}) AS kept_newer, count(*) FILTER (kind = 'user' AND v <= {_FLOOR} AND rn = 1) AS floor_anchors, count(*) FILTER (kind = 'user' AND v <= {_FLOOR} AND rn > 1) AS dropped, count(*) FILTER (kind = 'metadata') AS metadata, count(*) FILTER (kind = 'malformed') AS malformed FROM ranked")
def gc_stats_six_counters(spark, folder):
    entries = mvcc.points(D.log(spark, folder)).selectExpr("CASE WHEN v % 53 = 0 THEN NULL ELSE k END AS k", "v", "CASE WHEN v % 59 = 0 THEN 'OTHER' ELSE op END AS op", "v % 13 = 0 AS meta")
    return compact.retention_stats(entries, _FLOOR, F.col("meta"))


@query(_FATES + " SELECT (SELECT count(*) FROM fates) AS stored, (SELECT count(*) FROM fates WHERE fate <> 'dropped') AS live, (SELECT count(*) FROM fates) / (SELECT count(*) FROM fates WHERE fate <> 'dropped') AS amplification")
def gc_amplification(spark, folder):
    points = mvcc.points(D.log(spark, folder))
    return compact.amplification(points, compact.retained(points, _FLOOR))


@query(_SNAP + "SELECT * FROM snap")
def objectify_then_read(spark, folder):
    tail = D.tail(spark, folder)
    rebuilt = compact.objectify(_snap(spark, folder, 10), 10)
    return snapshot.overlay(rebuilt, tail, T, 10)


_SEGMENTS = "seg AS (SELECT event_id * 10 + CASE WHEN event_id % 40 = 7 THEN 3 ELSE 0 END AS after, event_id * 10 + 10 AS through, CAST(event_id AS VARCHAR) AS prior_chain, CAST(event_id + CASE WHEN event_id % 31 = 5 THEN 9 ELSE 1 END AS VARCHAR) AS chain FROM events WHERE event_id < 400)"


_ALL_SEGMENTS = _SEGMENTS.replace(" WHERE event_id < 400", "")


@query(f"WITH {_ALL_SEGMENTS} SELECT * FROM (SELECT after, through, CASE WHEN after >= through THEN 'empty' WHEN lag(through) OVER (ORDER BY through) <> after THEN 'not contiguous' WHEN lag(chain) OVER (ORDER BY through) <> prior_chain THEN 'other chain' END AS reason FROM seg) x WHERE reason IS NOT NULL")
def delta_lineage_check(spark, folder):
    e = D.table(spark, folder, "events")
    return compact.lineage_problems(e.selectExpr("event_id * 10 + CASE WHEN event_id % 40 = 7 THEN 3 ELSE 0 END AS after", "event_id * 10 + 10 AS through", "CAST(event_id AS STRING) AS prior_chain", "CAST(event_id + CASE WHEN event_id % 31 = 5 THEN 9 ELSE 1 END AS STRING) AS chain"))


_GRAPH = "edges AS (SELECT o_custkey AS parent, o_custkey * 2 + 1 + o_orderkey % 2 AS child FROM orders WHERE o_custkey % 7 <> 0), marked AS (WITH RECURSIVE m AS (SELECT CAST(r AS BIGINT) AS id FROM range(1, 4) t(r) UNION SELECT e.child FROM m JOIN edges e ON m.id = e.parent) SELECT id FROM m), objects AS (SELECT c_custkey AS id, CAST(round(c_acctbal * 100) AS BIGINT) AS bytes FROM customer)"


def _graph(spark, folder):
    edges = D.table(spark, folder, "orders").where("o_custkey % 7 <> 0").selectExpr("o_custkey AS parent", "o_custkey * 2 + 1 + o_orderkey % 2 AS child").distinct()
    objects = D.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") * 100).cast("long").alias("bytes"))
    _checkpoints(spark)
    return objects, compact.reachable(spark.range(1, 4), edges)


def _checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the cluster's shared folder; only on one machine, as in tests, to a temporary one."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


@query(f"WITH {_GRAPH} SELECT id FROM marked")
def closure_reachable(spark, folder):
    return _graph(spark, folder)[1].select("id")


@query(f"WITH {_GRAPH} SELECT id FROM objects WHERE id NOT IN (SELECT id FROM marked)")
def gc_candidates(spark, folder):
    return compact.candidates(*_graph(spark, folder)).select("id")


@query(f"WITH {_GRAPH} SELECT id FROM marked WHERE id NOT IN (SELECT id FROM objects)")
def closure_incomplete(spark, folder):
    objects, marked = _graph(spark, folder)
    return compact.incomplete(marked, objects)


@query(f"WITH {_GRAPH} SELECT CAST(coalesce(sum(bytes) FILTER (id IN (SELECT id FROM marked)), 0) AS BIGINT) AS reachable_bytes, CAST(sum(bytes) AS BIGINT) AS physical_bytes FROM objects")
def reachable_bytes(spark, folder):
    return compact.bytes_of(*_graph(spark, folder))




@query()
def read_floor(spark, folder):
    e = D.table(spark, folder, "events")
    leases = e.where("event_id % 9 = 0").selectExpr("event_id AS step", "event_id * 2 AS snapshot", "event_id + 1 + user_id % 40 AS until")
    return compact.read_floor(e.selectExpr("event_id AS step", "event_id * 3 AS frontier"), leases, 60)


# --- transaction log ------------------------------------------------------------------------

_TX = f"WITH {D.TRANSACTIONS_SQL}, rd AS (SELECT txn, k, read_version, commit_version FROM acc UNION ALL SELECT txn, k + 1, read_version, commit_version FROM acc), wr AS (SELECT DISTINCT k, commit_version AS v FROM acc)"


def _reads_writes(spark, folder):
    access = D.transactions(spark, folder)
    reads = access.select("txn", F.explode(F.array(F.col("k"), F.col("k") + 1)).alias("k"), "read_version", "commit_version")
    return reads, access.select("k", F.col("commit_version").alias("v")).distinct()


@query(_TX + " SELECT t.txn, EXISTS (SELECT 1 FROM rd r JOIN wr w ON r.k = w.k WHERE r.txn = t.txn AND w.v > r.read_version AND w.v < r.commit_version) AS conflict FROM (SELECT DISTINCT txn FROM acc) t")
def occ_conflicts(spark, folder):
    return txlog.conflicts(*_reads_writes(spark, folder))


@query()
def occ_execute(spark, folder):
    access = D.transactions(spark, folder)
    grouped = access.groupBy((F.col("txn") % 8).alias("domain"), "commit_version", "txn", "read_version").agg(F.transform(F.sort_array(F.collect_list("k")), lambda k: F.struct(k.alias("s"), (k + 2).alias("e"))).alias("reads"), F.sort_array(F.collect_list("k")).alias("writes"))
    return txlog.execute(grouped)


_PARTS = "parts AS (SELECT * FROM (VALUES (1, 0, 50), (2, 50, 100), (3, 100, 1000000)) p(resolver, lo, hi)), rng AS (SELECT DISTINCT txn, k - 3 AS s, k + 4 AS e FROM acc), cut AS (SELECT DISTINCT txn, resolver, greatest(s, lo) AS s, least(e, hi) AS e FROM rng JOIN parts ON s < hi AND lo < e)"


def _clipped(spark, folder):
    parts = spark.createDataFrame([(1, 0, 50), (2, 50, 100), (3, 100, 1000000)], "resolver int, lo long, hi long")
    ranges = D.transactions(spark, folder).select("txn", (F.col("k") - 3).alias("s"), (F.col("k") + 4).alias("e")).distinct()
    return txlog.clip(ranges, F.broadcast(parts))


@query(_TX + f", {_PARTS} SELECT txn, resolver, s, e FROM cut")
def resolver_clip(spark, folder):
    return _clipped(spark, folder)


@query(_TX + f", {_PARTS} SELECT c.txn, NOT bool_or(EXISTS (SELECT 1 FROM wr w WHERE w.k >= c.s AND w.k < c.e AND w.v > t.read_version AND w.v < t.commit_version)) AS accepted FROM cut c JOIN (SELECT DISTINCT txn, read_version, commit_version FROM acc) t ON c.txn = t.txn GROUP BY c.txn")
def resolver_decisions(spark, folder):
    access = D.transactions(spark, folder)
    clipped = _clipped(spark, folder).join(access.select("txn", "read_version", "commit_version").distinct(), "txn")
    return txlog.decisions(clipped, _reads_writes(spark, folder)[1])


_CHAIN = "SELECT event_id AS version, props AS envelope, CASE WHEN event_id % 100 = 42 THEN 'bad' ELSE sha256(lag(props) OVER (ORDER BY event_id)) END AS previous_chain FROM events"


@query(f"WITH c AS ({_CHAIN}) SELECT version FROM (SELECT version, previous_chain, sha256(lag(envelope) OVER (ORDER BY version)) AS want FROM c) x WHERE want <> previous_chain")
def chain_verify(spark, folder):
    e = D.table(spark, folder, "events").select(F.col("event_id").alias("version"), F.col("props").alias("envelope"))
    before = e.select((F.col("version") + 1).alias("version"), F.sha2("envelope", 256).alias("own"))
    linked = e.join(before, "version", "left").select("version", "envelope", F.when(F.col("version") % 100 == 42, "bad").otherwise(F.col("own")).alias("previous_chain"))
    return txlog.chain_problems(linked)


@query("SELECT version, missing FROM (SELECT event_id AS version, event_id - lag(event_id) OVER (ORDER BY event_id) - 1 AS missing FROM events WHERE event_id % 13 <> 0 AND event_id % 29 > 1) x WHERE missing > 0")
def gap_check(spark, folder):
    return txlog.gaps(D.table(spark, folder, "events").where("event_id % 13 <> 0 and event_id % 29 > 1").select(F.col("event_id").alias("version")))


_QUORUM = f"WITH {D.FRAMES_SQL}, ok AS (SELECT idx, digest FROM frames GROUP BY idx, digest HAVING count(DISTINCT replica) >= 2), ord AS (SELECT DISTINCT idx FROM ok), jump AS (SELECT idx FROM (SELECT idx, coalesce(lag(idx) OVER (ORDER BY idx), -1) AS p FROM ord) x WHERE idx <> p + 1)"


@query(_QUORUM + " SELECT idx, digest FROM ok WHERE idx < coalesce((SELECT min(idx) FROM jump), 9223372036854775807)")
def quorum_recover(spark, folder):
    return txlog.quorum_recover(D.frames(spark, folder), 2)


@query(_QUORUM + " SELECT idx, 'gap' AS problem FROM jump UNION ALL SELECT idx, 'conflict' FROM ok GROUP BY idx HAVING count(*) > 1")
def quorum_problems(spark, folder):
    return txlog.quorum_problems(D.frames(spark, folder), 2)


@query("WITH h AS (SELECT DISTINCT event_id AS idx, s AS log_set, n AS node FROM events CROSS JOIN (SELECT unnest([0, 1]) AS s) a CROSS JOIN (SELECT unnest([0, 1, 2]) AS n) b WHERE (event_id * 5 + n * 3 + s) % 7 <> 0 AND NOT (event_id > 700 AND s = 1 AND n > 0)), c AS (SELECT i.idx, i.log_set, count(h.node) AS n FROM (SELECT DISTINCT idx, s AS log_set FROM h CROSS JOIN (SELECT unnest([0, 1]) AS s) z) i LEFT JOIN h ON h.idx = i.idx AND h.log_set = i.log_set GROUP BY i.idx, i.log_set), o AS (SELECT idx, bool_and(n >= 2) AS ok FROM c GROUP BY idx) SELECT idx FROM o WHERE idx < coalesce((SELECT min(idx) FROM o WHERE NOT ok), 9223372036854775807)")
def staged_prefix(spark, folder):
    e = D.table(spark, folder, "events").select(F.col("event_id").alias("idx"), F.explode(F.array(F.lit(0), F.lit(1))).alias("log_set"))
    held = e.withColumn("node", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("(idx * 5 + node * 3 + log_set) % 7 <> 0 and not (idx > 700 and log_set = 1 and node > 0)")
    return txlog.staged_prefix(held, spark.range(2).select(F.col("id").cast("int").alias("log_set")), 2)


def _all_tickets(spark, folder):
    return D.table(spark, folder, "events").selectExpr("CASE WHEN event_id % 90 = 8 THEN event_id - 2 ELSE event_id - 1 END AS previous_ticket", "event_id AS ticket", "event_id - event_id % 10 + (event_id * 3) % 10 AS arrival")


def _tickets(spark, folder):
    return _all_tickets(spark, folder).where("ticket < 2000")


_TICKETS = "tk AS (SELECT CASE WHEN event_id % 90 = 8 THEN event_id - 2 ELSE event_id - 1 END AS previous_ticket, event_id AS ticket, event_id - event_id % 10 + (event_id * 3) % 10 AS arrival FROM events WHERE event_id < 2000)"


_ALL_TICKETS = _TICKETS.replace(" WHERE event_id < 2000", "")


@query(f"WITH {_ALL_TICKETS} SELECT ticket, previous_ticket FROM (SELECT *, lag(ticket) OVER (ORDER BY ticket) AS p FROM tk) x WHERE p <> previous_ticket")
def ticket_order(spark, folder):
    return txlog.ticket_problems(_all_tickets(spark, folder))


@query()
def ticket_pending_depth(spark, folder):
    return txlog.pending_depth(_all_tickets(spark, folder))


@query(_TX + " SELECT DISTINCT r.txn, r.k FROM rd r JOIN wr w ON r.k = w.k WHERE w.v > r.read_version AND w.v < r.commit_version")
def serial_read_deps(spark, folder):
    return txlog.read_dependency_problems(*_reads_writes(spark, folder))


@query("WITH h AS (SELECT event_id // 5 AS round, event_id + CASE WHEN event_id % 60 = 3 THEN -8 ELSE 0 END AS seq FROM events) SELECT round FROM (SELECT round, min(seq) AS least, max(max(seq)) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM h GROUP BY round) x WHERE least <= above")
def realtime_order(spark, folder):
    return txlog.real_time_problems(D.table(spark, folder, "events").selectExpr("event_id div 5 AS round", "event_id + CASE WHEN event_id % 60 = 3 THEN -8 ELSE 0 END AS seq"))


@query("SELECT event_id // 6 AS item, count(DISTINCT user_id % 4) AS signers, count(DISTINCT user_id % 4) >= 3 AS reached FROM events GROUP BY 1")
def distinct_signers(spark, folder):
    return txlog.distinct_signers(D.table(spark, folder, "events").selectExpr("event_id div 6 AS item", "user_id % 4 AS signer"), 3)


@query("SELECT CASE WHEN bool_and(n >= 2) THEN 'Admit' ELSE 'RateLimited' END AS decision FROM (SELECT user_id % 3 AS log_set, count(*) FILTER (event_id + 100 <= 5000) AS n FROM events GROUP BY 1) x")
def rate_admission(spark, folder):
    return txlog.admits(D.table(spark, folder, "events").selectExpr("user_id % 3 AS log_set", "event_id AS retained"), 100, 5000, 2)


@query("SELECT event_id // 20 AS batch, sha256(string_agg(props, chr(10) ORDER BY event_id)) AS digest FROM events GROUP BY 1")
def batch_fingerprint(spark, folder):
    e = D.table(spark, folder, "events").selectExpr("event_id div 20 AS batch", "event_id", "props")
    return txlog.history_digest(e, ["batch"], "event_id", "props")


@query()
def authority_fold(spark, folder):
    e = D.table(spark, folder, "events").selectExpr("user_id % 16 AS range_id", "event_id AS step", "element_at(array('advance', 'acquire', 'retain', 'renew', 'release', 'expire', 'prepare', 'publish', 'pin', 'unpin'), CAST(event_id % 10 AS INT) + 1) AS action", "concat('l', CAST(user_id % 5 AS STRING)) AS name", "event_id AS value", "event_id + 50 AS other")
    return authority.fold(e)


@query("WITH l AS (SELECT DISTINCT user_id AS g, event_type AS m FROM events WHERE event_id % 3 <> 0), r AS (SELECT DISTINCT user_id AS g, event_type AS m FROM events WHERE event_id % 3 <> 1), b AS (SELECT coalesce(l.g, r.g) AS g, l.m IS NOT NULL AS a, r.m IS NOT NULL AS b FROM l FULL JOIN r ON l.g = r.g AND l.m = r.m) SELECT g AS user_id, bool_and(a = b) AS same, bool_and(b OR NOT a) AS inside FROM b GROUP BY g")
def set_compare(spark, folder):
    """Each user's event types in two overlapping logs."""
    e = D.table(spark, folder, "events").select("event_id", "user_id", "event_type")
    return sets.same_sets(e.where("event_id % 3 <> 0"), e.where("event_id % 3 <> 1"), "user_id", "event_type")


@query("SELECT event_id AS request, coalesce(newest, 0) AS read_version, CASE WHEN coalesce(newest, 0) >= event_id - 6 THEN 'Ok' ELSE 'Behind' END AS status FROM (SELECT *, max(CASE WHEN event_type <> 'click' THEN event_id - event_id % 7 END) OVER (ORDER BY event_id) AS newest FROM events) x WHERE event_type = 'click'")
def causal_read_version(spark, folder):
    e = D.table(spark, folder, "events")
    commits = e.where("event_type <> 'click'").selectExpr("event_id AS step", "event_id - event_id % 7 AS commit_version")
    return txlog.causal_reads(commits, e.where("event_type = 'click'").selectExpr("event_id AS request", "event_id AS step", "event_id - 6 AS minimum"))


# --- routes ---------------------------------------------------------------------------------

_ROUTES = [(1, 0, 40), (2, 40, 75), (3, 80, 120), (4, 120, 140)]
_ROUTES_SQL = "routes AS (SELECT * FROM (VALUES (1, 0, 40), (2, 40, 75), (3, 80, 120), (4, 120, 140)) r(range_id, \"start\", \"end\")), scans AS (SELECT event_id AS scan, user_id AS s, user_id + 1 + event_id % 30 AS e FROM events WHERE event_id < 1000)"


def _routes(spark):
    return spark.createDataFrame(_ROUTES, "range_id int, start long, end long")


_ALL_ROUTES_SQL = _ROUTES_SQL.replace(" WHERE event_id < 1000", "")


def _all_scans(spark, folder):
    return D.table(spark, folder, "events").selectExpr("event_id AS scan", "user_id AS s", "user_id + 1 + event_id % 30 AS e")


def _scans(spark, folder):
    return _all_scans(spark, folder).where("scan < 1000")


@query(f"WITH {_ROUTES_SQL} SELECT k, range_id FROM (SELECT DISTINCT user_id AS k FROM events) x LEFT JOIN routes ON \"start\" <= k AND k < \"end\"")
def route_lookup(spark, folder):
    return routing.lookup(D.table(spark, folder, "events").select(F.col("user_id").alias("k")).distinct(), _routes(spark))


@query(f"WITH {_ALL_ROUTES_SQL} SELECT scan, range_id, greatest(s, \"start\") AS s, least(e, \"end\") AS e FROM scans JOIN routes ON s < \"end\" AND \"start\" < e")
def route_scan_split(spark, folder):
    return routing.split(_all_scans(spark, folder), F.broadcast(_routes(spark)))


@query(f"WITH {_ALL_ROUTES_SQL} SELECT scan FROM scans WHERE e - s > coalesce((SELECT sum(least(e, \"end\") - greatest(s, \"start\")) FROM routes WHERE s < \"end\" AND \"start\" < e), 0)")
def route_gaps(spark, folder):
    return routing.uncovered(_all_scans(spark, folder), F.broadcast(_routes(spark)))


@query("SELECT event_id AS request, CASE WHEN event_id % 23 = 0 THEN 'WrongCell' WHEN event_id % 19 = 0 THEN 'WrongTenant' WHEN event_id % 17 = 0 THEN 'StaleEpoch' WHEN user_id < 20 OR user_id >= 100 THEN 'KeyOutsideRange' WHEN user_id + 10 > 100 THEN 'CrossesSplit' WHEN event_id % 300 > 256 THEN 'TooManyRows' ELSE 'Ok' END AS status FROM events")
def route_fence(spark, folder):
    r = D.table(spark, folder, "events").selectExpr("event_id AS request", "CASE WHEN event_id % 23 = 0 THEN 'x' ELSE 'c' END AS cell", "CASE WHEN event_id % 19 = 0 THEN 'x' ELSE 't' END AS tenant", "CASE WHEN event_id % 17 = 0 THEN 6 ELSE 7 END AS epoch", "user_id AS s", "user_id + 10 AS e", "event_id % 300 AS row_limit")
    return routing.fence(r, "c", "t", 7, 20, 100, 256)


@query("SELECT max(n) / avg(n) AS hotspot_ratio FROM (SELECT CASE WHEN user_id < 50 THEN 0 ELSE 1 END AS side, count(*) AS n FROM events GROUP BY 1) x")
def hotspot_ratio(spark, folder):
    loads = D.table(spark, folder, "events").groupBy((F.col("user_id") < 50).alias("side")).agg(F.count("*").alias("n"))
    return stats.hotspot_ratio(loads, "n")


# --- statistics -----------------------------------------------------------------------------


def _samples(spark, folder):
    return D.table(spark, folder, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("long").alias("x"))


_SAMPLES = "s AS (SELECT l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS x FROM lineitem)"


@query(f"WITH {_SAMPLES}, m AS (SELECT l_returnflag, median(x) AS median FROM s GROUP BY 1) SELECT s.l_returnflag, any_value(m.median) AS median, median(abs(s.x - m.median)) AS mad FROM s JOIN m ON s.l_returnflag = m.l_returnflag GROUP BY s.l_returnflag")
def median_mad(spark, folder):
    return stats.median_mad(_samples(spark, folder), ["l_returnflag"], "x")


_RANKS = f"WITH {_SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM s)"


@query(_RANKS + " SELECT l_returnflag, max(x) FILTER (i = (n - 1) // 2) AS p50, max(x) FILTER (i = ceil((n - 1) * 99 / 100)) AS p99 FROM r GROUP BY 1")
def nearest_rank_ceil(spark, folder):
    return stats.nearest_rank_ceil(_samples(spark, folder), ["l_returnflag"], "x")


@query(_RANKS + " SELECT l_returnflag, max(x) FILTER (i = ((n - 1) * 50) // 100) AS p50, max(x) FILTER (i = ((n - 1) * 99) // 100) AS p99 FROM r GROUP BY 1")
def nearest_rank_floor(spark, folder):
    return stats.nearest_rank_floor(_samples(spark, folder), ["l_returnflag"], "x")


@query("SELECT l_returnflag, CASE WHEN q = 0 THEN 0 ELSE w / q END AS write_amplification FROM (SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, CAST(sum(CAST(l_quantity AS BIGINT) + l_linenumber) AS BIGINT) AS w FROM lineitem GROUP BY 1) x")
def write_amplification(spark, folder):
    x = D.table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.sum(F.col("l_quantity").cast("long") + F.col("l_linenumber")).alias("w"))
    return x.select("l_returnflag", stats.ratio(F.col("w"), F.col("q")).alias("write_amplification"))


@query("SELECT r AS fixed_ram, d AS debt, least(c, greatest(40000 - r, 0)) AS cache, concat_ws(',', CASE WHEN least(c, greatest(40000 - r, 0)) < c THEN 'shrink_cache' END, CASE WHEN d > 60000 THEN 'compact' END, CASE WHEN r > 40000 THEN 'evict_range' END) AS actions, CASE WHEN r > 40000 THEN 'Refuse' WHEN d > 60000 THEN 'RateLimit' ELSE 'Admit' END AS decision FROM (SELECT CAST(sum(p_size) AS BIGINT) AS r, CAST(sum(p_size * 2) AS BIGINT) AS d, CAST(sum(p_partkey) AS BIGINT) AS c FROM part) x")
def pressure_decision(spark, folder):
    p = D.table(spark, folder, "part").select(F.col("p_size").alias("fixed_ram"), (F.col("p_size") * 2).alias("debt"), F.col("p_partkey").alias("cache"))
    return stats.pressure(p, 40000, 60000)


# --- pages ----------------------------------------------------------------------------------

_PAGES = "pg AS (SELECT l_suppkey AS rel, l_linenumber AS block, l_orderkey * 10 + l_linenumber AS v, l_orderkey AS page_lsn FROM lineitem)"


def _pages(spark, folder):
    return D.table(spark, folder, "lineitem").selectExpr("l_suppkey AS rel", "l_linenumber AS block", "l_orderkey * 10 + l_linenumber AS v", "l_orderkey AS page_lsn")


@query(f"WITH {_PAGES} SELECT rel, block, v, v // 10 AS page_lsn FROM (SELECT rel, block, max(v) AS v FROM pg WHERE v <= 90000 GROUP BY 1, 2) x")
def page_latest_at_t(spark, folder):
    return pages.latest(_pages(spark, folder), 90000)


@query("SELECT batch, CASE WHEN v = 0 THEN 'ZeroVersion' WHEN n > 7 THEN 'TooManyPages' WHEN b < n THEN 'RepeatedBlock' WHEN lsn > 9000 THEN 'AheadOfLog' ELSE 'Ok' END AS status FROM (SELECT l_orderkey AS batch, min(l_orderkey) AS v, count(*) AS n, count(DISTINCT l_linenumber) AS b, max(l_orderkey) AS lsn FROM lineitem GROUP BY 1) x")
def page_wal_admission(spark, folder):
    w = D.table(spark, folder, "lineitem").selectExpr("l_orderkey AS batch", "l_orderkey AS v", "l_linenumber AS block", "l_orderkey AS page_lsn")
    return pages.write_admission(w, 9000, 7)


_PLAN = "w AS (SELECT l_orderkey AS batch, l_suppkey AS rel, min(l_linenumber) AS low, max(l_linenumber) AS high, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1, 2), x AS (SELECT s_suppkey AS rel, s_suppkey % 6 AS nblocks FROM supplier WHERE s_suppkey % 5 <> 0)"


@query(f"WITH {_PLAN} SELECT batch, w.rel, CASE WHEN high < coalesce(nblocks, 0) THEN 'WriteExisting' WHEN low = coalesce(nblocks, 0) AND high - low + 1 = n THEN 'Extend' ELSE 'Refused' END AS plan FROM w LEFT JOIN x ON w.rel = x.rel")
def page_extend_check(spark, folder):
    writes = D.table(spark, folder, "lineitem").selectExpr("l_orderkey AS batch", "l_suppkey AS rel", "l_linenumber AS block")
    return pages.commit_plan(writes, D.table(spark, folder, "supplier").where("s_suppkey % 5 <> 0").selectExpr("s_suppkey AS rel", "s_suppkey % 6 AS nblocks"))


@query(f"WITH {_PAGES} SELECT rel, arg_max(block, v) AS nblocks FROM (SELECT DISTINCT * FROM pg) p WHERE v <= 90000 GROUP BY rel")
def page_extent_at_t(spark, folder):
    return pages.extent(_pages(spark, folder).withColumnRenamed("block", "nblocks"), 90000)


@query()
def codec_round_trip(spark, folder):
    k = D.table(spark, folder, "customer").select("c_custkey", F.concat(F.col("c_name").cast("binary"), F.unhex(F.lit("0000FF00"))).alias("key"))
    out = k.withColumns({"physical": codecs.physical_key(F.col("key"), F.col("c_custkey")), "again": codecs.unescape_key(codecs.escape_key(F.col("key"))), "number": codecs.from_u64(codecs.u64(F.col("c_custkey"))), "kind": codecs.envelope_kind(codecs.envelope(F.when(F.col("c_custkey") % 2 == 0, F.col("key"))))})
    return out.select("c_custkey", F.hex("physical").alias("physical"), (F.col("again") == F.col("key")).alias("key_ok"), (F.col("number") == F.col("c_custkey")).alias("number_ok"), "kind")


# --- delegated SQL at one version -----------------------------------------------------------

_BREADTH = {
    "sql_inner_join": "SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey",
    "sql_full_join": "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_custkey AS k, count(*) AS n FROM {customer} GROUP BY 1) a FULL OUTER JOIN (SELECT s_suppkey * 7 AS k, count(*) AS n FROM {supplier} GROUP BY 1) b ON a.k = b.k",
    "sql_semi_join": "SELECT p_partkey FROM {part} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity > 45)",
    "sql_anti_join": "SELECT p_partkey FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity > 47)",
    "sql_cross_join": "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}",
    "sql_range_join": "SELECT n_nationkey, count(*) AS n FROM {nation} JOIN {supplier} ON s_suppkey >= n_nationkey AND s_suppkey < n_nationkey + 3 GROUP BY n_nationkey",
    "sql_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "sql_distinct_agg": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag",
    "sql_rank": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS rn, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS dr FROM {orders}",
    "sql_lag": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM {orders}",
    "sql_frame_rows": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM {orders}",
    "sql_frame_range": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS n FROM {orders}",
    "sql_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}",
    "sql_intersect": "SELECT c_custkey AS k FROM {customer} INTERSECT SELECT s_suppkey AS k FROM {supplier}",
    "sql_except": "SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey AS k FROM {lineitem} WHERE l_quantity > 47",
    "sql_topk": "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM {orders} ORDER BY cents DESC, o_orderkey LIMIT 25",
    "sql_string": "SELECT c_custkey, upper(c_name) AS u, CAST(length(c_name) AS BIGINT) AS n, substring(c_name, 1, 4) AS head, replace(c_mktsegment, 'A', '*') AS seg, concat(c_name, '-', c_mktsegment) AS both FROM {customer}",
    "sql_date": "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS d FROM {orders}",
    "sql_math": "SELECT l_orderkey, l_linenumber, CAST(round(abs(l_extendedprice * (1 - l_discount)) * 100) AS BIGINT) AS net, CAST(floor(l_quantity / 7) AS BIGINT) AS f, CAST(ceil(l_quantity / 7) AS BIGINT) AS c FROM {lineitem}",
    "sql_case_having": "SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS done, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12",
    "sql_scalar_subquery": "SELECT p_partkey FROM {part} WHERE p_size > (SELECT avg(p_size) FROM {part})",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _breadth(statement: str):
    return lambda spark, folder: run_sql(spark, statement, {t: D.table(spark, folder, t) for t in _TABLES if "{" + t + "}" in statement})


for _name, _statement in _BREADTH.items():
    QUERIES[_name] = _breadth(_statement)
    SQL[_name] = _statement.replace("{", "").replace("}", "")
for _name in ("sql_case_having",):
    SQL[_name] = SQL[_name].replace("sum(CASE", "CAST(sum(CASE").replace("END) AS", "END) AS BIGINT) AS")


@query("SELECT user_id, list_sort(list_distinct(list(event_type))) AS types, len(list_distinct(list(event_type))) AS n FROM events GROUP BY user_id")
def sql_array(spark, folder):
    types = F.sort_array(F.collect_set("event_type"))
    return D.table(spark, folder, "events").groupBy("user_id").agg(types.alias("types")).withColumn("n", F.size("types").cast("long"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY event_type")
def sql_json(spark, folder):
    return D.table(spark, folder, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("event_type").agg(F.sum("k").alias("k"), F.count("*").alias("n"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id")
def sql_map(spark, folder):
    counted = D.table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    at = lambda name: F.coalesce(F.try_element_at("m", F.lit(name)), F.lit(0))
    return counted.select("user_id", at("click").alias("clicks"), at("error").alias("errors"))


@query("SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents) x WHERE length(term) > 0 GROUP BY term HAVING count(DISTINCT doc_id) >= 50")
def inverted_search(spark, folder):
    terms = D.table(spark, folder, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).where("term <> ''")
    return terms.groupBy("term").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("occurrences")).where("docs >= 50")


# --- event-time windows and the tail as state -----------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def win_tumbling(spark, folder):
    return windows.tumbling(D.table(spark, folder, "events"), "1 hour", ["event_type"])


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * i) AS window_start, event_type, count(*) AS n FROM events CROSS JOIN (SELECT unnest([0, 1]) AS i) z GROUP BY 1, 2")
def win_sliding(spark, folder):
    return windows.sliding(D.table(spark, folder, "events"), "1 hour", "30 minutes", ["event_type"])


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n FROM g GROUP BY user_id, s")
def win_session(spark, folder):
    return windows.sessions(D.table(spark, folder, "events"), "1 hour", ["user_id"])


@query(f"WITH {D.SNAPSHOT_SQL} SELECT id, commit_version, operation FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY commit_version DESC) AS rn FROM tail WHERE commit_version <= {T}) x WHERE rn = 1")
def stream_tail_state(spark, folder):
    return snapshot.latest_effects(D.tail(spark, folder).where(F.col("commit_version") <= T)).select("id", "commit_version", "operation")
